"""Mixing sources to target weights: iterative proportional fitting, then sampling.

Tokens are summed by cell (source, language, topic ...) with partial aggregates, so a source
with a third of all rows is one row per task. The cell weights are raked to the target shares
of every dimension in turn until all margins agree; the sums of a level come from a window over
the cells, and some sweeps at a time are written to the shared folder.

``keep`` is the share of all tokens (of levels with a target) that is drawn in expectation. No
cell gives more than its tokens, so a level cannot get more than it has: ``reachable`` gives
each level the part of the budget that its target asks for, at most all it has, and spreads what
that leaves over the other levels of its dimension in proportion. Raking is to these margins,
with full cells held at their tokens and the free cells raked against what remains. With
``hold`` the budget is lowered instead until every target can be reached. Without ``keep`` the
largest probability is 1. Nothing is repeated. A document's probability is its cell's weight over
the cell's tokens; it is drawn if a hash of its id, as a number in [0, 1), is below. Recomputed
tasks draw alike. ``margin_report`` has the shares asked for, reachable and got.

Defined results: a null level is a level of its own; a level without a target share gets
probability 0; targets of levels without documents are spread over the others in proportion;
margins that cannot all hold (empty cells) end at ``sweeps`` or when sweeps change nothing;
null and empty texts have 0 tokens, and a cell without tokens the probability 1; repeated ids
are drawn alike; an empty table gives no rows; all columns are carried inside ``row``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from attrition.llm.common import one_plan, written

NONE = "\x00none"
KEEP = 0.8  # share of all tokens that op4_mixing and the pipeline draw


def word_tokens(text):
    """Words of a text column, split at white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def level(dim: str):
    return F.coalesce(F.col(f"`{dim}`").cast("string"), F.lit(NONE))


def tempered(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """Target shares of ``dim``, not normalised: the observed tokens to ``power``."""
    return cells.groupBy(dim).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("share"))


def _targets(cells: DataFrame, targets: dict) -> dict:
    """Per dimension (dimension, share, held): normalised shares of the levels that have tokens, and these tokens."""
    out = {}
    for d, t in targets.items():
        levels = cells.where("tokens > 0").groupBy(d).agg(F.sum("tokens").cast("double").alias("held"))
        levels = levels.join(t, d, "left").select(d, F.coalesce("share", F.lit(0.0)).alias("share"), "held")
        total = levels.agg(F.sum("share").alias("s")).first()[0] or 1.0
        out[d] = written(levels.withColumn("share", F.col("share") / total), f"target-{d}")
    return out


def filled(levels: DataFrame, budget: float) -> float:
    """The scale at which the shares, no level above its tokens, sum to ``budget``; levels found full stay full, so rounds end."""
    scale = None
    while True:
        full = F.lit(False) if scale is None else F.col("share") * scale >= F.col("held")
        held, free = levels.agg(F.sum(F.when(full, F.col("held"))), F.sum(F.when(~full, F.col("share")))).first()
        now = (budget - (held or 0)) / free if free else scale or 1.0
        if scale is not None and now <= scale * (1 + 1e-12):
            return scale
        scale = now


def reachable(targets: dict, keep: float, hold: bool = False) -> tuple:
    """(budget in tokens, per dimension (dimension, goal)) of ``_targets``: ``keep`` of the tokens that every dimension
    has a target for, or with ``hold`` at most what leaves every level's share within its tokens."""
    facts = [t.where("share > 0").agg(F.sum("held").alias("held"), F.min(F.col("held") / F.col("share")).alias("most")).first() for t in targets.values()]
    budget = keep * min((f["held"] or 0.0 for f in facts), default=0.0)
    if hold:
        budget = min([budget, *[f["most"] for f in facts if f["most"] is not None]])
    return budget, {d: t.withColumn("goal", F.least("held", F.col("share") * filled(t, budget))).select(d, "goal") for d, t in targets.items()}


def rake(cells: DataFrame, targets: dict, tolerance: float = 1e-7, sweeps: int = 200, together: int = 4) -> DataFrame:
    """``cells`` (one column per dimension, tokens) with ``weight``: tokens raked to ``targets`` {dimension: (dimension, share)}, shares of any sum; weights sum to 1."""
    goals = {d: t.select(d, F.col("share").alias("goal")) for d, t in _targets(cells, targets).items()}
    return _raked(cells, goals, 1.0, False, tolerance, sweeps, together)


def rake_within(cells: DataFrame, goals: dict, budget: float, tolerance: float = 1e-8, sweeps: int = 400, together: int = 4) -> DataFrame:
    """``cells`` with ``weight``: tokens raked to ``goals`` {dimension: (dimension, goal)}, each dimension's sum being ``budget`` tokens, and no cell above its tokens."""
    return _raked(cells, goals, budget, True, tolerance, sweeps, together)


def _raked(cells: DataFrame, goals: dict, budget: float, capped: bool, tolerance: float, sweeps: int, together: int) -> DataFrame:
    """Weights are tokens times a factor of each level, and count up to their cell's tokens only. One step gives a level
    the factor that brings its free cells to its goal beside the full ones (by which some more may get full; the next
    sweep sees them). The deviations of a sweep are carried along, so ``together`` sweeps are one plan and one written table."""
    dims = list(goals)
    total = cells.where("tokens > 0").agg(F.sum("tokens")).first()[0] or 1
    now = cells.where("tokens > 0")
    for d, g in goals.items():
        now = now.join(g.withColumnRenamed("goal", f"goal_{d}"), d)
    now = written(now.withColumn("weight", F.col("tokens") * F.lit(budget / total)), "cells")
    cap = F.col("tokens").cast("double") if capped else F.lit(float("inf"))
    last = None
    for _ in range(0, sweeps, together):
        for _ in range(together):
            off = F.lit(0.0)
            for d in dims:
                w, goal, weight = Window.partitionBy(d), F.col(f"goal_{d}"), F.col("weight")
                now = now.withColumns({"_full": F.coalesce(F.sum(F.when(weight >= cap, cap)).over(w), F.lit(0.0)), "_free": F.coalesce(F.sum(F.when(weight < cap, weight)).over(w), F.lit(0.0))})
                held = F.col("_full") + F.col("_free")
                beside = F.try_divide(goal - F.col("_full"), F.col("_free"))
                factor = F.coalesce(F.when(goal > F.col("_full"), F.coalesce(beside, F.lit(1.0))).otherwise(F.try_divide(goal, held)), F.lit(0.0))
                now = now.withColumn("_off", F.greatest(off, F.abs(held - goal))).withColumn("weight", weight * factor)
                off = F.col("_off")
        now = written(now.drop("_full", "_free"), "raked")
        worst = (now.agg(F.max("_off")).first()[0] or 0.0) / (budget or 1.0)
        if worst <= tolerance or last is not None and abs(last - worst) <= tolerance / 100:
            break
        last = worst
    keep = [c for c in now.columns if c != "_off" and not c.startswith("goal_")]
    return now.select(*[F.least(cap, "weight").alias("weight") if c == "weight" else c for c in keep])


def margin_report(cells: DataFrame, weight: DataFrame, targets: dict, goals: dict, budget: float) -> DataFrame:
    """dimension, level, target, reachable, got: shares of the drawn tokens, as asked for, as far as they can be reached, and in expectation."""
    out = []
    for d, t in targets.items():
        got = weight.groupBy(d).agg(F.sum("weight").alias("w"))
        out.append(t.join(goals[d], d).join(got, d, "left").select(
            F.lit(d).alias("dimension"), F.col(d).alias("level"), F.col("share").alias("target"), F.try_divide(F.col("goal"), F.lit(budget)).alias("reachable"),
            F.coalesce(F.try_divide(F.col("w"), F.lit(budget)), F.lit(0.0)).alias("got")))
    return reduce(DataFrame.unionByName, out)


def calibrate(cells: DataFrame, targets: dict, keep: float | None = None, hold: bool = False) -> tuple:
    """(cells with weight, margin report) for the budget ``keep``; None: at the rate of the scarcest cell, whose probability is then 1."""
    known = _targets(cells, targets)
    if keep is None:
        weight = rake(cells, targets)
        scale = 1 / (weight.agg(F.max(F.col("weight") / F.col("tokens"))).first()[0] or 1.0)
        goals = {d: t.select(d, (F.col("share") * scale).alias("goal")) for d, t in known.items()}
        weight = weight.withColumn("weight", F.col("weight") * scale)
        return weight, margin_report(cells, weight, known, goals, scale)
    budget, goals = reachable(known, keep, hold)
    weight = rake_within(cells, goals, budget)
    return weight, margin_report(cells, weight, known, goals, budget)


def mix(docs: DataFrame, dims: list, targets=None, power: float = 0.8, seed: int = 7, id_col: str = "doc_id", text_col: str = "text",
        extra: dict | None = None, keep: float | None = None, hold: bool = False) -> DataFrame:
    """(row, levels, tokens, probability, drawn). ``dims`` are columns, or keys of ``extra`` {name: expression}; ``targets`` {dim: DataFrame(dim, share)}, by default ``tempered``; ``keep``: share of the tokens to draw, ``hold``: less, if targets ask for it."""
    extra = extra or {}
    named = {d: f"d{i}" for i, d in enumerate(dims)}
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    levels = [(F.coalesce(extra[d].cast("string"), F.lit(NONE)) if d in extra else level(d)).alias(n) for d, n in named.items()]
    u = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    df = docs.select(row, *levels, word_tokens(F.col(text_col).cast("string")).alias("tokens"), u.alias("u"))
    cells = written(df.groupBy(*named.values()).agg(F.sum("tokens").alias("tokens")), "mix-cells")
    want = {n: written(targets[d].select(F.coalesce(F.col(d).cast("string"), F.lit(NONE)).alias(n), "share"), "mix-targets") if targets else tempered(cells, n, power) for d, n in named.items()}
    with one_plan(docs.sparkSession, cells.count()):  # raking is many small steps over the cells
        weight, _ = calibrate(cells, want, keep, hold)
        chance = written(weight.select(*named.values(), F.least(F.lit(1.0), F.col("weight") / F.col("tokens")).alias("probability")), "mix-chances")
    out = df.join(chance, list(named.values()), "left").withColumn("probability", F.coalesce("probability", F.lit(1.0)))
    return out.select("row", F.struct(*[F.when(F.col(n) != NONE, F.col(n)).alias(d) for d, n in named.items()]).alias("levels"), "tokens", "probability", (F.col("u") < F.col("probability")).alias("drawn"))


def topic(text):
    """A coarse topic of a text column by its form: tables, marked-up lists, and prose by length."""
    t = F.coalesce(text, F.lit(""))
    return (F.when(t.contains(" | "), "table").when(F.length(t) < 500, "note").when(F.length(t) < 4000, "article").otherwise("book"))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """Calibrated probability and draw of every document; target shares of source, language and topic are the observed ones to the power 0.8, and 0.8 of all tokens are drawn in expectation."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    out = mix(docs, ["source", "lang", "topic"], extra={"topic": topic(F.col("text"))}, keep=KEEP)
    return out.select("row.doc_id", "levels.source", "levels.lang", "levels.topic", "tokens", "probability", "drawn")

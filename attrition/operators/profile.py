"""Profiling and aggregations (§2.3).

Pattern: unpivot the columns into ``(variable, value)`` then F.lit(1) groupBy —
never one job per column. Aggregations over low-cardinality keys
(variable, level, target) are partial (map-side) aggregates, so a level
holding a third of all rows costs one partial row per input split.
Totals for shares come from windows over the already-grouped (small) table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attrition.operators.encode import NUMERIC_TYPES, columns_of_type
from attrition.operators.rank import distinct_counts, prefix_sums, rank_summary
from attrition.operators.sketch import read_profiles, sketch_profiles



def r_type(dt: T.DataType) -> str:
    """R class name of a Spark type, as the reference's profiles report it."""
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(dt, NUMERIC_TYPES):
        return "numeric"
    if isinstance(dt, T.BooleanType):
        return "logical"
    return "character"


def long_strings(df: DataFrame, cols, ids=()) -> DataFrame:
    """(ids..., variable, value) with value cast to string."""
    sel = [F.col(i) for i in ids] + [F.col(c).cast("string").alias(c) for c in cols]
    return df.select(*sel).unpivot(list(ids), list(cols), "variable", "value")


def profile_columns(df: DataFrame, cols=None, approx: bool = False) -> DataFrame:
    """variable, type, missing_count, missing_percent, unique_count, unique_rate.

    ``unique_count`` counts null as one value when present (R ``n_distinct``).
    Exact: unpivot → distinct (variable, value) with counts → per-variable sums.
    ``approx``: one wide HyperLogLog aggregate (no row expansion).
    """
    cols = list(cols or df.columns)
    types = {f.name: r_type(f.dataType) for f in df.schema.fields}
    type_map = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(types[c]))])
    if approx:
        aggs = [F.count(F.lit(1)).alias("n")]
        for i, c in enumerate(cols):
            aggs += [F.count_if(F.col(c).isNull()).alias(f"m{i}"),
                     F.approx_count_distinct(c).alias(f"u{i}")]
        wide = df.agg(*aggs)
        stack = ", ".join(f"'{c}', m{i}, u{i} + CASE WHEN m{i} > 0 THEN 1 ELSE 0 END"
                          for i, c in enumerate(cols))
        per = wide.selectExpr("n", f"stack({len(cols)}, {stack}) AS (variable, missing_count, unique_count)")
    else:
        d = long_strings(df, cols).groupBy("variable", "value").agg(F.count(F.lit(1)).alias("k"))
        per = d.groupBy("variable").agg(
            F.sum("k").alias("n"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("k"))), F.lit(0)).alias("missing_count"),
            F.count(F.lit(1)).alias("unique_count"),
        )
    return per.select(
        "variable",
        type_map[F.col("variable")].alias("type"),
        F.col("missing_count").cast("long").alias("missing_count"),
        F.round(F.col("missing_count") * 100.0 / F.col("n"), 6).alias("missing_percent"),
        F.col("unique_count").cast("long").alias("unique_count"),
        F.round(F.col("unique_count") / F.col("n"), 6).alias("unique_rate"),
    )


def shape_summary(df: DataFrame, features=None, id_col: str | None = None,
                  target: str | None = None) -> DataFrame:
    """item, value: rows, columns, numeric/categorical counts, recognised
    features "n / N", ignored columns and the column list with R types."""
    spark = df.sparkSession
    num = columns_of_type(df, "numeric", exclude=[target] if target else [])
    cat = columns_of_type(df, "categorical", exclude=[target] if target else [])
    items = [("columns", str(len(df.columns))), ("numeric", str(len(num))),
             ("categorical", str(len(cat)))]
    if features is not None:
        found = [f for f in features if f in df.columns]
        extra = [c for c in df.columns if c not in set(features) and c != id_col]
        items += [("features_recognised", f"{len(found)} / {len(features)}"),
                  ("ignored_columns", str(len(extra))),
                  ("ignored_names", ", ".join(extra))]
    items.append(("names", "; ".join(f"{f.name} [{r_type(f.dataType)}]" for f in df.schema.fields)))
    meta = spark.createDataFrame(items, "item string, value string")
    rows = df.agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit("rows").alias("item"), "value")
    return rows.unionByName(meta)


def duplicate_rows(df: DataFrame, cols=None) -> DataFrame:
    """n_rows, n_distinct, n_excess over ``cols`` (default: all columns)."""
    cols = list(cols or df.columns)
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("k"))
    return g.agg(F.sum("k").cast("long").alias("n_rows"),
                 F.count(F.lit(1)).cast("long").alias("n_distinct"),
                 F.sum(F.col("k") - 1).cast("long").alias("n_excess"))


def frequency_table(df: DataFrame, col: str) -> DataFrame:
    """level, n, pct (of all rows), pct_valid (of non-null rows; null level → null)."""
    g = df.groupBy(F.col(col).cast("string").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    total = g.select(F.sum("n")).scalar()
    valid = g.select(F.sum(F.when(F.col("level").isNotNull(), F.col("n")))).scalar()
    return g.select(
        "level", F.col("n").cast("long").alias("n"),
        F.round(F.col("n") * 100.0 / total, 6).alias("pct"),
        F.when(F.col("level").isNotNull(), F.round(F.col("n") * 100.0 / valid, 6)).alias("pct_valid"),
    )


def profile_categorical(df: DataFrame, cols, top: int | None = 10) -> DataFrame:
    """variable, level, total, freq, ratio (percent), rank (by freq desc, level asc).

    Top-k per variable: Catalyst inserts a WindowGroupLimit before the
    exchange, so each task keeps only its local top ``top`` levels.
    """
    g = long_strings(df, cols).groupBy("variable", "value") \
        .agg(F.count(F.lit(1)).alias("freq")).withColumnRenamed("value", "level")
    # totals per variable: grouped aggregate, one row per variable (broadcast)
    tot = g.groupBy("variable").agg(F.sum("freq").cast("long").alias("total"))
    w_rank = Window.partitionBy("variable").orderBy(F.col("freq").desc(), F.col("level").asc_nulls_last())
    out = g.select("variable", "level", F.col("freq").cast("long").alias("freq"),
                   F.row_number().over(w_rank).alias("rank"))
    if top:
        out = out.filter(F.col("rank") <= top)
    out = out.join(F.broadcast(tot), "variable")
    return out.select("variable", "level", "total", "freq",
                      F.round(F.col("freq") * 100.0 / F.col("total"), 6).alias("ratio"), "rank")


def profile_numeric(df: DataFrame, cols, approx: bool = False) -> DataFrame:
    """variable, n, min, q1, mean, median, q3, max, zero, minus, outlier.

    Exact quantiles (type 7, as R/DuckDB ``quantile_cont``) are read off a
    prefix sum over distinct values — no per-group value map in
    memory and no single-task window. ``outlier`` counts values beyond the
    box-plot fences: Tukey's hinges ± 1.5 × the hinge spread (the hinges
    come from the same prefix sums). ``approx``: one pass over the rows with
    mergeable sketches instead (``operators.sketch``).
    """
    r6 = lambda c: F.round(F.col(c).cast("double"), 6).alias(c)
    if approx:
        res = read_profiles(sketch_profiles(df, cols)).where("n > 0")
    else:
        # everything below reads the checkpointed prefix table, not the input again
        src = prefix_sums(distinct_counts(df, cols), ["variable"], "value", ["n"])
        # quartiles and hinges in one aggregation over the prefix table
        q = rank_summary(src, ["variable"], "value",
                         quantiles=[("q1", "n", 0.25), ("median", "n", 0.5), ("q3", "n", 0.75)],
                         hinges=[("", "n")])
        spread = F.col("upper_hinge") - F.col("lower_hinge")
        fences = q.select("variable", "q1", "median", "q3",
                          (F.col("lower_hinge") - 1.5 * spread).alias("lo"),
                          (F.col("upper_hinge") + 1.5 * spread).alias("hi"))
        # one row per variable: bounded by the number of columns profiled
        j = src.join(F.broadcast(fences), "variable")
        n, v = F.col("n"), F.col("value")
        res = j.groupBy("variable").agg(
            F.sum(n).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"),
            (F.sum(v * n) / F.sum(n)).alias("mean"),
            F.coalesce(F.sum(F.when(v == 0, n)), F.lit(0)).alias("zero"),
            F.coalesce(F.sum(F.when(v < 0, n)), F.lit(0)).alias("minus"),
            F.coalesce(F.sum(F.when((v < F.col("lo")) | (v > F.col("hi")), n)), F.lit(0)).alias("outlier"),
            F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"))
    return res.select("variable", F.col("n").cast("long").alias("n"), r6("min"), r6("q1"), r6("mean"),
                      r6("median"), r6("q3"), r6("max"), F.col("zero").cast("long").alias("zero"),
                      F.col("minus").cast("long").alias("minus"),
                      F.col("outlier").cast("long").alias("outlier"))


def category_by_target(df: DataFrame, cols, target: str) -> DataFrame:
    """variable, level, target, n, share (of the level) — the data behind
    bar charts split by target."""
    g = long_strings(df, cols, ids=[target]).groupBy("variable", "value", target) \
        .agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("variable", "value")
    return g.select("variable", F.col("value").alias("level"),
                    F.col(target).cast("string").alias("target"),
                    F.col("n").cast("long").alias("n"),
                    F.round(F.col("n") / F.sum("n").over(w), 6).alias("share"))


WILSON_Z = 1.959963984540054  # two-sided 95 %


def condition_proportions(df: DataFrame, cond: str, by) -> DataFrame:
    """variable, level, n, k, prop, lo, hi: share of rows meeting ``cond``
    per level of each ``by`` variable, with a Wilson 95 % interval."""
    base = df.select(F.expr(f"CASE WHEN {cond} THEN 1 ELSE 0 END").alias("hit"),
                     *[F.col(c).cast("string").alias(c) for c in by])
    g = base.unpivot(["hit"], list(by), "variable", "level").groupBy("variable", "level") \
        .agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("k"))
    z2 = WILSON_Z ** 2
    n, k = F.col("n"), F.col("k")
    p = k / n
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = WILSON_Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return g.select("variable", "level", n.cast("long").alias("n"), k.cast("long").alias("k"),
                    F.round(p, 6).alias("prop"), F.round(centre - half, 6).alias("lo"),
                    F.round(centre + half, 6).alias("hi"))


def class_weight(df: DataFrame, target: str, positive=1) -> DataFrame:
    """n_neg, n_pos, weight = n_neg / n_pos (positive-class weight; null
    without positives; rounded for the report, a fit divides the counts)."""
    t = F.col(target)
    g = df.agg(F.count_if(t != positive).alias("n_neg"), F.count_if(t == positive).alias("n_pos"))
    return g.select(F.col("n_neg").cast("long"), F.col("n_pos").cast("long"),
                    F.round(F.try_divide("n_neg", "n_pos"), 6).alias("weight"))


def top_n(df: DataFrame, keys, n: int, ascending: bool = False, tiebreak=()) -> DataFrame:
    """First ``n`` rows by ``keys`` (distributed TakeOrdered; ties by ``tiebreak``)."""
    order = [F.col(k).asc() if ascending else F.col(k).desc() for k in keys]
    order += [F.col(t).asc() for t in tiebreak]
    return df.orderBy(*order).limit(n)


def risk_segments(df: DataFrame, flags: dict, target: str, positive=1,
                  mode: str = "cube") -> DataFrame:
    """flags..., gid, n, k, rate, lift over every combination of flags.

    The table is first reduced to one row per flag combination (≤ 2^f rows,
    map-side), and the cube runs on that small table — no 2^f expansion of
    the input rows.
    """
    names = list(flags)
    base = df.select(*[F.when(F.expr(e) if isinstance(e, str) else e, 1).otherwise(0).alias(k)
                       for k, e in flags.items()],
                     F.when(F.col(target) == positive, 1).otherwise(0).alias("_hit"))
    combos = base.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.sum("_hit").alias("k"))
    overall = combos.select(F.try_divide(F.sum("k"), F.sum("n"))).scalar()
    grouped = combos.cube(*names) if mode == "cube" else combos.rollup(*names)
    res = grouped.agg(F.grouping_id().alias("gid"), F.sum("n").alias("n"), F.sum("k").alias("k"))
    rate = F.col("k") / F.col("n")
    return res.select(*names, F.col("gid").cast("long").alias("gid"),
                      F.col("n").cast("long").alias("n"), F.col("k").cast("long").alias("k"),
                      F.round(rate, 6).alias("rate"), F.round(F.try_divide(rate, overall), 6).alias("lift"))

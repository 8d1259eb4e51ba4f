"""Classifier, language identification, mixing: held-out accuracy and brute force."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attrition.llm import language_id, mixing, quality

SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    out = language_id.op5_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    unseen = out[out.held_out]
    assert len(out) == 1000 and len(unseen) > 250
    assert (unseen.lang_pred == unseen.lang).mean() > 0.98
    assert out.score.between(0, 1).all()


def test_language_counts_and_backoff(spark):
    docs = spark.createDataFrame([("aa bb aa", "x"), ("cc", "y"), (None, "x"), ("zz", None), ("dd", "y")], "text string, lang string")
    m = language_id.train(docs, longest=3)
    assert m.languages == ["x", "y"] and set(m.words) == {"aa", "bb", "cc", "dd"}
    mean = lambda w: m.table[m.rows_of(w)].mean(axis=0)
    gram = lambda g: m.table[m.grams[len(g)][g]]
    assert mean("aa").tolist() == pytest.approx([np.log(2.5 / (3 + 2 + 1)), np.log(0.5 / (2 + 2 + 1))])
    assert set(m.grams[3]) == {"^aa", "aa$", "^bb", "bb$", "^cc", "cc$", "^dd", "dd$"}
    assert np.allclose(mean("aae"), gram("^aa"))  # the only known one of three characters
    assert np.allclose(mean("eae"), (gram("a") + gram("^") + gram("$")) / 3)
    assert m.predict("aa aae")[0] == "x" and m.predict("ccc")[0] == "y"
    kept = language_id.train(docs, words=1, grams=1, longest=1)
    assert set(kept.words) == {"aa", "cc"}  # ties by spelling


def test_language_kept_words_have_every_count(spark):
    docs = spark.createDataFrame([("aa aa aa bb bb", "x"), ("bb", "y")], "text string, lang string")
    m = language_id.train(docs, words=1, grams=1, longest=1)
    assert set(m.words) == {"aa", "bb"}  # "bb" is kept by y, below the cut of x
    assert m.table[m.words["bb"]].tolist() == pytest.approx([np.log(2.5 / (5 + 2 + 1)), np.log(1.5 / (1 + 1 + 1))])


def test_language_edges(nasty_docs, no_docs, nasty_rows):
    m = language_id.train(nasty_docs.where("source = 'a' or source is null"))
    got = language_id.identify(nasty_docs, m).collect()
    assert len(got) == len(nasty_rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (75, 76, 77, 78)) and by[82].lang_pred in ("en", "fr")
    nothing = language_id.train(no_docs)
    assert nothing.languages == [] and {r.lang_pred for r in language_id.identify(nasty_docs, nothing).collect()} == {"und"}
    assert language_id.identify(no_docs, m).collect() == []


def test_quality_rejects_toxic_and_keeps_clean(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), quality.graded(spark.read.parquet(f"{d}/labels.parquet"))
    fold = F.col("doc_id") % 4 == 0
    model = quality.train(docs, labels.where(~fold), top=2)
    out = quality.score(docs.join(labels.where(fold & F.col("grade").isNotNull()), "doc_id"), model, select=2).select("row.grade", "expected_grade", "kept").toPandas()
    kept, mean = out.groupby("grade").kept.mean(), out.groupby("grade").expected_grade.mean()
    assert kept[2] > 0.97 and kept[0] < 0.15 and kept[1] < 0.2
    assert mean[0] < mean[1] < mean[2]
    assert model.thresholds[0] < model.thresholds[1]


def test_quality_labels_without_documents_use_up_nothing(spark):
    docs = spark.createDataFrame([(i, "bad words" if i % 2 else "good words") for i in range(20)], "doc_id long, text string")
    rated = spark.range(5_000).select(F.col("id").alias("doc_id"), (1 - F.col("id") % 2).cast("int").alias("grade"))
    out = quality.score(docs, quality.train(docs, rated, top=1, most=20), select=1).select("row.doc_id", "kept").collect()
    assert len(out) == 20 and all(r.kept == (r.doc_id % 2 == 0) for r in out)


def test_quality_gradient():
    """A fit of a small table reaches a stationary point of the penalised likelihood (finite differences)."""
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 8, 4)) for _ in range(60)]
    y = [int(0 in r) + int(1 in r) for r in rows]
    m = quality.fit(rows, y, 2, 3, steps=4000, ridge=1e-2, rate=0.02)

    def loss(w, t):
        total = 0.0
        for r, g in zip(rows, y, strict=True):
            p = [1.0, *quality.sigmoid(w[r].sum() - t), 0.0]
            total -= np.log(p[g] - p[g + 1])
        return total / len(rows) + 5e-3 * (w * w).sum()

    at = loss(m.weights, m.thresholds)
    for k in range(8):
        step = np.zeros(8)
        step[k] = 1e-3
        assert loss(m.weights + step, m.thresholds) >= at - 1e-5 and loss(m.weights - step, m.thresholds) >= at - 1e-5
    for k in range(2):
        step = np.zeros(2)
        step[k] = 1e-3
        assert loss(m.weights, m.thresholds + step) >= at - 1e-5 and loss(m.weights, m.thresholds - step) >= at - 1e-5


def test_quality_edges(spark, nasty_docs, no_docs, nasty_rows):
    none = spark.createDataFrame([(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(75, 0, 1), (76, 0, 1)], "doc_id long, quality int, toxic int")
    for labels, all_kept in ((none, True), (one, True), (some, False)):
        out = quality.score(nasty_docs, quality.train(nasty_docs, quality.graded(labels), top=2), select=2).collect()
        assert len(out) == len(nasty_rows) and (not all_kept or all(r.kept for r in out))
    model = quality.train(nasty_docs, quality.graded(some), top=2)
    assert quality.score(no_docs, model, select=2).collect() == [] and quality.train(no_docs, quality.graded(some), top=2).weights.sum() == 0
    assert quality.score(nasty_docs, model, select=2).select("row.*").columns == nasty_docs.columns


def ipf(cells, targets, sweeps=2000):
    w = np.array([c[-1] for c in cells], dtype=float)
    for _ in range(sweeps):
        for d, share in enumerate(targets):
            for level, s in share.items():
                at = np.array([c[d] == level for c in cells])
                if w[at].sum():
                    w[at] *= s / w[at].sum()
    return w


def test_rake_equals_ipf(spark):
    rng = random.Random(6)
    cells = [(a, b, rng.randint(1, 90)) for a in "xyz" for b in "pq" if (a, b) != ("z", "q")]
    shares = [{"x": 0.2, "y": 0.5, "z": 0.3}, {"p": 0.6, "q": 0.4}]
    df = spark.createDataFrame(cells, "a string, b string, tokens long")
    t = {d: spark.createDataFrame([(k, 10 * v) for k, v in s.items()] + [("absent", 5.0)], f"{d} string, share double") for d, s in zip("ab", shares, strict=True)}
    got = {(r.a, r.b): r.weight for r in mixing.rake(df, t).collect()}
    for c, w in zip(cells, ipf(cells, shares), strict=True):
        assert got[c[:2]] == pytest.approx(w, abs=1e-6)


def test_mix(spark, nasty_docs, nasty_rows, no_docs):
    out = mixing.mix(nasty_docs, ["source", "lang"]).select("row.doc_id", "levels.source", "levels.lang", "tokens", "probability", "drawn").toPandas()
    assert len(out) == len(nasty_rows) and out.probability.max() == pytest.approx(1.0)
    by = {i: t for i, t, *_ in nasty_rows}
    for r in out.itertuples():
        assert r.tokens == len((by.get(None if np.isnan(r.doc_id) else int(r.doc_id)) or "").replace(" ", "_").replace("\x1c", "_").split())
    spent = out.assign(source=out.source.fillna("-"), w=out.tokens * out.probability).groupby("source").w.sum()
    goal = out.assign(source=out.source.fillna("-")).groupby("source").tokens.sum() ** 0.8
    assert np.allclose(spent / spent.sum(), goal / goal.sum(), atol=1e-5)
    again = mixing.mix(nasty_docs.repartition(5), ["source", "lang"]).select("row.doc_id", "drawn").toPandas()
    assert set(again[again.drawn].doc_id.dropna()) == set(out[out.drawn].doc_id.dropna())
    assert mixing.mix(no_docs, ["source", "lang"]).collect() == []
    assert mixing.mix(nasty_docs.where("doc_id in (75, 76)"), ["source"]).where("not drawn").collect() == []  # no tokens at all


def test_mix_draws_at_the_probability(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") % 10 == 0, "rare").otherwise("hot").alias("source"))
    want = spark.createDataFrame([("rare", 0.25), ("hot", 0.75)], "source string, share double")
    out = mixing.mix(docs, ["source"], {"source": want}).groupBy("levels.source").agg(F.avg("probability").alias("p"), F.avg(F.col("drawn").cast("int")).alias("drawn")).collect()
    p = {r.source: (r.p, r.drawn) for r in out}
    assert p["rare"] == (1.0, 1.0) and p["hot"][0] == pytest.approx(1 / 3) and p["hot"][1] == pytest.approx(1 / 3, abs=0.015)


def test_mix_budget_is_not_set_by_a_tiny_cell(spark):
    many = spark.range(3_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 20).alias("text"), F.when(F.col("id") % 10 == 0, "rare").otherwise("hot").alias("source"))
    tiny = spark.createDataFrame([(9_999, "nine words are here and no more of them", "new")], "doc_id long, text string, source string")
    kept = []
    for docs in (many, many.unionByName(tiny)):
        out = mixing.mix(docs, ["source"], power=0.8, keep=mixing.KEEP).select("levels.source", "tokens", "probability").toPandas()
        kept.append((out.tokens * out.probability).sum() / out.tokens.sum())
        p = out.groupby("source").probability.agg(["min", "max"])
        assert (p["min"] == p["max"]).all() and p["max"].max() <= 1 and p["max"]["rare"] > p["max"]["hot"]
    assert kept == pytest.approx([mixing.KEEP] * 2) and p["max"]["new"] == 1


def test_registered_mixing_keeps_the_budget(spark):
    out = mixing.op4_mixing(spark, "/root/testdata/sf0.001").toPandas()
    assert (out.tokens * out.probability).sum() / out.tokens.sum() == pytest.approx(mixing.KEEP)


def bounded_ipf(cells, goals, sweeps=3000):
    """Tokens times a factor of each level, up to the cell's tokens: every level's factor in turn by bisection."""
    cap = np.array([c[-1] for c in cells], dtype=float)
    w = cap * sum(goals[0].values()) / cap.sum()
    for _ in range(sweeps // 100):
        for d, goal in enumerate(goals):
            for level, g in goal.items():
                at = np.array([c[d] == level for c in cells])
                low, high = 1e-12, 1e12
                for _ in range(200):
                    f = (low * high) ** 0.5
                    low, high = (f, high) if np.minimum(cap, w * f)[at].sum() < g else (low, f)
                w[at] *= low
    return np.minimum(cap, w)


def test_rake_within_the_tokens_of_each_cell(spark):
    """Cells that lack tokens are full, and the margins hold by the others."""
    rng = random.Random(9)
    cells = [(a, b, rng.choice([3, 10, 400, 2000])) for a in "vwxyz" for b in "pqrs"]
    df = spark.createDataFrame(cells, "a string, b string, tokens long")
    targets = {d: mixing.tempered(df, d, 0.6) for d in "ab"}
    weight, report = mixing.calibrate(df, targets, keep=0.8)
    got = {(r.a, r.b): r.weight for r in weight.collect()}
    known = mixing._targets(df, targets)
    budget, goals = mixing.reachable(known, 0.8)
    assert budget == pytest.approx(0.8 * sum(c[-1] for c in cells))
    goals = [{r[d]: r.goal for r in goals[d].collect()} for d in "ab"]
    want = bounded_ipf(cells, goals)
    assert sum(w >= c[-1] * (1 - 1e-9) for w, c in zip(want, cells)) >= 2  # some are full
    for c, w in zip(cells, want, strict=True):
        assert got[c[:2]] == pytest.approx(w, rel=1e-3, abs=1e-2) and got[c[:2]] <= c[-1] * (1 + 1e-12)
    for r in report.collect():
        at = [c["ab".index(r.dimension)] == r.level for c in cells]
        assert r.got == pytest.approx(want[at].sum() / budget, abs=1e-4)


def test_targets_beyond_a_level_are_reported_or_lower_the_budget(spark):
    """Sources of 9000, 900 and 100 tokens: at 0.8 the small ones are taken whole and the report says so; held, all targets are reached."""
    df = spark.createDataFrame([("big", 9000), ("mid", 900), ("rare", 100)], "source string, tokens long")
    want = {"source": spark.createDataFrame([("big", 0.843), ("mid", 0.134), ("rare", 0.023)], "source string, share double")}
    _, report = mixing.calibrate(df, want, keep=0.8)
    rows = {r.level: (round(r.target, 4), round(r.reachable, 4), round(r.got, 4)) for r in report.collect()}
    assert rows == {"big": (0.843, 0.875, 0.875), "mid": (0.134, 0.1125, 0.1125), "rare": (0.023, 0.0125, 0.0125)}
    weight, report = mixing.calibrate(df, want, keep=0.8, hold=True)
    assert all(r.got == pytest.approx(r.target, abs=1e-7) for r in report.collect())
    assert sum(r.weight for r in weight.collect()) == pytest.approx(100 / 0.023)


def test_registered_mixing_reaches_what_can_be_reached(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    df = docs.select("source", "lang", mixing.topic(F.col("text")).alias("topic"), mixing.word_tokens(F.col("text")).alias("tokens"))
    cells = df.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"))
    _, report = mixing.calibrate(cells, {d: mixing.tempered(cells, d, 0.8) for d in ("source", "lang", "topic")}, keep=mixing.KEEP)
    assert max(abs(r.got - r.reachable) for r in report.collect()) < 0.002

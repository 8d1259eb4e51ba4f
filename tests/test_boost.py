"""The search's fits on counted rows: the same trees as MLlib's, few jobs, and nothing but what the rows say."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from attrition.operators import boost as B
from attrition.operators import model as M
from attrition.session import scratch_path

FEATS = ["a", "b", "c", "d", "same"]
POINT = {"max_depth": [2, 4], "eta": [0.1], "subsample": [1.0], "colsample_bytree": [1.0]}


@pytest.fixture(scope="module")
def folded(spark):
    """Copies, nulls, NaN, a constant, and a weight for each class."""
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=900).round(2), rng.integers(0, 40, 900).astype(float)
    b[::17] = np.nan
    y = (a + b % 7 / 5 + rng.normal(size=900) > 1).astype(int)
    t = pd.DataFrame({"a": a, "b": b, "c": rng.integers(0, 2, 900), "d": rng.integers(-1, 3, 900), "same": 1, "y": y, "w": np.where(y == 1, 2.5, 1.0), "f": rng.integers(0, 3, 900)})
    t = spark.createDataFrame(pd.concat([t, t[:200]]))
    return t.withColumn("a", F.when(F.col("d") != 2, F.col("a"))).repartition(3).persist()


def aucs(df, grid, **run):
    path = M.search_gbt(df, FEATS, "y", grid, fold_col="f", weight="w", **run)
    return {(r.point, r.fold, r["round"]): r.auc for r in M.search_results(df.sparkSession, path).collect()}


def test_counted_rows_give_the_trees_of_mllib(spark, folded, monkeypatch):
    mine = aucs(folded, POINT, max_rounds=6)
    monkeypatch.setattr(B, "GROUPS", 10)  # more counted rows than a task may hold: each fit is MLlib's
    theirs = aucs(folded, POINT, max_rounds=6)
    assert len(mine) == 2 * 3 * 6 and mine == pytest.approx(theirs, abs=1e-9)


def test_search_takes_one_job_a_fit(spark, folded):
    """MLlib runs some jobs for each level of each tree."""
    tracker, jobs = spark.sparkContext.statusTracker(), []
    table = B.binned(folded, FEATS, "y", "f", "w")
    shared = B.Shared(spark, table)
    spark.sparkContext.setJobGroup("one fit", "one fit")
    try:
        fit = M.train_gbt(shared.without(1), FEATS, "y", {"max_depth": 4, "rounds": 20}, "w", 123)
        jobs = tracker.getJobIdsForGroup("one fit")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        shared.drop()
    assert len(jobs) == 1 and len(fit.trees) == len(fit.aucs) == 20


def test_copies_are_counted_once_and_order_does_not_matter(spark, folded):
    one, many = B.binned(folded, FEATS, "y", "f", "w"), B.binned(folded.union(folded).union(folded).repartition(5), FEATS, "y", "f", "w")
    assert len(one.n) == len(many.n) and (many.n == 3 * one.n).all() and one.n.sum() == folded.count()
    args = 4, 0.1, 0.7, 0.7, 5, 123
    again = B.binned(folded.repartition(7), FEATS, "y", "f", "w")
    assert B.fit(B.Rows(one, 0), *args).aucs == B.fit(B.Rows(again, 0), *args).aucs


def test_a_fit_goes_on_where_it_stood(spark, folded):
    rows = B.Rows(B.binned(folded, FEATS, "y", "f", "w"), 2)
    args = 4, 0.1, 0.8, 0.8
    whole, part = B.fit(rows, *args, 9, 7), B.fit(rows, *args, 4, 7)
    on = B.fit(rows, *args, 9, 7, part)
    assert on.aucs == pytest.approx(whole.aucs, abs=1e-12) and part.aucs == whole.aucs[:4] and len(part.trees) == 4


def test_samples_are_drawn_row_by_row():
    """A counted row of n is a binomial sample; the share of the rows in a tree is ``subsample``."""
    n = 4000
    table = B.Binned([0, 1], [(0.0, 1.0), (1.0, 1.0)], [np.array([0.5])], [[np.array([0.5])]] * 2, np.array([0, 0, 1, 1], np.uint8),
                     np.array([0, 1, 0, 1], np.uint8), [np.array([0, 1, 0, 1], np.uint8)], np.array([n, n, 5, 5]))
    seen = []
    grow, B.grow = B.grow, lambda rows, target, count, *rest: seen.append(count) or grow(rows, target, count, *rest)
    try:
        B.fit(B.Rows(table, 1), 2, 0.1, 0.7, 1.0, 50, 1)
    finally:
        B.grow = grow
    shares = np.array(seen) / n
    assert abs(shares.mean() - 0.7) < 0.003 and 0.003 < shares.std() < 0.012


@pytest.mark.parametrize("patience", [1, 3])
def test_patience_ends_the_fits_but_changes_no_result(spark, folded, monkeypatch, patience):
    monkeypatch.setattr(M, "BLOCK", 5)
    grid = POINT | {"eta": [1.0]}
    whole = aucs(folded, grid, max_rounds=20)
    ended = aucs(folded, grid, max_rounds=20, patience=patience)
    assert len(ended) < len(whole) and all(abs(whole[k] - v) < 1e-12 for k, v in ended.items())

    def best(found):
        rows = [(r, a, p, f) for (p, f, r), a in found.items()]
        return [(r.max_depth, r.best_round, round(r.mean_auc, 9), r.is_best) for r in M.best_rounds(spark.createDataFrame(rows, M.RESULTS), grid, patience).collect()]

    assert best(ended) == best(whole)


def test_stop_round_is_that_of_the_scan(spark):
    rng = np.random.default_rng(2)
    for k in range(6):
        folds = [[float(x) if rng.random() >= 0.1 * k else None for x in rng.normal(0.7, 0.1, 25)] for _ in range(2)]
        rows = [(r, a) for f in folds for r, a in enumerate(f, 1)]
        means = spark.createDataFrame(rows, "round int, auc double").groupBy("round").agg(F.avg("auc").alias("mean_auc"))
        kept = M._stopped(means, [], 4).agg(F.max("round")).first()[0]
        assert (M.stop_round(folds, 4) or 25) == kept


def test_search_goes_on_within_a_point(spark, folded, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 2)
    root, real, fits = scratch_path(spark, "search-test"), M.train_gbt, []
    run = dict(max_rounds=8, patience=20, root=root, parallelism=1)

    def ending(part, features, target, params, *rest):
        fits.append(params["rounds"])
        if len(fits) == 5:
            raise RuntimeError("ended")
        return real(part, features, target, params, *rest)

    monkeypatch.setattr(M, "train_gbt", ending)
    with pytest.raises(RuntimeError):
        aucs(folded, POINT | {"max_depth": [4]}, **run)
    assert fits == [2, 2, 2, 4, 4, 4]
    monkeypatch.setattr(M, "train_gbt", lambda part, features, target, params, *rest: fits.append(params["rounds"]) or real(part, features, target, params, *rest))
    got = aucs(folded, POINT | {"max_depth": [4]}, **run)
    assert sorted(fits[6:]) == [4, 8, 8, 8]  # two folds had four rounds
    assert got == pytest.approx(aucs(folded, POINT | {"max_depth": [4]}, max_rounds=8), abs=1e-12)
    assert aucs(folded, POINT | {"max_depth": [4]}, **run) == got and len(fits) == 10 + 3  # the three are of the whole search above


def test_what_the_learner_does_not_take_is_left_to_mllib(spark, folded):
    assert B.binned(folded.withColumn("y", F.col("y") + 1), FEATS, "y", "f", "w") is None
    assert B.binned(folded.withColumn("w", F.lit(-1.0)), FEATS, "y", "f", "w") is None
    assert B.binned(folded.withColumn("c", F.col("c").cast("string")), FEATS, "y", "f", "w") is None
    assert B.binned(folded.where("f = 1"), FEATS, "y", "f", "w") is None


def test_a_whole_fit_is_the_model_that_mllib_fits(spark, folded, tmp_path):
    from pyspark.ml import PipelineModel
    rows, params = folded.fillna(0, subset=FEATS), {"max_depth": 4, "rounds": 6, "subsample": 1.0, "colsample_bytree": 1.0}
    spark.sparkContext.setJobGroup("counted", "counted")
    mine = M.train_counted(rows, FEATS, "y", params, "w")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    theirs = M.train_gbt(rows, FEATS, "y", params, "w")
    assert jobs < 20

    def scored(model):
        return rows.transform(lambda d: M.positive_probability(model.transform(d))).select(*FEATS, "proba").orderBy(*FEATS).toPandas()

    assert np.allclose(scored(mine), scored(theirs), atol=1e-9)
    one, two = (M.feature_importance(m, FEATS).orderBy("rank").collect() for m in (mine, theirs))
    assert [(r.feature, pytest.approx(r.gain, abs=1e-5), pytest.approx(r.cover, abs=1e-5)) for r in one] == [(r.feature, r.gain, r.cover) for r in two]
    mine.write().save(str(tmp_path / "m"))
    assert np.allclose(scored(PipelineModel.load(str(tmp_path / "m"))), scored(mine))
    assert M.gbt_stage(mine).getMaxDepth() == 4 and M.gbt_stage(mine).getNumTrees == 6


def test_a_tuned_model_is_fitted_as_the_search_fits(spark, monkeypatch):
    from attrition.plans import training as TR
    from attrition.plans.catalog import prepared

    from .conftest import SF_SMALL
    taken = []
    monkeypatch.setattr(M, "train_counted", lambda *a, **k: taken.append(a[3]["rounds"]) or M.train_gbt(*a, **k))
    fit, search = TR.fit_tuned(prepared(spark, SF_SMALL), POINT, folds=2, max_rounds=2, patience=2)
    best = search.where("is_best").first()
    assert taken == [best.best_round] * 2 and 0 < TR.scored(fit.test, fit.artifacts).agg(F.avg("proba")).first()[0] < 1


def test_pure_leaves_are_equal():
    """Leaves of one class only have the same value, whichever side of a split they are on."""
    rng = np.random.default_rng(3)
    code = rng.integers(0, 24, 300).astype(np.uint8)
    cls = ((code % 5 < 2) & (rng.random(300) < 0.97)).astype(np.uint8)
    cuts = [np.arange(23) + 0.5]
    table = B.Binned([0, 1], [(0.0, 1.0), (1.0, 2.846153846153846)], cuts, [cuts] * 2, np.zeros(300, np.uint8), cls, [code], np.ones(300, dtype=np.int64))
    tree = B.fit(B.Rows(table, 1), 6, 0.1, 1.0, 1.0, 1, 1).trees[0]
    leaves = tree["value"][tree["left"] < 0]
    pure = leaves[np.abs(leaves) > 1 - 1e-9]
    assert len(pure) > 4 and set(pure) == {-1.0, 1.0}

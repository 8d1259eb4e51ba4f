"""Mergeable profiles against exact ones."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from attrition.operators import sketch as SK
from attrition.operators.profile import profile_numeric
from attrition.session import scratch_path


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    n = 40_000
    rows = zip(rng.integers(0, 4, n).tolist(), rng.normal(size=n).tolist(), np.where(rng.random(n) < 1 / 3, 0.0, rng.integers(-50, 500, n)).tolist(),
               [None if x < 0.1 else float(x) for x in rng.random(n)])
    return spark.createDataFrame(list(rows), "day int, x double, hot double, holes double").repartition(4).cache()


def test_merged_partitions_equal_the_whole(spark, data):
    cols = ["x", "hot", "holes"]
    whole = {r.variable: r for r in SK.read_profiles(SK.sketch_profiles(data, cols)).collect()}
    parts = SK.sketch_profiles(data, cols, ["day"])
    assert parts.count() == 12
    merged = {r.variable: r for r in SK.read_profiles(SK.merge_profiles(parts)).collect()}
    exact = {r.variable: r for r in profile_numeric(data, cols).collect()}
    for c in cols:
        values = np.array([r[0] for r in data.select(c).where(f"{c} is not null").collect()])
        for got in (whole[c], merged[c]):
            assert (got.n, got.zero, got.minus) == (exact[c].n, exact[c].zero, exact[c].minus) and got.missing == data.count() - len(values)
            assert got.min == values.min() and got.max == values.max() and got.mean == pytest.approx(values.mean())
            assert got.unique_count == pytest.approx(len(np.unique(values)), rel=0.08)
            for q, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
                assert (values < got[q]).mean() - SK.rank_error() <= p <= (values <= got[q]).mean() + SK.rank_error()
            assert abs(got.outlier - exact[c].outlier) <= 4 * SK.rank_error() * got.n


def test_a_day_that_is_read_again_replaces_itself(spark, data):
    path = scratch_path(spark, "sketch-test")
    SK.store_profiles(data.where("day < 3"), ["x"], path, "day")
    SK.store_profiles(data.where("day in (2, 3)"), ["x"], path, "day")
    assert SK.stored_profile(spark, path).first().n == data.count()
    assert SK.stored_profile(spark, path, "day = 1").first().n == data.where("day = 1").count()


def test_profiles_without_values(spark, data):
    none = SK.read_profiles(SK.sketch_profiles(data.select(F.lit(None).cast("double").alias("x")), ["x"])).first()
    assert (none.n, none.missing, none.q1, none.outlier, none.unique_count) == (0, data.count(), None, None, 0)
    assert SK.read_profiles(SK.sketch_profiles(data.limit(0), ["x"])).collect() == []
    assert SK.read_profiles(SK.sketch_profiles(data.select(F.lit(3).alias("x")), ["x"])).first().outlier == 0


def test_approximate_profile_reads_the_rows_once(spark, data):
    approx = {r.variable: r for r in profile_numeric(data, ["x", "hot"], approx=True).collect()}
    exact = {r.variable: r for r in profile_numeric(data, ["x", "hot"]).collect()}
    for c, r in approx.items():
        assert (r.n, r.min, r.max, r["mean"], r.zero, r.minus) == (exact[c].n, exact[c].min, exact[c].max, exact[c]["mean"], exact[c].zero, exact[c].minus)
    plan = profile_numeric(data.sparkSession.range(9).select(F.col("id").alias("x")), ["x"], approx=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 9") == 1 and plan.count("Aggregate") == 1

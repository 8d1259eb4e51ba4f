"""Randomised properties (hypothesis, few examples: each runs Spark jobs)."""
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attrition.operators import evaluate as EV
from attrition.operators.rank import mid_ranks

pairs = st.lists(st.tuples(st.integers(0, 12), st.integers(0, 1)), min_size=4, max_size=60) \
    .filter(lambda xs: 0 < sum(y for _, y in xs) < len(xs))


@settings(max_examples=5, deadline=None)
@given(pairs)
def test_auc_is_pair_count_and_rank_invariant(spark, xs):
    df = spark.createDataFrame([(float(s), y) for s, y in xs], "s double, y int")
    pos = [s for s, y in xs if y == 1]
    neg = [s for s, y in xs if y == 0]
    u = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    a = EV.auc(df, "s", "y").first()["auc"]
    assert abs(a - round(u / (len(pos) * len(neg)), 6)) < 1e-9
    b = EV.auc(df.withColumn("s", F.col("s") * 3 + 1), "s", "y").first()["auc"]
    assert a == b


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=80))
def test_mid_ranks_sum(spark, xs):
    df = spark.createDataFrame([(float(v),) for v in xs], "x double")
    total = sum(r["n"] * r["mid_rank"] for r in mid_ranks(df, ["x"]).collect())
    n = len(xs)
    assert abs(total - n * (n + 1) / 2) < 1e-9


def test_scaler_maps_train_into_unit_interval(spark):
    from attrition.config import FEATURES
    from attrition.operators import encode as E
    from attrition.operators import scale as SC
    from attrition.sources.fixture import customers_raw
    df = E.prepare_features(customers_raw(spark, "/root/testdata/sf0.001"))
    scaled = SC.apply_range_scaler(df, SC.fit_range_scaler(df, FEATURES), FEATURES)
    r = scaled.agg(*[F.min(f).alias(f"lo_{f}") for f in FEATURES], *[F.max(f).alias(f"hi_{f}") for f in FEATURES]).first()
    for f in FEATURES:
        assert r[f"lo_{f}"] >= 0.0 and r[f"hi_{f}"] <= 1.0


def test_operators_unchanged_under_repartition(spark):
    from attrition.operators import profile as P
    from attrition.operators import stat_tests as ST
    base = spark.range(0, 2000).select((F.col("id") % 13).cast("double").alias("x"),
                                       (F.col("id") % 5).cast("string").alias("v"),
                                       (F.col("id") % 3 == 0).cast("int").alias("y"))

    def results(df):
        return (sorted(tuple(r) for r in ST.chi_square(df, ["v"], "y", with_p=False).collect()),
                sorted(tuple(r) for r in ST.mann_whitney(df, ["x"], "y", with_p=False).collect()),
                sorted(tuple(r) for r in P.profile_numeric(df, ["x"]).collect()))
    ref = results(base)
    for n in (1, 7, 200):
        assert results(base.repartition(n)) == ref

"""Edge cases: constant column, single level, all ties, one class, empty
table, all-null column — no ANSI errors, defined results."""
from attrition.operators import evaluate as EV
from attrition.operators import profile as P
from attrition.operators import scale as SC
from attrition.operators import stat_tests as ST
from attrition.operators.rank import mid_ranks


def test_constant_column_profile_and_scaler(spark):
    df = spark.createDataFrame([(5.0,)] * 9 + [(None,)], "x double")
    r = P.profile_numeric(df, ["x"]).first()
    assert (r["n"], r["min"], r["q1"], r["median"], r["q3"], r["max"], r["outlier"]) == (9, 5, 5, 5, 5, 5, 0)
    sc = SC.fit_range_scaler(df, ["x"])
    out = [r["x"] for r in SC.apply_range_scaler(df, sc, ["x"]).collect()]
    assert sorted(out, key=lambda v: (v is None, v)) == [0.0] * 9 + [None]


def test_single_level_and_one_class(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("a", 1)], "v string, y int")
    r = ST.chi_square(df, ["v"], "y").first()
    assert r["df"] == 0 and r["cramers_v"] is None
    one = spark.createDataFrame([(0.1, 1), (0.5, 1)], "s double, y int")
    assert EV.auc(one, "s", "y").first()["auc"] is None


def test_all_ties_mann_whitney(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 1), (1.0, 0), (1.0, 1)], "x double, y int")
    r = ST.mann_whitney(df, ["x"], "y").first()
    assert r["u"] == 2.0 and r["rank_biserial"] == 0.0 and r["z"] is None


def test_empty_table(spark):
    df = spark.createDataFrame([], "x double, v string, y int")
    assert P.profile_categorical(df, ["v"]).count() == 0
    assert P.category_by_target(df, ["v"], "y").count() == 0
    assert ST.chi_square(df, ["v"], "y").count() == 0
    assert mid_ranks(df, ["x"]).count() == 0


def test_all_null_column_profile(spark):
    df = spark.createDataFrame([(None, 1), (None, 2)], "a string, b int")
    rows = {r["variable"]: r for r in P.profile_columns(df).collect()}
    assert rows["a"]["missing_count"] == 2 and rows["a"]["unique_count"] == 1
    assert rows["b"]["missing_count"] == 0 and rows["b"]["unique_count"] == 2
    approx = {r["variable"]: r for r in P.profile_columns(df, approx=True).collect()}
    assert approx["a"]["unique_count"] == 1

from pyspark.sql import functions as F

from attrition.config import FEATURES
from attrition.operators import encode as E


def test_recode_yes_no_is_data_dependent(spark):
    df = spark.createDataFrame(
        [("Yes", "No", None, "Yes"), ("No", "Maybe", None, None), ("No", "No", None, "No")],
        "a string, b string, c string, d string")
    out = E.recode_yes_no(df).collect()
    assert [r["a"] for r in out] == [1, 0, 0]
    assert [r["b"] for r in out] == ["No", "Maybe", "No"]      # other values: untouched
    assert [r["c"] for r in out] == [None, None, None]          # all-null: untouched (string)
    assert [r["d"] for r in out] == [1, None, 0]                # null stays null
    assert dict(E.recode_yes_no(df).dtypes)["c"] == "string"


def test_one_hot_levels_sorted_and_null_level(spark):
    df = spark.createDataFrame([("x", 1), ("y", 2), (None, 3)], "v string, id int")
    out = E.one_hot(df, ["v"], null_level=True)
    assert out.columns == ["id", "v_x", "v_y", "v_NA"]
    rows = {r["id"]: (r["v_x"], r["v_y"], r["v_NA"]) for r in out.collect()}
    assert rows == {1: (1, 0, 0), 2: (0, 1, 0), 3: (0, 0, 1)}
    fixed = E.one_hot(df, ["v"], vocab={"v": ["y", "z"]})
    assert fixed.columns == ["id", "v_y", "v_z"]


def test_coalesce_services_order(spark):
    cols = ["s1", "s2"]
    df = spark.createDataFrame([("No internet service", "No internet service"), ("Yes", "No"),
                                ("No", "No"), ("No internet service", "Yes")], "s1 string, s2 string")
    got = [r["ServiceSup"] for r in E.coalesce_services(df, cols).collect()]
    assert got == ["No internet service", "Yes", "No", "Yes"]


def _raw(spark, rows):
    from attrition.sources.fixture import RAW_COLUMNS
    schema = ("customerID string, gender string, SeniorCitizen int, Partner string, Dependents string, "
              "tenure int, PhoneService string, MultipleLines string, InternetService string, "
              "OnlineSecurity string, OnlineBackup string, DeviceProtection string, TechSupport string, "
              "StreamingTV string, StreamingMovies string, Contract string, PaperlessBilling string, "
              "PaymentMethod string, MonthlyCharges double, TotalCharges double, Churn string")
    df = spark.createDataFrame(rows, schema)
    assert df.columns == RAW_COLUMNS
    return df


def test_prepare_features_contract(spark):
    nis = "No internet service"
    rows = [
        ("A", "Male", 1, "Yes", "No", 5, "No", "No phone service", "No", nis, nis, nis, nis, nis, nis,
         "Month-to-month", "Yes", "Electronic check", 20.0, 100.0, "Yes"),
        ("B", "Female", 0, "No", "Yes", 40, "Yes", "No", "Fiber optic", "Yes", "No", "No", "No", "No", "No",
         "Two year", "No", "Bank transfer (automatic)", 90.5, None, "No"),
        ("C", "Female", 0, "No", "No", 0, "Yes", "Yes", "DSL", "No", "No", "No", "No", "No", "No",
         "One year", "No", "Mailed check", 50.0, None, "No"),
    ]
    out = {r["customerID"]: r.asDict() for r in E.prepare_features(_raw(spark, rows)).collect()}
    assert list(E.prepare_features(_raw(spark, rows)).columns) == ["customerID", *FEATURES, "Churn"]
    a, b, c = out["A"], out["B"], out["C"]
    assert (a["gender"], b["gender"]) == (1, 0)                           # Male = 1
    assert a["MultipleLines_No"] == 0                                      # no phone → 0
    assert (a["No_Internet_Service"], a["ServiceSup_No"], a["ServiceSup_Yes"]) == (1, 0, 0)
    assert (b["ServiceSup_Yes"], c["ServiceSup_No"]) == (1, 1)
    assert (b["Contract_Two_year"], c["Contract_One_year"], a["Contract_Month_to_month"]) == (1, 1, 1)
    assert a["Churn"] == 1 and b["Churn"] == 0
    # every one-hot group sums to one where the level is in the vocabulary
    for r in out.values():
        assert sum(r[f] for f in FEATURES if f.startswith("Contract_")) == 1
        assert sum(r[f] for f in FEATURES if f.startswith("PaymentMethod_")) == 1


def test_safe_numeric_and_null_policy(spark):
    df = spark.createDataFrame([(" 12.5 ",), ("abc",), (None,)], "t string")
    assert [r["t"] for r in E.safe_numeric(df, ["t"]).collect()] == [12.5, 0.0, 0.0]
    nums = spark.createDataFrame([(1.0,), (None,)], "x double")
    assert [r["x"] for r in E.missing_flags(nums, "zero", ["x"]).collect()] == [1.0, 0.0]
    assert [r["x_missing"] for r in E.missing_flags(nums, "flag", ["x"]).collect()] == [0, 1]


def test_drop_matching_and_select_by_type(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "Churn int, s string, x double")
    assert E.drop_matching(df, "^churn$").columns == ["s", "x"]
    assert E.select_by_type(df, "numeric", target="Churn").columns == ["x"]
    assert E.select_by_type(df, "categorical").columns == ["s"]
    assert F  # noqa

import json
import os

from pyspark.sql import functions as F

from attrition.config import FEATURES
from attrition.session import scratch_path
from attrition.sources import io as IO


def test_json_array_payload_and_corrupt_records(spark, tmp_path):
    good = {"customerID": "X1", **{f: 0 for f in FEATURES}, "tenure": 5, "MonthlyCharges": 20.5}
    path = os.path.join(str(tmp_path), "payload.json")
    with open(path, "w") as fh:
        json.dump([good, {**good, "customerID": "X2", "gender": "x"}], fh)
    df = IO.scan_json_profiles(spark, path, FEATURES)
    rows = {r["customerID"]: r for r in df.collect()}
    assert set(rows) == {"X1", "X2"} and rows["X2"]["gender"] == "x" and rows["X1"]["tenure"] == "5"
    lines = os.path.join(str(tmp_path), "lines")
    os.makedirs(lines)
    with open(os.path.join(lines, "p.json"), "w") as fh:
        fh.write(json.dumps(good) + "\n" + '{"customerID": "X3", "tenure": ' + "\n")
    lf = IO.scan_json_profiles(spark, lines, FEATURES, multi_line=False)
    bad = lf.filter(F.col(IO.CORRUPT).isNotNull()).select("customerID", IO.CORRUPT).collect()
    assert len(bad) == 1 and lf.count() == 2


def test_profiles_column_and_upload_tokens(spark):
    arr = json.dumps([{"customerID": "A", "tenure": 3}, {"customerID": "B", "tenure": 4}])
    df = spark.createDataFrame([(arr,)], "body string")
    out = IO.parse_profiles_column(df, "body", FEATURES)
    assert sorted(r["customerID"] for r in out.collect()) == ["A", "B"]
    path = scratch_path(spark, "upload-io")
    spark.createDataFrame([("a", " NA "), ("b", ""), ("c", " 7 ")], "id string, v string") \
        .write.option("header", True).csv(path)
    up = {r["id"]: r["v"] for r in IO.scan_upload(spark, path).collect()}
    assert up == {"a": None, "b": None, "c": "7"}


def test_sink_predictions_partitioned(spark):
    path = scratch_path(spark, "preds-io")
    df = spark.createDataFrame([("A", 0.5, 1, "x")], "ID_CLIENT string, Churn_Proba double, Churn_Class int, "
                                                     "Commentaire string")
    IO.sink_predictions(df, path, run_date="2026-12-01")
    back = spark.read.option("header", True).csv(path)
    assert back.select("run_date").first()[0] in ("2026-12-01", __import__("datetime").date(2026, 12, 1))


def test_package_shipped_once_per_application(spark):
    from attrition import session
    session.ship_package(spark)
    session.ship_package(spark)
    shipped = [f for f in spark.sparkContext.listFiles if "attrition-pkg-" in f]
    assert len(shipped) == 1 and shipped[0].endswith(".zip")
    assert spark.sparkContext.applicationId in session._SHIPPED

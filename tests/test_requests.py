"""Typed scoring requests: the verdict of a request, its ids, and the stream of requests."""
import json

import pytest
from pyspark.sql import functions as F

from attrition.config import FEATURES
from attrition.operators import encode as E
from attrition.operators import score as SCO
from attrition.plans import training as TR
from attrition.session import scratch_path
from attrition.sources import requests as RQ
from attrition.sources.fixture import customers_raw
from attrition.streaming.score_stream import score_request_stream

from .conftest import SF_SMALL


def profile(**changes):
    p = {f: 0 for f in FEATURES} | {"tenure": 12, "MonthlyCharges": 70.5} | changes
    return {k: v for k, v in p.items() if v != "absent"}


#: name -> (body, rule, columns, ids of its rows if accepted)
CASES = {
    "numbers": ([profile(customerID="a"), profile(customerID="b")], None, [], ["a", "b"]),
    "one object": (profile(id=5), None, [], ["5"]),
    "no ids": ([profile(), profile(), profile()], None, [], ["CLIENT_1", "CLIENT_2", "CLIENT_3"]),
    "id of some": ([profile(), profile(Client_ID="x")], None, [], [None, "x"]),
    "first id column": ([profile() | {"client_id": "x", "ID": "y"}], None, [], ["x"]),
    "true is 1": ([profile(Partner=True, gender=False)], None, [], ["CLIENT_1"]),
    "text 0 and 1 are binary": ([profile(Partner="1", gender="0", Dependents=1.0)], None, [], ["CLIENT_1"]),
    "null tenure beside a number": ([profile(tenure=None), profile(), profile(tenure="absent")], None, [], ["CLIENT_1", "CLIENT_2", "CLIENT_3"]),
    "only null tenures": ([profile(tenure=None), profile(tenure=None)], "tenure", ["tenure"], None),
    "text tenure": ([profile(), profile(tenure="12")], "tenure", ["tenure"], None),
    "boolean tenure": ([profile(tenure=True)], "tenure", ["tenure"], None),
    "nested tenure": ([profile(tenure=[12])], "tenure", ["tenure"], None),
    "tenure 0": ([profile(tenure=0)], None, [], ["CLIENT_1"]),
    "negative tenure": ([profile(), profile(tenure=-0.5)], "tenure", ["tenure"], None),
    "tenure before charges": ([profile(MonthlyCharges=-1), profile(tenure=-1)], "tenure", ["tenure"], None),
    "charges 0": ([profile(MonthlyCharges=0, gender=7)], "MonthlyCharges", ["MonthlyCharges"], None),
    "binary 2 and null": ([profile(gender=2), profile(Partner=None), profile(Dependents="yes")], "binary", ["gender", "Partner", "Dependents"], None),
    "text 1.0": ([profile(gender="1.0")], "binary", ["gender"], None),
    "absent in one": ([profile(), profile(gender="absent")], "binary", ["gender"], None),
    "absent in all": ([profile(gender="absent", tenure="absent"), profile(gender="absent", tenure="absent")], "missing_columns", ["gender", "tenure"], None),
    "extra columns": ([profile(pos=1, request="x", _v=3, note={"a": [1, 2]})], None, [], ["CLIENT_1"]),
    "keys by case": ([profile(gender="absent", Gender=1)], "missing_columns", ["gender"], None),
    "a number among objects": ([profile(), 7], "not_a_table", [], None),
    "scalars": ([1, 2], "not_a_table", [], None),
    "no profiles": ([], "invalid_json", [], None),
    "empty object": ({}, "missing_columns", FEATURES, None),
}
RAW = {"truncated": '[{"tenure": 12', "null body": None, "empty": "", "blank": " \n ", "trailing": json.dumps([profile()]) + " x", "null": "null",
       "repeated key": '[{"tenure": 1, "tenure": 2}]', "text": '"text"'}
ODD = {"blanks around": ("\n\t " + json.dumps([profile()]) + " \n", None)}


@pytest.fixture(scope="module")
def bodies(spark):
    rows = [(k, json.dumps(v[0])) for k, v in CASES.items()] + list(RAW.items()) + [(k, v[0]) for k, v in ODD.items()]
    return spark.createDataFrame(rows, "request string, body string").withColumn("pos", F.lit("clash")).repartition(3)


def test_verdicts(bodies):
    rows = RQ.parse_requests(bodies)
    got = {r.request: r for r in RQ.request_verdicts(rows).collect()}
    assert got.keys() == CASES.keys() | RAW.keys() | ODD.keys()
    for name, (body, rule, columns, _) in CASES.items():
        r = got[name]
        assert (r.rule, list(r.columns), r.accepted) == (rule, columns, rule is None), name
        assert r.n_rows == (len(body) if isinstance(body, list) else 1), name
    assert {got[k].rule for k in RAW} == {"invalid_json"} and got["blanks around"].accepted


def test_ids_follow_the_order_of_the_request(bodies):
    rows = RQ.parse_requests(bodies)
    got = {}
    for r in RQ.accepted_rows(rows, RQ.request_verdicts(rows)).orderBy("request", "pos").collect():
        got.setdefault(r.request, []).append(r.id_client)
    assert got == {k: v[3] for k, v in CASES.items() if v[3] is not None} | {"blanks around": ["CLIENT_1"]}


def test_no_requests(bodies):
    rows = RQ.parse_requests(bodies.limit(0))
    assert RQ.request_verdicts(rows).count() == 0 and RQ.accepted_rows(rows, RQ.request_verdicts(rows)).count() == 0


@pytest.fixture(scope="module")
def fit(spark):
    prepared = E.prepare_features(customers_raw(spark, SF_SMALL))
    return TR.fit_model(prepared, {"rounds": 3, "max_depth": 2}).artifacts, prepared.drop("Churn")


def test_stream_refuses_one_request_only(spark, fit):
    art, prepared = fit
    root = scratch_path(spark, "request-stream")
    rows = [r.asDict() for r in prepared.orderBy("customerID").collect()]
    parts = [rows[i:i + 10] for i in range(0, len(rows), 10)]
    parts[2][3] = parts[2][3] | {"tenure": "12"}
    lines = [json.dumps(p) for p in parts] + ["", '[{"tenure":']
    spark.createDataFrame([(line,) for line in lines], "value string").repartition(3).write.text(f"{root}/in")
    source = RQ.request_bodies(spark, f"{root}/in", per_line=True, stream=True, max_files=1)
    score_request_stream(source, art, f"{root}/out", f"{root}/verdicts", f"{root}/checkpoint").awaitTermination()
    out, verdicts = spark.read.parquet(f"{root}/out"), spark.read.parquet(f"{root}/verdicts")
    assert sorted((v.rule or "", v.n_rows) for v in verdicts.collect() if not v.accepted) == [("invalid_json", 0), ("tenure", 10)]
    refused = {r["customerID"] for r in parts[2]}
    want, _ = SCO.score_batch(prepared.where(~F.col("customerID").isin(list(refused))), art)
    got = out.select(*want.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    # read again as a batch: the same requests, so a replay replaces what it wrote
    again, seen = RQ.score_requests(RQ.request_bodies(spark, f"{root}/in", per_line=True), art)
    assert again.exceptAll(out.select(*again.columns)).count() == 0 and seen.exceptAll(verdicts.select(*seen.columns)).count() == 0


def test_whole_files_are_requests(spark):
    root = scratch_path(spark, "request-files")
    spark.createDataFrame([(json.dumps([profile(), profile()], indent=1),)], "value string").coalesce(1).write.text(root)
    rows = RQ.parse_requests(RQ.request_bodies(spark, root))
    assert [(r.n_rows, r.accepted) for r in RQ.request_verdicts(rows).collect()] == [(2, True)]


def test_text_is_no_number_unless_parsed(spark, fit):
    art, prepared = fit
    text = prepared.withColumn("tenure", F.col("tenure").cast("string"))
    with pytest.raises(SCO.ValidationError, match="tenure"):
        SCO.score_batch(text, art)
    assert SCO.score_batch(text, art, text="parse")[0].count() == prepared.count()
    with pytest.raises(SCO.ValidationError, match="empty"):
        SCO.score_batch(prepared.limit(0), art)
    flags = spark.createDataFrame([(True, "1", "1.0", "x", None)], "a boolean, b string, c string, d string, e int")
    assert SCO.validate_binary(flags, ["a", "b", "c", "d", "e"]).first()["invalid_columns"] == ["c", "d", "e"]
    assert SCO.validate_binary(flags, ["a", "b", "c", "d", "e"], text="parse").first()["invalid_columns"] == ["d", "e"]


def test_a_body_is_parsed_once_and_not_for_each_element(spark):
    from attrition.sources import requests as RQ
    rows = RQ.parse_requests(spark.createDataFrame([("a", "[{}, {}, 1]"), ("b", "[{"), ("c", "{}")], "request string, body string"))
    above = rows._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert "body#" not in above
    assert sorted((r.request, r.pos, r._json) for r in rows.select("request", "pos", "_json").collect() if r.request != "b") == [("a", 0, True), ("a", 1, True), ("a", 2, True), ("c", 0, True)]
    assert [(r.pos, r._json) for r in rows.where("request = 'b'").collect()] == [(None, False)]


def test_a_batch_of_one_file_is_parsed_on_all_cores(spark, monkeypatch, tmp_path):
    from attrition.sources import requests as RQ
    from attrition.streaming import score_stream as ST
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.txt").write_text("\n".join("{}" for _ in range(50)))
    seen = []
    monkeypatch.setattr(ST, "score_requests", lambda batch, *_: (seen.append((batch.rdd.getNumPartitions(), batch.count())), (batch, batch))[1])
    monkeypatch.setattr(ST, "_replace", lambda *_: None)
    source = RQ.request_bodies(spark, str(tmp_path / "in"), per_line=True, stream=True)
    ST.score_request_stream(source, None, "", "", str(tmp_path / "checkpoint")).awaitTermination()
    assert seen == [(spark.sparkContext.defaultParallelism, 50)]

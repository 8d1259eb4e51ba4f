import pytest
from pyspark.sql import functions as F

from attrition.config import FEATURES
from attrition.operators import encode as E
from attrition.operators import score as SCO
from attrition.operators.scale import apply_range_scaler
from attrition.plans import training as TR
from attrition.session import scratch_path
from attrition.sources import io as IO
from attrition.sources.fixture import customers_raw
from attrition.streaming.score_stream import read_profile_stream, score_stream

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def fit(spark):
    prepared = E.prepare_features(customers_raw(spark, SF_SMALL))
    return TR.fit_model(prepared, {"rounds": 5, "max_depth": 3}), prepared


def _dirty(prepared):
    k = F.substring("customerID", 2, 20).cast("long")
    return prepared.drop("Churn").withColumn("tenure", F.when(k % 10 == 0, F.lit(-1)).otherwise(F.col("tenure")))


def test_strict_fails_iff_quarantine_rejects(spark, fit):
    f, prepared = fit
    art = f.artifacts
    clean = prepared.drop("Churn")
    scored, rejected = SCO.score_batch(clean, art, mode="strict")
    assert scored.count() == clean.count() and rejected.count() == 0
    with pytest.raises(SCO.ValidationError) as e:
        SCO.score_batch(_dirty(prepared), art, mode="strict")
    assert "tenure" in str(e.value)
    good, bad = SCO.score_batch(_dirty(prepared), art, mode="quarantine")
    assert bad.count() > 0 and good.count() + bad.count() == clean.count()
    assert {tuple(r["reasons"]) for r in bad.collect()} == {("tenure",)}


def test_missing_columns_and_ids(spark, fit):
    f, prepared = fit
    with pytest.raises(SCO.ValidationError):
        SCO.score_batch(prepared.drop("tenure"), f.artifacts)
    df = prepared.select(F.col("customerID").alias("ID"), F.lit("x").alias("client_id"), *FEATURES)
    assert SCO.resolve_id_column(df) == "ID"                 # first in table order
    no_id = prepared.select(*FEATURES)
    ids = [r["id_client"] for r in SCO.resolve_id(no_id).collect()]
    assert sorted(ids, key=lambda s: int(s.split("_")[1]))[0] == "CLIENT_1" and len(set(ids)) == len(ids)


def test_threshold_rule_uses_unrounded_probability(spark, fit):
    f, prepared = fit
    scored, _ = SCO.score_batch(prepared.drop("Churn"), f.artifacts, mode="quarantine")
    scaled = apply_range_scaler(prepared, f.artifacts.scaler, FEATURES)
    raw = TR.scored(scaled, f.artifacts).select("customerID", "proba")
    j = scored.join(raw, scored.id_client == raw.customerID)
    bad = j.filter((F.col("churn_class") == 1) != (F.col("proba") >= f.artifacts.threshold)).count()
    assert bad == 0
    assert j.filter(F.abs(F.col("churn_proba") - F.round("proba", 4)) > 1e-12).count() == 0


def test_artifacts_round_trip(spark, fit):
    f, prepared = fit
    path = scratch_path(spark, "art-test")
    IO.save_artifacts(spark, path, f.artifacts)
    loaded = IO.load_artifacts(spark, path)
    assert loaded.features == FEATURES and loaded.threshold == f.artifacts.threshold
    a, _ = SCO.score_batch(prepared.drop("Churn"), f.artifacts, mode="quarantine")
    b, _ = SCO.score_batch(prepared.drop("Churn"), loaded, mode="quarantine")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_stream_equals_batch(spark, fit):
    f, prepared = fit
    root = scratch_path(spark, "stream-test")
    dirty = _dirty(prepared)
    js = F.to_json(F.struct(*dirty.columns))
    dirty.select(js.alias("value")).repartition(3).write.text(f"{root}/in")
    q = score_stream(read_profile_stream(spark, f"{root}/in", FEATURES, max_files=1), f.artifacts,
                     f"{root}/out", f"{root}/rej", f"{root}/ckpt")
    q.awaitTermination()
    streamed = spark.read.parquet(f"{root}/out").drop("batch_id")
    batch, rejected = SCO.score_batch(dirty, f.artifacts, mode="quarantine")
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0
    assert spark.read.parquet(f"{root}/rej").count() == rejected.count()


def test_upload_is_lenient(spark, fit):
    f, prepared = fit
    txt = prepared.select("customerID", *[F.col(c).cast("string").alias(c) for c in FEATURES])
    txt = txt.withColumn("MonthlyCharges", F.lit("NA"))
    path = scratch_path(spark, "upload-test")
    IO.sink_table(txt, path, fmt="csv")
    out = SCO.score_upload(IO.scan_upload(spark, path, columns=txt.columns), f.artifacts)
    assert out.count() == prepared.count()
    assert set(out.columns) == {"ID_CLIENT", "Churn_Proba", "Churn_Class", "Commentaire"}


def test_missing_threshold_defaults_to_half(spark, fit):
    f, _ = fit
    path = scratch_path(spark, "art-no-threshold")
    art = f.artifacts
    art.model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame(list(enumerate(art.features)), "pos int, feature string").write.parquet(f"{path}/features")
    spark.createDataFrame([(k, float(lo), float(hi)) for k, (lo, hi) in art.scaler.items()],
                          "feature string, lo double, hi double").write.parquet(f"{path}/scaler")
    loaded = IO.load_artifacts(spark, path)
    assert loaded.threshold == 0.5 and loaded.features == art.features


def test_scoring_input_takes_the_stored_encoding(spark, monkeypatch):
    """The levels are learned once, for the fit; what is scored with it is not read for them again."""
    from attrition.operators import encode as E
    from attrition.plans import catalog as C
    art = C.fitted(spark, SF_SMALL).artifacts
    assert art.encoding is not None and C.dirty_input(spark, SF_SMALL).exceptAll(C.dirty_input(spark, SF_SMALL, art.encoding)).isEmpty()
    monkeypatch.setattr(E, "learn_encoding", lambda *_, **__: pytest.fail("levels learned again"))
    for name in ("score_rejects", "score_upload", "score_requests", "score_request_stream"):
        assert not C.QUERIES[name](spark, SF_SMALL).isEmpty()

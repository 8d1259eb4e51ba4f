"""Faults that only show at size, on degenerate columns or on damaged inputs."""
import math

import pytest
from pyspark.sql import functions as F

from attrition.functions import stats as S
from attrition.operators import encode as E, evaluate as EV, profile as P, split as SP, stat_tests as ST
from attrition.operators.rank import row_ids
from attrition.sources import io as IO


@pytest.mark.parametrize("deal", ["repartition", "join", "sort", "group"])
def test_keyless_row_ids_are_lossless(spark, deal):
    n = 60_000
    df = spark.range(n).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(1000)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        dealt = {"repartition": lambda: df.repartition("k"), "join": lambda: df.join(spark.range(1000).withColumnRenamed("id", "k"), "k"),
                 "sort": lambda: df.orderBy("k"), "group": lambda: df.groupBy("id").agg(F.max("k").alias("k"))}[deal]()
        got = row_ids(dealt).select("id", F.substring("id_client", 8, 20).cast("long").alias("i")).agg(
            F.count("*"), F.count_distinct("id"), F.count_distinct("i"), F.min("i"), F.max("i")).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert tuple(got) == (n, n, n, 1, n)


def test_three_million_ties(spark):
    df = spark.range(3_000_000).select(F.lit(1.0).alias("x"), (F.col("id") % 2).alias("y"))
    r = ST.mann_whitney(df, ["x"], "y", with_p=False).first()
    assert r.u == 1.5e6 * 1.5e6 / 2 and r.z is None and r.rank_biserial == 0


def test_constant_columns_and_one_class(spark):
    df = spark.createDataFrame([(1.0, float(i), "a", "No") for i in range(20)], "c double, x double, g string, y string")
    assert ST.spearman_matrix(df, ["c", "x"]).first().coef is None
    assert ST.ks_normal(df, ["c"]).first().n == 20
    assert ST.chi_square(df, ["g"], "y").first().n == 20
    assert P.class_weight(df, "y", positive="Yes").first().weight is None
    r = P.risk_segments(df, {"flag": "x > 5"}, "y", positive="Yes").collect()
    assert sum(x.gid == 0 for x in r) == 2 and all(x.lift is None and x.rate == 0 for x in r)


def test_threshold_is_chosen_before_rounding(spark):
    """Between the two scores J differs by 2.5e-7 only."""
    neg = [(0.0, 2_000_001, 0), (1.0, 2_000_000, 0), (2.0, 1, 0)]
    pos = [(1.0, 1_999_999, 1), (2.0, 2_000_001, 1), (0.0, 2, 1)]
    df = spark.createDataFrame(neg + pos, "s double, n long, y int").withColumn("e", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    best = EV.youden_threshold(df, "s", "y").first()
    P_, Q_ = 4_000_002, 4_000_002
    j = {0.5: (P_ - 2) / P_ + 2_000_001 / Q_ - 1, 1.5: 2_000_001 / P_ + 4_000_001 / Q_ - 1}
    assert best.threshold == max(j, key=lambda t: (j[t], -t))


def test_tails():
    assert S.kolmogorov_sf(1e-3, 100) == pytest.approx(1.0, abs=1e-12) and S.kolmogorov_sf(0.0002, 100) == 1.0
    lam = 0.3 / (10 + 0.12 + 0.011)
    assert S.kolmogorov_sf(lam * 0.9999, 100) == pytest.approx(S.kolmogorov_sf(lam * 1.0001, 100), abs=1e-6)
    assert S.gammaincc(1e8, 1e8 - 1) == pytest.approx(0.5 + (1 - 1 / 3) / math.sqrt(2 * math.pi * 1e8), abs=1e-8)
    assert S.gammaincc(9.9e5, 9.9e5) == pytest.approx(0.5 - 1 / (3 * math.sqrt(2 * math.pi * 9.9e5)), abs=1e-6)
    assert S.gammaincc(1.01e6, 1.01e6 + 500) == pytest.approx(S.gammaincc(1.0e6 - 1, 1.0e6 - 1 + 497.5), abs=2e-3)


def test_csv_columns_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("charge,extra,tenure\n100,x,1\n")
    path = str(tmp_path / "a.csv")
    assert IO.scan_csv(spark, path, "tenure int, charge int").first().asDict() == {"tenure": 1, "charge": 100}
    with pytest.raises(ValueError, match="missing"):
        IO.scan_csv(spark, path, "tenure int, charge int, other int")
    (tmp_path / "b").mkdir()
    (tmp_path / "b/1.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b/2.csv").write_text("y,x\n1,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        IO.scan_csv(spark, str(tmp_path / "b"), "x int, y int").collect()
    with pytest.raises(Exception, match="(?i)header"):
        IO.scan_upload(spark, path, columns=["tenure", "charge", "extra"]).collect()


def test_predictions_of_a_day_are_replaced(spark, tmp_path):
    path = str(tmp_path / "p")
    for day, n in (("2026-01-01", 3), ("2026-01-02", 2), ("2026-01-01", 1)):
        IO.sink_predictions(spark.range(n), path, run_date=day)
    got = {str(r.run_date): r["count"] for r in spark.read.option("header", True).csv(path).groupBy("run_date").count().collect()}
    assert got == {"2026-01-01": 1, "2026-01-02": 2}


def test_many_levels(spark):
    df = spark.range(12_000).select("id", F.concat(F.lit("L"), "id").alias("c"))
    assert len(E.learn_encoding(df, yes_no_candidates=[], one_hot_cols=["c"]).vocab["c"]) == 12_000
    assert E.one_hot_long(df, ["c"], "id").count() == 12_000


def test_stratified_split_takes_null_classes(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("c"), (F.col("id") % 4).cast("string"))).alias("cls"))
    got = SP.split_train_test(df, "k", 0.8, stratify="cls").groupBy("cls").agg(F.count("*").alias("n"), F.count_if("is_train").alias("t")).collect()
    assert len(got) == 4 and all(r.t == 400 and r.n == 500 for r in got)


def test_damaged_threshold_is_an_error_and_encoding_is_stored(spark, tmp_path):
    import shutil

    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    from attrition.operators.score import Artifacts

    path = str(tmp_path / "art")
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="f")]).fit(spark.createDataFrame([(1.0,)], "x double"))
    enc = E.Encoding(["Partner"], {"Contract": ["a", "b"], "Pay": ["z"]})
    IO.save_artifacts(spark, path, Artifacts(model=model, features=["x"], scaler={"x": (0, 1)}, threshold=0.3, encoding=enc))
    got = IO.load_artifacts(spark, path)
    assert got.threshold == 0.3 and got.encoding == enc and got.scaler == {"x": (0.0, 1.0)}
    (folder,) = (tmp_path / "art/sets").iterdir()
    for f in (folder / "threshold").glob("*.parquet"):
        f.write_bytes(b"not parquet")
        (f.parent / f".{f.name}.crc").unlink()  # else the file system itself finds out
    with pytest.raises(ValueError, match="threshold"):
        IO.load_artifacts(spark, path)
    shutil.rmtree(folder / "threshold")
    with pytest.raises(ValueError, match="threshold"):
        IO.load_artifacts(spark, path)


@pytest.mark.parametrize("ended", ["features", "scaler", "threshold", "manifest"])
def test_a_writer_that_ends_leaves_the_former_set(spark, tmp_path, monkeypatch, ended):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.sql import DataFrameWriter

    from attrition.operators.score import Artifacts

    path = str(tmp_path / "art")
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="f")]).fit(spark.createDataFrame([(1.0,)], "x double"))
    new = Artifacts(model=model, features=["y"], scaler={"y": (2, 3)}, threshold=0.7)
    real = {kind: getattr(DataFrameWriter, kind) for kind in ("parquet", "text")}

    def ending(kind):
        def write(self, to, *args, **kw):
            if ended in to:
                raise RuntimeError("ended")
            return real[kind](self, to, *args, **kw)
        return write

    for kind in real:
        monkeypatch.setattr(DataFrameWriter, kind, ending(kind))
    with pytest.raises(RuntimeError):
        IO.save_artifacts(spark, path, new)
    with pytest.raises(Exception):
        IO.load_artifacts(spark, path)  # nothing is published yet
    monkeypatch.undo()
    IO.save_artifacts(spark, path, Artifacts(model=model, features=["x"], scaler={"x": (0, 1)}, threshold=0.3))
    for kind in real:
        monkeypatch.setattr(DataFrameWriter, kind, ending(kind))
    with pytest.raises(RuntimeError):
        IO.save_artifacts(spark, path, new)
    monkeypatch.undo()
    got = IO.load_artifacts(spark, path)
    assert (got.features, got.scaler, got.threshold) == (["x"], {"x": (0.0, 1.0)}, 0.3)
    IO.save_artifacts(spark, path, new)
    assert IO.load_artifacts(spark, path).threshold == 0.7


def test_tuned_fit_uses_the_winner(spark):
    from attrition.operators.model import gbt_stage
    from attrition.plans import training as TR
    from attrition.plans.catalog import prepared

    fit, search = TR.fit_tuned(prepared(spark, "/root/testdata/sf0.001"), grid={"max_depth": [2, 3], "eta": [0.3], "subsample": [1.0], "colsample_bytree": [1.0]},
                               folds=2, max_rounds=3, patience=2)
    best = search.filter("is_best").first()
    gbt = gbt_stage(fit.artifacts.model)
    assert search.count() == 2 and gbt.getNumTrees == best.best_round and gbt.getMaxDepth() == best.max_depth

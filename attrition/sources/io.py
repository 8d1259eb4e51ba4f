"""Sources, sinks and model artefacts (§2.1).

Scans always take an explicit schema (no inference at scale). Upload and
JSON scans read every field as text and leave the numeric decision to the
scoring contract (``try_cast``), so malformed values become rejects instead
of failed jobs; malformed JSON records survive in ``_corrupt_record``.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attrition.config import DEFAULT_THRESHOLD, MODEL_VERSION
from attrition.operators.encode import Encoding
from attrition.operators.score import Artifacts

CORRUPT = "_corrupt_record"


def scan_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """Header CSV with an explicit schema, columns matched by NAME: the order
    is read from a header line, every file's header is then held against it
    (a file that differs fails), columns beyond the schema are dropped and a
    missing one is an error."""
    order = _header(spark, path)
    fields = {f.name: f for f in T.StructType.fromDDL(schema) if isinstance(schema, str)} if isinstance(schema, str) \
        else {f.name: f for f in schema}
    missing = [n for n in fields if n not in order]
    if missing:
        raise ValueError(f"columns missing in {path}: {missing}")
    by_file = T.StructType([fields.get(n, T.StructField(n, T.StringType())) for n in order])
    return spark.read.schema(by_file).option("header", True).option("enforceSchema", False).csv(path).select(*fields)


def _header(spark: SparkSession, path: str) -> list:
    line = spark.read.option("header", False).csv(path).limit(1).first()
    return [str(c).strip() for c in line if c is not None] if line else []


def scan_upload(spark: SparkSession, path: str, columns=None) -> DataFrame:
    """Uploaded CSV: ',' separated, UTF-8, whitespace trimmed, '' and 'NA'
    are null; every column read as text. ``columns`` (header names) gives the
    schema without an inference pass; otherwise the header line is read. A file
    whose header differs from it fails instead of being read by position."""
    if columns is None:
        columns = _header(spark, path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = (spark.read.schema(schema).option("header", True).option("sep", ",")
           .option("enforceSchema", False).option("encoding", "UTF-8").option("ignoreLeadingWhiteSpace", True)
           .option("ignoreTrailingWhiteSpace", True).option("nullValue", "").csv(path))
    return raw.select(*[F.nullif(F.trim(F.col(c)), F.lit("NA")).alias(c) for c in columns])


def profile_schema(features, id_col: str = "customerID", corrupt: bool = True) -> T.StructType:
    fields = [T.StructField(id_col, T.StringType())] + [T.StructField(f, T.StringType()) for f in features]
    if corrupt:
        fields.append(T.StructField(CORRUPT, T.StringType()))
    return T.StructType(fields)


def scan_json_profiles(spark: SparkSession, path: str, features, id_col: str = "customerID",
                       multi_line: bool = True) -> DataFrame:
    """JSON array (or JSON lines) of customer objects → one row per object;
    values kept as text; malformed records in ``_corrupt_record``."""
    return (spark.read.schema(profile_schema(features, id_col))
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
            .option("multiLine", multi_line).json(path))


def parse_profiles_column(df: DataFrame, col: str, features, id_col: str = "customerID") -> DataFrame:
    """A column holding a JSON array of profiles → one row per profile."""
    elem = profile_schema(features, id_col, corrupt=False)
    return df.select(F.inline(F.from_json(F.col(col), T.ArrayType(elem))))


def sink_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    w.save(path)


def sink_predictions(df: DataFrame, path: str, run_date: str | None = None) -> None:
    """CSV with header under ``run_date=<date>`` (the reference names its
    download ``prediction_churn_<date>.csv``), by default the session's current
    date. Running a day again replaces that day and leaves the others."""
    day = F.lit(run_date) if run_date else F.current_date().cast("string")
    df.withColumn("run_date", day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("run_date").option("header", True).csv(path)


def save_artifacts(spark: SparkSession, path: str, art: Artifacts) -> str:
    """Model, ordered features, scaler, threshold, version and encoding as one set.

    Every set gets a folder of its own under ``path/sets``; when all its parts are written, a manifest with their
    checksums is put under ``path/manifests`` as one file, which publishes the set. A writer that ends before that
    leaves the former set in force. Returns the set's name; sets are ordered by it.
    """
    name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    folder = f"{path}/sets/{name}"
    art.model.write().save(f"{folder}/model")
    spark.createDataFrame(list(enumerate(art.features)), "pos int, feature string") \
        .coalesce(1).write.parquet(f"{folder}/features")
    spark.createDataFrame([(f, float(lo), float(hi)) for f, (lo, hi) in art.scaler.items()],
                          "feature string, lo double, hi double").coalesce(1).write.parquet(f"{folder}/scaler")
    spark.createDataFrame([(float(art.threshold), art.version)], "threshold double, version string") \
        .coalesce(1).write.parquet(f"{folder}/threshold")
    enc = art.encoding
    if enc is not None:
        rows = [("yes_no", c, None) for c in enc.yes_no_cols] + [("level", c, v) for c, levels in enc.vocab.items() for v in levels]
        spark.createDataFrame(rows, "kind string, variable string, level string").coalesce(1).write \
            .parquet(f"{folder}/encoding")
    manifest = json.dumps({"set": name, "files": checksums(spark, folder)}, sort_keys=True)
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{path}/manifests/{name}")
    return name


def checksums(spark: SparkSession, folder: str) -> dict:
    """Path below ``folder`` -> SHA-256 of every file there: the few files of one artefact set."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    at = F.regexp_extract("path", "/sets/[^/]+/(.*)$", 1)
    return {r["at"]: r["sum"] for r in files.select(at.alias("at"), F.sha2("content", 256).alias("sum")).collect()}


def published_set(spark: SparkSession, path: str) -> str | None:
    """Folder of the newest published set, its files checked against the manifest; None where nothing was published."""
    try:
        manifests = [json.loads(r["value"]) for r in spark.read.text(f"{path}/manifests/*").collect()]  # one line a set
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    newest = max(manifests, key=lambda m: m["set"])
    folder = f"{path}/sets/{newest['set']}"
    found = checksums(spark, folder)
    if found != newest["files"]:
        wrong = sorted(f for f in found.keys() | newest["files"].keys() if found.get(f) != newest["files"].get(f))
        raise ValueError(f"artefacts in {folder} are not those of their manifest: {wrong}")
    return folder


def _if_there(spark: SparkSession, path: str) -> list:
    """Rows of a stored table, none if it was never stored; any other failure is raised."""
    try:
        return spark.read.parquet(path).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def load_encoding(spark: SparkSession, path: str) -> Encoding | None:
    """The encoding stored with the artefacts (levels sorted, as learned)."""
    rows = _if_there(spark, f"{published_set(spark, path) or path}/encoding")
    vocab: dict = {}
    for r in sorted((r for r in rows if r["kind"] == "level"), key=lambda r: (r["variable"], r["level"])):
        vocab.setdefault(r["variable"], []).append(r["level"])
    return Encoding([r["variable"] for r in rows if r["kind"] == "yes_no"], vocab) if rows else None


def load_artifacts(spark: SparkSession, path: str) -> Artifacts:
    """The newest published set under ``path``, or the set that stands in ``path`` itself (one without a manifest).
    A missing threshold gives 0.5; a file that is missing or differs from its manifest is an error."""
    path = published_set(spark, path) or path
    model = PipelineModel.load(f"{path}/model")
    feats = [r["feature"] for r in spark.read.parquet(f"{path}/features").orderBy("pos").collect()]
    scaler = {r["feature"]: (r["lo"], r["hi"]) for r in spark.read.parquet(f"{path}/scaler").collect()}
    stored = _if_there(spark, f"{path}/threshold")
    thr, ver = (float(stored[0]["threshold"]), stored[0]["version"]) if stored else (DEFAULT_THRESHOLD, MODEL_VERSION)
    return Artifacts(model=model, features=feats, scaler=scaler, threshold=thr, version=ver,
                     encoding=load_encoding(spark, path))

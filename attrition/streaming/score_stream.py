"""Structured Streaming scorers (§2.10).

``score_request_stream``: files of requests arrive in a folder; each micro-batch runs the request contract
(``sources.requests``), so a bad profile refuses its own request and no other → scored rows and one verdict a
request in two parquet tables. A request is known by its file (and line), so its rows can be found again.

``score_stream``: JSON lines of profiles; bad profiles are put aside one by one (``score_batch`` in quarantine mode)
→ scored rows and reject rows in two parquet tables. Values are read as text and parsed.

Stateless and checkpointed; each micro-batch writes under its own
``batch_id`` partition with overwrite of that partition only, so a batch
replayed after a failure replaces its own output instead of duplicating it.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attrition.operators.score import Artifacts, score_batch
from attrition.sources.io import CORRUPT, profile_schema
from attrition.sources.requests import score_requests


def read_profile_stream(spark: SparkSession, path: str, features, id_col: str = "customerID",
                        max_files: int | None = None) -> DataFrame:
    reader = (spark.readStream.schema(profile_schema(features, id_col))
              .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def score_stream(stream: DataFrame, art: Artifacts, out_path: str, reject_path: str, checkpoint: str,
                 null_policy: str = "scaled_zero", available_now: bool = True) -> StreamingQuery:
    """Start the scorer; returns the running query."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        # the micro-batch feeds two outputs: read the source once
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            _handle(batch, batch_id)
        finally:
            batch.unpersist()

    def _handle(batch: DataFrame, batch_id: int) -> None:
        malformed = batch.filter(F.col(CORRUPT).isNotNull())
        clean = batch.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
        if clean.isEmpty() and malformed.isEmpty():
            return
        parts = [malformed.select(F.lit(None).cast("string").alias("id_client"), F.array(F.lit("malformed_json")).alias("reasons"))]
        if not clean.isEmpty():
            good, bad = score_batch(clean, art, mode="quarantine", null_policy=null_policy, text="parse")
            _replace(good, batch_id, out_path)
            parts.append(bad)
        rejects = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        _replace(rejects, batch_id, reject_path)

    return _start(stream, handle, checkpoint, available_now)


def score_request_stream(requests: DataFrame, art: Artifacts, out_path: str, verdict_path: str, checkpoint: str,
                         null_policy: str = "scaled_zero", available_now: bool = True) -> StreamingQuery:
    """Start the scorer of a stream of (request, body), as ``request_bodies(..., stream=True)`` gives it; returns the running query."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        # a file is one task's text: its requests are dealt to all cores before they are parsed
        batch = batch.repartition(batch.sparkSession.sparkContext.defaultParallelism, "request")
        scored, verdicts = score_requests(batch, art, null_policy)
        _replace(scored, batch_id, out_path)
        _replace(verdicts, batch_id, verdict_path)

    return _start(requests, handle, checkpoint, available_now)


def _replace(df: DataFrame, batch_id: int, path: str) -> None:
    df.withColumn("batch_id", F.lit(int(batch_id))).write.mode("overwrite").partitionBy("batch_id") \
        .option("partitionOverwriteMode", "dynamic").parquet(path)


def _start(stream: DataFrame, handle, checkpoint: str, available_now: bool) -> StreamingQuery:
    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()

"""Helpers shared by the operators of this subpackage.

* ``member_bits`` / ``hit``: a set of 64-bit keys as a bitmap of fixed size (a
  proven broadcast bound), tested per row with built-in functions. A hit may be
  false, a miss never is, so it may only be used to skip work.
* ``components``: connected components by alternating large-star / small-star
  rounds, every round cut by a reliable ``checkpoint()``.
* ``one_plan``: queries over small tables without the driver's cost of an adaptive plan.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from attrition.session import checkpoint_root, scratch_path

PAGE = 32768  # bits of one bitmap row (4 KB)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared scratch folder: cuts lineage, survives executor loss."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def one_plan(spark: SparkSession, rows: int, each: int = 100_000) -> Iterator[None]:
    """Queries run inside are planned once, over a partition for each ``each`` of ``rows`` (at most the session's).

    An adaptive plan costs the driver a job, a thread with its memory, held for a minute, and a new description of the
    whole plan for every exchange; many-step queries over small tables have little else to pay for. Lazy results
    that are run later are planned as the session says then."""
    now = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(min(int(now["spark.sql.shuffle.partitions"]), 1 + rows // each)))
    try:
        yield
    finally:
        for k, v in now.items():
            spark.conf.set(k, v)


def member_bits(keys: DataFrame, key: str, bits: int = 24) -> DataFrame:
    """Bitmap rows (page, bitmap) over ``2**bits`` positions of ``key`` (long): at most 2**bits / 8 bytes."""
    at = F.pmod(F.col(key), F.lit(1 << bits))
    return (keys.select(F.expr(f"{_at(key, bits)} div {PAGE}").alias("page"), (at % PAGE).alias("pos"))
            .groupBy("page").agg(F.bitmap_construct_agg("pos").alias("bitmap")))


def _at(key: str, bits: int) -> str:
    return f"pmod(`{key}`, {1 << bits}L)"


def with_hit(df: DataFrame, key: str, pages: DataFrame, out: str, bits: int = 24) -> DataFrame:
    """Adds boolean ``out``: false only if ``key`` is not among the bitmap's keys. ``pages`` is at most 2**bits / 8 bytes, so it is broadcast."""
    p = pages.select(F.col("page").alias("__page"), F.col("bitmap").alias("__bitmap"))
    j = df.withColumn("__at", F.expr(f"{_at(key, bits)} div {PAGE}")).join(F.broadcast(p), F.col("__at") == F.col("__page"), "left")
    byte = f"cast(conv(hex(substring(__bitmap, cast((pmod(`{key}`, {PAGE}L) div 8) + 1 as int), 1)), 16, 10) as int)"
    return j.withColumn(out, F.expr(f"coalesce(__bitmap is not null and (shiftright({byte}, cast(pmod(`{key}`, 8L) as int)) & 1) = 1, false)")).drop("__at", "__page", "__bitmap")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected ``edges`` over longs: rows (node, component = smallest node).

    Large-star joins every neighbour above a node to the smallest of its
    neighbourhood, small-star those below it, until nothing changes. Minima are
    pre-aggregated before the shuffle; the join back leaves a hub to AQE's skew
    join. Isolated nodes are not listed; an empty input gives no rows.
    """
    checkpoint_root(edges.sparkSession)
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct().checkpoint()
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(low, F.col("u") == F.col("k"))
        e = (small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
             .where("u > v").distinct().checkpoint())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

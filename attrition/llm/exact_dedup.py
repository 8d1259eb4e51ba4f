"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Built-in functions only. Each level works on the survivors of the level before:

1. rows per text length (UTF-8 bytes); lengths held by one row are settled;
2. a hash of the first ``prefix`` characters, only for rows whose length survived;
3. SHA-256 of the whole text, only for rows whose (length, prefix hash) survived.

The survivors of a level travel to the next scan as a bitmap of fixed size
(``common.member_bits``), so texts are never shuffled to find candidates; a
false hit costs one hash and changes nothing. Groups are counted with partial
aggregates, so a text held by a third of all rows is one row per task.

Defined results: a null text counts as empty; no normalisation; of equal texts the
largest id stays (null ids lose to any other; a group of null ids alone keeps them);
rows repeated with the same id and text are one document and share a verdict; an
empty table gives an empty result; other columns are carried inside ``row``, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from attrition.llm.common import member_bits, with_hit, written


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list | None = None,
                prefix: int = 256, bits: int = 26, digest: str = "survivors") -> DataFrame:
    """(row, keep_id, group_size, kept, full_hash) for every input row.

    ``row`` is a struct of the ``carry`` columns (default: all). ``full_hash`` is
    null where refinement ended earlier; ``digest="all"`` fills it in for output.
    ``bits`` sizes the survivor bitmaps (2**bits / 8 bytes: 8 MB).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    carried = F.struct(*[F.col(f"`{c}`") for c in (carry or docs.columns)]).alias("row")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"), carried, F.octet_length(text).cast("long").alias("len"))

    lengths = rows.groupBy("len").agg(F.count("*").alias("n")).where("n > 1")
    level1 = written(member_bits(lengths, "len", bits), "dedup-length")
    by_len = with_hit(rows, "len", level1, "hit1", bits)

    key = F.when(F.col("hit1"), F.xxhash64("len", F.substring("t", 1, prefix)))
    by_prefix = by_len.withColumn("pre", key)
    prefixes = by_prefix.where("hit1").groupBy("pre").agg(F.count("*").alias("n")).where("n > 1")
    level2 = written(member_bits(prefixes, "pre", bits), "dedup-prefix")
    survivors = with_hit(by_prefix.where("hit1"), "pre", level2, "hit2", bits)

    hashed = survivors.where("hit2").select("id", "row", F.sha2(F.col("t"), 256).alias("full_hash"))
    groups = written(hashed.groupBy("full_hash").agg(F.max("id").alias("keep"), F.count("*").alias("size")).where("size > 1"), "dedup-groups")

    rest = F.sha2(F.col("t"), 256) if digest == "all" else F.lit(None).cast("string")
    settled = with_hit(by_prefix, "pre", level2, "hit2", bits).where("not coalesce(hit2, false)").select(
        "row", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), rest.alias("full_hash"))
    joined = hashed.join(groups.withColumnRenamed("full_hash", "g"), F.col("full_hash") == F.col("g"), "left").select(
        "row", F.when(F.col("g").isNotNull(), F.col("keep")).otherwise(F.col("id")).alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("g").isNull() | F.col("id").eqNullSafe(F.col("keep"))).alias("kept"), "full_hash")
    return settled.unionByName(joined)


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its verdict and the SHA-256 of its text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = exact_dedup(docs, carry=["doc_id"], digest="all")
    return out.select(F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("full_hash").alias("text_sha256"))


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

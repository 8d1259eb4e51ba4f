"""Range shards of nearly equal bytes by sampled splitters.

Records are ordered by (hash of the text, id), so equal texts lie together and a hot
group can still be cut by id.

1. A size-weighted sample of keys (each row with probability min(1, m * size / total),
   by a hash of its key, so a recomputed task draws the same) goes to the driver; its
   weighted quantiles are the splitters of ``ranges`` fine ranges.
2. The exact bytes and rows of each fine range are counted. A range over ``overfull``
   times the mean is sampled anew and subdivided until it fits or holds one key.
3. Consecutive ranges form shards: each shard edge is the range edge closest to its share
   of the bytes, moved off a group of equal texts if that costs at most ``lean`` of a shard.

Driver memory: the sample and the range table, about 24 rows a range; ranges are
64 a shard or one per million records, whichever is more.

Defined results: a null text has size 1 and checksum 0; null ids sort first; rows that
repeat id and text share a range; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from attrition.llm.common import written
from attrition.session import ship_package

LOWEST = -(1 << 63)


def range_of(hashes: np.ndarray, ids: np.ndarray, splitters: list) -> np.ndarray:
    """Number of splitters (h, id) that are at most each key."""
    first = np.array([h for h, _ in splitters], dtype=np.int64)
    low, high = np.searchsorted(first, hashes, "left"), np.searchsorted(first, hashes, "right")
    for i in np.nonzero(low < high)[0]:
        low[i] = bisect.bisect_right(splitters, (int(hashes[i]), int(ids[i])), int(low[i]), int(high[i]))
    return low


def choose_splitters(sample: list, parts: int) -> list:
    """``parts`` - 1 weighted quantiles of (h, id, weight). A group of equal h is cut only where two quantiles fall into it; else the edge moves to its start."""
    if not sample or parts < 2:
        return []
    sample = sorted(sample)
    total = np.cumsum([w for _, _, w in sample])
    at = np.searchsorted(total, total[-1] * np.arange(1, parts) / parts, "left")
    picked = sorted({sample[min(i, len(sample) - 1)][:2] for i in at})
    held = pd.Series([h for h, _ in picked]).value_counts()
    return sorted({(h, LOWEST) for h, _ in picked} | {(h, i) for h, i in picked if held[h] > 1})


def shard_edges(sizes: list, cuts_group: list, shards: int, lean: float) -> list:
    """Index of the first range of shards 1.. : the edge closest to each share, preferably not inside a group."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    share, out = ends[-1] / shards, []
    clean = np.array([i for i in range(len(ends)) if not (0 < i < len(sizes) and cuts_group[i])])
    for k in range(1, shards):
        best = int(np.argmin(abs(ends - k * share)))
        near = int(clean[np.argmin(abs(ends[clean] - k * share))])
        out.append(near if abs(ends[near] - k * share) <= abs(ends[best] - k * share) + lean * share else best)
    return np.maximum.accumulate(out).tolist() if out else []


def shard_by_bytes(docs: DataFrame, shards: int = 16, ranges: int | None = None, overfull: float = 3.0, lean: float = 0.01,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, fine_range) for every row."""
    ship_package(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                               F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("h"),
                               F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("i")), "shard-keys")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = ranges or max(64 * shards, -(-count // 1_000_000))

    def sample(df, wanted, of):
        chance = F.least(F.lit(1.0), F.col("size") * F.lit(wanted / max(of, 1)))
        drawn = F.pmod(F.xxhash64("i", "h", F.lit(wanted)), F.lit(1 << 53)) / F.lit(float(1 << 53))
        return [(r.h, r.i, r.w) for r in df.where(drawn < chance).select("h", "i", (F.col("size") / chance).alias("w")).collect()]

    def ranged(splitters):
        @F.pandas_udf("long")
        def number(h: pd.Series, i: pd.Series) -> pd.Series:
            return pd.Series(range_of(h.to_numpy(), i.to_numpy(), splitters))

        return rows.withColumn("fine_range", number("h", "i"))

    splitters = choose_splitters(sample(rows, 24 * ranges, total), ranges)
    while True:
        df = ranged(splitters)
        seen = {r.fine_range: r for r in df.groupBy("fine_range").agg(F.sum("size").alias("size"), F.count("*").alias("rows"), F.max("size").alias("most")).collect()}
        full = [k for k, r in seen.items() if r.size > overfull * total / ranges and r.rows > 1 and r.most < r.size / 2]
        more = set(splitters)
        if full:
            size = sum(seen[k].size for k in full)
            parts = {k: [] for k in full}
            drawn = sample(df.where(F.col("fine_range").isin(full)), 24 * -(-size * ranges // max(total, 1)), size)
            for h, i, w in drawn:
                parts[int(range_of(np.array([h]), np.array([i]), splitters)[0])].append((h, i, w))
            for k in full:
                more |= set(choose_splitters(parts[k], 1 + -(-seen[k].size * ranges // total)))
        if more == set(splitters):
            break
        splitters = sorted(more)

    n = len(splitters) + 1
    sizes, counts = ([getattr(seen[k], f) if k in seen else 0 for k in range(n)] for f in ("size", "rows"))
    edges = shard_edges(sizes, [False, *(i != LOWEST for _, i in splitters)], shards, lean)
    shard = np.searchsorted(edges, np.arange(n), "right")
    before = np.concatenate([[0], np.cumsum(counts)])
    starts = before[np.concatenate([[0], edges]).astype(int)]
    offset = before[:-1] - starts[shard]

    @F.pandas_udf("int")
    def shard_of(r: pd.Series) -> pd.Series:
        return pd.Series(shard[r.to_numpy()].astype(np.int32))

    @F.pandas_udf("long")
    def offset_of(r: pd.Series) -> pd.Series:
        return pd.Series(offset[r.to_numpy()].astype(np.int64))

    place = F.row_number().over(Window.partitionBy("fine_range").orderBy("h", "i"))
    return ranged(splitters).withColumn("place", place).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), shard_of("fine_range").alias("shard"),
        (offset_of("fine_range") + F.col("place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "fine_range")


def write_shards(docs: DataFrame, plan: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Writes the records under ``path``/shard=N in slot order; ``plan`` is the result of ``shard_by_bytes``; ids must be unique."""
    p = plan.select(F.col("doc_id").alias("__id"), "shard", "slot", "fine_range")
    (docs.join(p, F.col(id_col).eqNullSafe(F.col("__id"))).drop("__id").repartition("fine_range").sortWithinPartitions("shard", "slot")
     .drop("fine_range").write.partitionBy("shard").parquet(path))


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    """Every document in one of 16 shards of nearly equal bytes."""
    return shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("fine_range")

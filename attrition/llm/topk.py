"""Exact top-k inner products by a bit-sliced index.

Components are coded as floor(1024 * x). A task turns blocks of rows into slices: for
every attribute (less its smallest code in the block) one bitmap over the rows per bit.
``drop`` low bits are left out of the slices (the quantisation). A query adds the
slices, weighted by the bits of its own codes, with bitmap full adders; a negative
weight uses the complement. The sums are again slices. From the most significant down,
the k-th largest sum is found; every row whose sum can reach it, given the largest
error the dropped bits can make, is scored exactly, so the result is exact.

Queries travel in chunks of about ``chunk`` vectors (a proven bound on what a task is
sent); each chunk meets all rows in blocks, and only k rows per query and block leave a task.

Defined results: vectors null, empty, or holding null or non-finite components take no
part; vectors of another length than the query are not compared; every row with the
query's id counts as its own and is left out; a query id that repeats with the same
vector is one query, with other vectors their best rows are merged; repeated candidate rows each take a rank; rows with null id take
no part; ties go to the smaller id; empty tables give no rows. Where products could
leave 64 bits, exact Python integers are used and a score saturates at the range of long.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from attrition.session import ship_package

BIG = 1 << 62


def encode(vectors, scale: float) -> np.ndarray:
    x = np.floor(scale * np.asarray(vectors, dtype=np.float64))
    return x.astype(np.int64) if not x.size or np.abs(x).max() < BIG else np.array([[int(v) for v in r] for r in x], dtype=object)


def add_slices(columns: dict[int, list]) -> list:
    """Sums bitmaps by weight (power of two -> bitmaps) with full and half adders: the slices of the sum, lowest first."""
    out, w = [], 0
    while columns:
        col = columns.pop(w, [])
        carry = columns.setdefault(w + 1, []) if col else []
        while len(col) > 2:
            a, b, c = col.pop(), col.pop(), col.pop()
            x = a ^ b
            col.append(x ^ c)
            carry.append((a & b) | (x & c))
        if len(col) == 2:
            a, b = col
            carry.append(a & b)
            col = [a ^ b]
        out.append(col[0] if col else None)
        w += 1
        if w in columns and not columns[w]:
            del columns[w]
    return out


class Block:
    """Bit slices over the rows of one block."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, drop: int):
        self.ids, self.codes, self.drop, n = ids, codes, drop, len(ids)
        self.low = codes.min(axis=0)
        shifted = (codes - self.low).astype(np.uint64)
        self.width = [int(v).bit_length() for v in shifted.max(axis=0)]
        self.words = -(-n // 64)
        pad = np.zeros(self.words * 64, dtype=bool)

        def bitmap(flags):
            pad[:n] = flags
            return np.packbits(pad, bitorder="little").view(np.uint64)

        self.rows = bitmap(True)
        self.slices = [[bitmap((shifted[:, d] >> np.uint64(b)) & np.uint64(1)) for b in range(drop, w)] for d, w in enumerate(self.width)]
        self.flipped = [[~s for s in own] for own in self.slices]

    def candidates(self, q: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
        """Positions of all rows that can be among the k best; ``allowed`` is a bitmap."""
        columns: dict[int, list] = {}
        error = 0
        for d, weight in enumerate(q.tolist()):
            own = self.slices[d] if weight > 0 else self.flipped[d]
            size = abs(weight)
            error += size * ((1 << min(self.drop, self.width[d])) - 1)
            bit = 0
            while size:
                if size & 1:
                    for b, s in enumerate(own):
                        columns.setdefault(bit + b, []).append(s)
                size >>= 1
                bit += 1
        total = add_slices(columns)
        sure, open_, found, bound = np.zeros(self.words, np.uint64), allowed, 0, 0
        for bit in range(len(total) - 1, -1, -1):  # k-th largest sum, most significant slice first
            hit = open_ & total[bit] if total[bit] is not None else np.zeros_like(open_)
            n = int(np.bitwise_count(hit).sum())
            if found + n >= k:
                open_, bound = hit, bound | 1 << bit
            else:
                sure, found = sure | hit, found + n
                if total[bit] is not None:
                    open_ = open_ & ~total[bit]
        if found + int(np.bitwise_count(open_).sum()) < k:
            keep = allowed  # fewer than k rows
        else:
            least = max(0, bound - (-(-error >> self.drop) if self.drop else 0))
            above, equal = np.zeros(self.words, np.uint64), allowed
            for bit in range(len(total) - 1, -1, -1):  # sum >= least
                s = total[bit] if total[bit] is not None else np.zeros_like(allowed)
                if least >> bit & 1:
                    equal = equal & s
                else:
                    above, equal = above | (equal & s), equal & ~s
            keep = above | equal
        return np.nonzero(np.unpackbits(keep.view(np.uint8), bitorder="little"))[0]

    def search(self, qid: int, q: np.ndarray, k: int):
        """(ids, scores) of the k best rows but the query's own, best first."""
        allowed = self.rows
        if len(own := np.nonzero(self.ids == qid)[0]):
            flags = np.unpackbits(allowed.view(np.uint8), bitorder="little")
            flags[own] = 0
            allowed = np.packbits(flags, bitorder="little").view(np.uint64)
        at = self.candidates(q, allowed, k)
        return best(self.ids[at], self.codes[at] @ q, k)


def best(ids: np.ndarray, scores: np.ndarray, k: int):
    order = np.lexsort((ids, -scores))[:k] if scores.dtype != object else sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]
    return ids[order], scores[order]


def search_block(ids: list, vectors: list, queries: list, k: int, scale: float, drop: int):
    """Rows (query_id, vec_id, score) of one block; queries: (id, codes)."""
    ids, codes = np.array(ids, dtype=np.int64), encode(vectors, scale)
    top = max([1, *(abs(int(v)) for v in (codes.max(), codes.min()))])
    block = Block(ids, codes, drop) if codes.dtype != object else None
    for qid, q in queries:
        if q.dtype == object or block is None or top * max(1, int(np.abs(q).max())) * len(q) >= BIG:
            other = ids != qid
            scores = np.array([sum(int(a) * int(b) for a, b in zip(r, q, strict=True)) for r in codes[other]] + [None], dtype=object)[:-1]
            found, scores = best(ids[other], scores, k)
            scores = [max(-(1 << 63), min((1 << 63) - 1, s)) for s in scores]
        else:
            found, scores = block.search(qid, q, k)
        yield from ((qid, int(i), int(s)) for i, s in zip(found, scores, strict=True))


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: float = 1024.0, drop: int = 2, block_rows: int = 32768, chunk: int = 1024,
          id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for every row where ``is_query`` (a column over ``vec_id``)."""
    ship_package(vectors.sparkSession)
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where(
        "vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    queries = v.where(is_query).distinct()
    chunks = max(1, -(-queries.count() // chunk))
    parts = []
    for c in range(chunks):
        of: dict[int, list] = {}
        for r in queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == c).collect():
            of.setdefault(len(r.v), []).append((r.vec_id, encode([r.v], scale)[0]))

        def run(batches, of=of):
            held: dict[int, tuple] = {}

            def result(size):
                ids, vecs = held.pop(size)
                return pd.DataFrame(list(search_block(ids, vecs, of[size], k, scale, drop)), columns=["query_id", "vec_id", "score"]).astype("int64")

            for b in batches:
                for i, x in zip(b["vec_id"], b["v"], strict=True):
                    if len(x) in of:
                        ids, vecs = held.setdefault(len(x), ([], []))
                        ids.append(i)
                        vecs.append(x)
                        if len(ids) == block_rows:
                            yield result(len(x))
            for size in list(held):
                yield result(size)

        parts.append(v.mapInPandas(run, "query_id long, vec_id long, score long"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark, sf_dir: str) -> DataFrame:
    """Ten best inner products for every hundredth embedding, over all embeddings."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(list_sum(list_transform(list_zip(q.c, r.c), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id AND len(q.c) = len(r.c))
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""

"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document is the set of its hashed words, word beginnings, marks and a few shape words (how often a word
repeats the one before it, share of marks, share of distinct words, in steps), so one weight
vector w over ``2**bits`` slots is shared by all grades. With score s = w.x and ordered
thresholds t1 < t2 < ..., P(grade >= k) = sigmoid(s - tk). That gives the expected grade and
the tail probability used for selection.

The fit takes at most ``most`` labelled rows with a document (those with the smallest hash of their id, all of
them if there are fewer; a documented bound, and the only one): their slots go to the driver,
where full-batch gradient steps with momentum and a ridge penalty run in numpy. Scoring covers
every whole text.

Defined results: null and empty texts are documents without words; labels that are null or
match no document are not used; an id labelled more than once counts each time; with labels of
one grade only, or none, every document gets the highest grade seen (or the top grade) with
probability 1, so nothing is rejected without evidence; repeated ids are scored row by row;
other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from attrition.session import ship_package

TOKEN = re.compile(r"[^\W_]+|[^\w\s]+")


class Slots(dict):
    """Word -> slots of the word and of its first four characters."""

    def __init__(self, bits: int):
        self.mask = (1 << bits) - 1

    def __missing__(self, word: str) -> tuple:
        slots = tuple(zlib.crc32(w.encode("utf-8", "surrogatepass")) & self.mask for w in (word, "\x00^" + word[:4]))
        if len(self) < 150_000 and len(word) <= 64:
            self[word] = slots
        return slots


def features(text: str | None, slots: Slots) -> np.ndarray:
    """Sorted distinct slots of a text."""
    words = TOKEN.findall(text.lower()) if text else []
    distinct = set(words)
    n = max(1, len(words))
    again = sum(map(str.__eq__, words, words[1:])) / n
    marks = sum(not w[0].isalnum() for w in distinct) / max(1, len(distinct))
    shape = [f"\x00again{int(20 * again)}", f"\x00marks{int(20 * marks)}", f"\x00spread{int(10 * len(distinct) / n)}", f"\x00size{len(words).bit_length()}"]
    found = set(chain.from_iterable([slots[w] for w in (*distinct, *shape)]))
    return np.fromiter(sorted(found), np.int64, len(found))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class OrdinalModel:
    """Weights by slot and ordered thresholds; ``grades`` = thresholds + 1."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, bits: int):
        self.weights, self.thresholds, self.bits = weights, thresholds, bits

    def tails(self, slots: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ..."""
        return sigmoid(self.weights[slots].sum() - self.thresholds)


def fit(rows: list, grades: list, top: int, bits: int, steps: int = 150, ridge: float = 2e-4, rate: float = 0.1, each: int = 500) -> OrdinalModel:
    """Maximum likelihood of the cumulative-link model; ``rows``: slots of each document, ``grades``: 0..top."""
    size = 1 << bits
    seen = sorted(set(grades))
    if len(seen) < 2:
        best = seen[0] if seen else top
        return OrdinalModel(np.zeros(size), np.where(np.arange(1, top + 1) <= best, -60.0, 60.0), bits)
    y = np.array(grades)
    blocks = []  # of some documents each, so that a step's temporary arrays stay small beside the slots; every document has slots
    for at in range(0, len(rows), each):
        length = np.array([len(r) for r in rows[at:at + each]])
        blocks.append((slice(at, at + len(length)), np.concatenate(rows[at:at + each]), length, np.cumsum(length) - length))
    w = np.zeros(size)
    share = np.array([max(1, (y >= k).sum()) / (len(y) + 1) for k in range(1, top + 1)])
    first = -np.log(share / (1 - share))
    gap = np.log(np.maximum(1e-3, np.diff(first)))  # thresholds stay ordered: t1, then steps exp(gap)
    p = np.concatenate([w, first[:1], gap])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w, t = p[:size], np.concatenate([[p[size]], p[size] + np.cumsum(np.exp(p[size + 1:]))])
        s = np.concatenate([np.add.reduceat(w[slot], start) for _, slot, _, start in blocks])
        edges = np.concatenate([[-np.inf], t, [np.inf]])
        low, high = sigmoid(s - edges[y]), sigmoid(s - edges[y + 1])  # P(>= y), P(>= y + 1)
        low, high = np.where(y == 0, 1.0, low), np.where(y == top, 0.0, high)
        chance = np.maximum(low - high, 1e-12)
        up, down = low * (1 - low) / chance, high * (1 - high) / chance
        g_s = -(up - down) / len(y)
        g_t = np.array([(np.where(y == k, up, 0) - np.where(y == k - 1, down, 0)).sum() / len(y) for k in range(1, top + 1)])
        g_w = np.zeros(size)
        for of, slot, length, _ in blocks:
            np.add.at(g_w, slot, np.repeat(g_s[of], length))  # in the order of the documents, whatever the blocks
        g = np.concatenate([g_w + ridge * w, [g_t.sum()], [g_t[k:].sum() * np.exp(p[size + k]) for k in range(1, top)]])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return OrdinalModel(p[:size], np.concatenate([[p[size]], p[size] + np.cumsum(np.exp(p[size + 1:]))]), bits)


def train(docs: DataFrame, rated: DataFrame, top: int, most: int = 8_000, bits: int = 18, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Model from ``rated`` (``id_col``, grade 0..top)."""
    import pyarrow as pa

    ship_package(docs.sparkSession)
    chosen = (rated.where(F.col(id_col).isNotNull() & F.col("grade").isNotNull()).select(F.col(id_col).cast("long").alias("rated_id"), F.col("grade").cast("int").alias("grade"))
              .join(docs.select(F.col(id_col).cast("long").alias("doc_id")), F.col("rated_id") == F.col("doc_id"), "left_semi")
              .orderBy(F.xxhash64("rated_id"), "rated_id", "grade").limit(most))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(
        F.broadcast(chosen), F.col("doc_id") == F.col("rated_id")).select("grade", "text")  # at most ``most`` pairs of numbers

    def run(batches):
        slots = Slots(bits)
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t.as_py(), slots).astype("<i4").tobytes() for t in b.column(1)], pa.binary())], names=["grade", "slots"])

    got = sorted((r.grade, bytes(r.slots)) for r in rows.mapInArrow(run, "grade int, slots binary").collect())
    return fit([np.frombuffer(s, "<i4") for _, s in got], [g for g, _ in got], top, bits)


def score(docs: DataFrame, model: OrdinalModel, select: int, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """(row, expected_grade, tail, kept): ``tail`` is P(grade >= select), kept if at least ``least``; ``row`` is a struct of the input's columns."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("expected_grade double, tail double")
    def grade(texts: pd.Series) -> pd.DataFrame:
        of, slots = shared.value, Slots(shared.value.bits)
        tails = np.array([of.tails(features(t, slots)) for t in texts]).reshape(-1, len(of.thresholds))
        return pd.DataFrame({"expected_grade": tails.sum(axis=1), "tail": tails[:, select - 1]})

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, grade(F.col(text_col).cast("string")).alias("g")).select("row", "g.expected_grade", "g.tail", (F.col("g.tail") >= least).alias("kept"))


def graded(labels: DataFrame) -> DataFrame:
    """Grades of the ``labels`` table: 0 toxic, 1 poor, 2 good; null where a label is missing."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality").isNotNull() & F.col("toxic").isNotNull(), F.col("quality") + 1).alias("grade"))


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """Expected grade and probability of the top grade for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, graded(spark.read.parquet(f"{sf_dir}/labels.parquet")), top=2)
    return score(docs, model, select=2).select("row.doc_id", "expected_grade", "tail", "kept")

"""Language identification: known words first, shorter and shorter character n-grams for the rest.

Training counts every word of every labelled training row (partial sums in the tasks, then one
shuffle), and from the word table every n-gram of 1 to ``longest`` characters of the words,
with their ends marked. The model keeps the ``words`` most frequent words of a language and the
``grams`` most frequent n-grams of a language and length (ties by spelling): sizes that bound
what is broadcast, a cut on large tables. What one language keeps has its true count in every
language; whatever none keeps is scored by the next shorter form.

A word known to the model adds its log frequency in each language. An unseen word is scored by
its longest known n-grams: the mean log frequency over its n-grams of that length. The languages'
sums give the prediction (ties to the first in order), ``score`` is its share after softmax.

Defined results: null texts and texts without a letter are ``und`` with score 0, and so is every
text if nothing could be learned; null langs are not learned from; rows with a null id are never
held out; repeated ids are scored row by row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from attrition.llm.common import written
from attrition.session import ship_package

WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list:
    return WORD.findall(text.lower())


def grams_of(word: str, n: int) -> list:
    marked = f"^{word}$"
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


class Model:
    """Log frequencies by language, one row of ``table`` for each known word and n-gram; ``words`` and, for each length, ``grams`` give its row."""

    def __init__(self, languages: list, table: np.ndarray, words: dict, grams: dict):
        self.languages, self.longest = languages, max(grams, default=0)
        self.table, self.words, self.grams, self.seen = table, words, grams, {}

    def backoff(self, word: str) -> list:
        """Rows of the n-grams that score an unseen word: those of the greatest length of which any is known."""
        for n in range(self.longest, 0, -1):
            known, marked = self.grams[n], f"^{word}$"
            found = [known[g] for g in [marked[i:i + n] for i in range(len(marked) - n + 1)] if g in known]
            if found:
                return found
        return []

    def rows_of(self, word: str) -> list:
        """Rows whose mean scores the word."""
        row = self.words.get(word)
        if row is not None:
            return [row]
        found = self.seen.get(word)
        if found is None:
            found = self.backoff(word)
            if len(word) <= 64:
                if len(self.seen) >= 300_000:
                    self.seen.clear()
                self.seen[word] = found
        return found

    def predict(self, text: str | None) -> tuple:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0
        rows, weights, known = [], [], self.words
        for word, n in Counter(words_of(text)).items():
            row = known.get(word)
            if row is not None:
                rows.append(row)
                weights.append(n)
            elif found := self.rows_of(word):
                rows += found
                weights += [n / len(found)] * len(found)
        total = np.array(weights) @ self.table[rows] if rows else np.zeros(len(self.languages))
        best = int(np.argmax(total))
        return self.languages[best], float(1 / np.exp(total - total[best]).sum())


def train(docs: DataFrame, words: int = 30_000, grams: int = 20_000, longest: int = 4, lang_col: str = "lang", text_col: str = "text") -> Model:
    """Model from all rows of ``docs`` with a language."""
    ship_package(docs.sparkSession)

    def count(batches):
        import pyarrow as pa

        held: dict = {}

        def rows():
            flat = [(lang, w, n) for lang, c in held.items() for w, n in c.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*flat, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "key", "n"])

        for b in batches:
            for lang, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held.setdefault(lang, Counter()).update(words_of(t.as_py()))
                if sum(map(len, held.values())) > 300_000:
                    yield rows()
        if any(held.values()):
            yield rows()

    def spell(batches):
        import pyarrow as pa

        for b in batches:
            held: dict = {}
            for lang, w, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for size in range(1, longest + 1):
                    c = held.setdefault((lang, size), Counter())
                    for g in grams_of(w, size):
                        c[g] += n
            flat = [(lang, size, g, n) for (lang, size), c in held.items() for g, n in c.items()]
            if flat:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*flat, strict=True), (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], names=["lang", "size", "key", "n"])

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string"), F.col(text_col).cast("string"))
    counted = rows.mapInArrow(count, "lang string, key string, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    table = written(counted, "lang-words")
    pieces = table.select("lang", "key", "n").mapInArrow(spell, "lang string, size int, key string, n long").groupBy("lang", "size", "key").agg(F.sum("n").alias("n"))
    every = written(table.select("lang", F.lit(0).alias("size"), "key", "n").unionByName(pieces), "lang-counts")
    totals = {(r.lang, r["size"]): (r.total, r.kinds) for r in every.groupBy("lang", "size").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).collect()}
    # the most frequent by spread, exact: a count below the cut of its own salt cannot be above the cut of all
    salted = Window.partitionBy("lang", "size", "salt").orderBy(F.desc("n"), "key")
    overall = Window.partitionBy("lang", "size").orderBy(F.desc("n"), "key")
    most = F.when(F.col("size") == 0, words).otherwise(grams)
    kept = (every.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(64))).withColumn("r", F.row_number().over(salted)).where(F.col("r") <= most)
            .withColumn("r", F.row_number().over(overall)).where(F.col("r") <= most).select("size", "key").distinct())
    # what one language keeps is known to all: each has its own count of it
    kept = every.join(kept, ["size", "key"]).select("lang", "size", "key", "n")
    languages = sorted({lang for lang, _ in totals})
    tables: dict = {size: {} for size in range(longest + 1)}
    spot = {lang: i for i, lang in enumerate(languages)}

    def floor(size: int) -> np.ndarray:
        return np.array([math.log(0.5 / (totals.get((lang, size), (0, 0))[0] + totals.get((lang, size), (0, 0))[1] + 1)) for lang in languages])

    floors = [floor(size) for size in range(longest + 1)]
    rows: list = []
    for r in kept.toLocalIterator():
        total, kinds = totals[r.lang, r["size"]]
        at = tables[r["size"]].setdefault(r.key, len(rows))
        if at == len(rows):
            rows.append(floors[r["size"]].copy())
        rows[at][spot[r.lang]] = math.log((r.n + 0.5) / (total + kinds + 1))
    return Model(languages, np.array(rows).reshape(len(rows), len(languages)), tables[0], {n: tables[n] for n in range(1, longest + 1)})


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                lang, score = zip(*[shared.value.predict(t.as_py()) for t in b.column(1)], strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, train(docs.where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

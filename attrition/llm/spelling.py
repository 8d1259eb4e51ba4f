"""Spelling variants: words one edit apart, each led to a much more frequent spelling.

A word's letters are a set of (letter, how many of it came before), a binary vector; one inserted, deleted
or replaced letter changes at most two of its elements. PartEnum finds all vectors within that Hamming
distance exactly: the elements are dealt to ``PARTS`` parts by a hash, two of which may differ, so two near
words agree on all elements of at least one choice of the other parts. Every choice gives a signature, and
equal signatures are joined. An edit also leaves a word's beginning or its end alone (``ends``), so these
are part of the signature: buckets of anagrams fall apart, and no near pair is missed. Pairs are verified
by edit distance inside the join; what shares a bucket only is never written.

A word's form is its near word of largest count, if that is ``ratio`` times its own; roots are found by
pointer doubling, whose number of rounds follows from the largest count.

Scale: occurrences are counted with partial aggregates; from there on the data is distinct words. Words with
a signature of many partners are an ordinary skewed join key, split by the planner.

Defined results: null and empty texts have no words; a null id reads as an empty one; repeated rows count
again; of equal counts the word that is first in code-point order is the form; an empty table gives no rows;
other columns are ignored; a word of any length is one word.
"""

from __future__ import annotations

import math
import string
from hashlib import blake2b
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from attrition.llm.common import written
from attrition.session import ship_package

LETTERS = "A-Za-zÀ-ÿ"
PARTS = 6


def ends(least: int) -> tuple:
    """Lengths of beginning and end of which one is equal in any two near words of at least ``least`` letters."""
    return (least + 1) // 2, least // 2


def count_words(docs: DataFrame, least: int = 7, twice: int = 2, drop: int | None = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of at least ``least`` letters found at least ``twice`` times. ``drop``: a word loses a letter where this divides the
    checksum of its id and itself (a stand-in for real misspellings)."""
    text = F.translate(F.col(text_col).cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(text, F.lit(f"([{LETTERS}]{{{least},}})"), F.lit(1))).alias("word"))
    if drop:
        shorter = F.expr("concat(substring(word, 1, cast(h % length(word) as int)), substring(word, cast(h % length(word) as int) + 2))")
        runs = (runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word").cast("binary")))
                .withColumn("word", F.when(F.col("h") % drop == 0, shorter).otherwise(F.col("word"))))
    return runs.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= twice)


def _hash(*key) -> int:
    return int.from_bytes(blake2b(repr(key).encode(), digest_size=8).digest(), "little")


class Signer:
    """Signatures of words; hashes of elements are kept."""

    def __init__(self, parts: int, least: int):
        self.parts, (self.head, self.tail) = parts, ends(least)
        self.choices = list(combinations(range(parts), parts - 2))
        self.seeds = np.array([_hash("choice", c) for c in self.choices], dtype=np.uint64)
        self.elements: dict = {}

    def parts_of(self, word: str) -> list:
        """Per part the sum of its elements' hashes."""
        sums, seen, known = [0] * self.parts, {}, self.elements
        for letter in word:
            k = seen[letter] = seen.get(letter, 0) + 1
            if (letter, k) not in known:
                if len(known) >= 100_000:
                    known.clear()
                known[letter, k] = _hash(letter, k)
            h = known[letter, k]
            sums[h % self.parts] ^= h
        return sums

    def signatures(self, words: list) -> np.ndarray:
        """One row a word, one column a choice and end; even if the end is the beginning, odd if it is the last letters."""
        by_part = np.array([self.parts_of(w) for w in words], dtype=np.uint64).reshape(len(words), self.parts)
        held = np.stack([np.bitwise_xor.reduce(by_part[:, list(c)], axis=1) for c in self.choices], axis=1) ^ self.seeds
        head = np.array([_hash("head", w[:self.head]) for w in words], dtype=np.uint64)[:, None]
        tail = np.array([_hash("tail", w[-self.tail:]) for w in words], dtype=np.uint64)[:, None]
        mix, one = np.uint64(0x9E3779B97F4A7C15), np.uint64(1)  # spreads sums of hashes; wraps around
        return np.concatenate([(held + head) * mix & ~one, (held + tail) * mix | one], axis=1)


def signed(words: DataFrame, least: int, parts: int) -> DataFrame:
    """(signature, word, n): every word once for each choice of parts and each end."""
    ship_package(words.sparkSession)

    def run(batches):
        import pyarrow as pa

        signer = Signer(parts, least)
        width = 2 * len(signer.choices)
        for b in batches:
            for start in range(0, b.num_rows, 2000):
                some = b.slice(start, 2000)
                rows = pa.array(np.repeat(np.arange(some.num_rows), width))
                keys = signer.signatures(some.column(0).to_pylist()).reshape(-1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), some.column(0).take(rows), some.column(1).take(rows)], names=["signature", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "signature long, word string, n long")


def near_pairs(words: DataFrame, least: int = 7, parts: int = PARTS) -> DataFrame:
    """(a, a_n, b, b_n), a before b: all pairs of ``words`` (word, n; at least ``least`` letters each) that one edit turns into each other."""
    both = signed(words, least, parts)
    x, y, head = both.alias("x"), both.alias("y"), ends(least)[0]  # the same plan twice: the join's sides share one shuffle
    # what begins alike is found by its beginning alone
    new = F.expr(f"pmod(x.signature, 2L) = 0 or left(x.word, {head}) <> left(y.word, {head})")
    found = x.join(y, (F.col("x.signature") == F.col("y.signature")) & (F.col("x.word") < F.col("y.word")) & new & F.expr("levenshtein(x.word, y.word, 1) = 1"))
    return (found.select(F.col("x.word").alias("a"), F.col("x.n").alias("a_n"), F.col("y.word").alias("b"), F.col("y.n").alias("b_n"))
            .groupBy("a", "b").agg(F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n")))


def group_spellings(words: DataFrame, least: int = 7, ratio: int = 10, parts: int = PARTS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct ``words`` (word, n)."""
    words = written(words, "spelling-words")
    sides = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")),
                    F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))
    best = (near_pairs(words, least, parts).select(F.inline(sides))
            .groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("other_n"), F.col("other").alias("other"))).alias("best")))
    enough = -F.col("best.col1") >= F.col("n") * ratio
    found = written(words.join(best, "word", "left").select(
        "word", F.when(enough, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(enough, -F.col("best.col1")).alias("form_n")), "spelling-forms")
    return found.join(roots(found, ratio), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(found: DataFrame, ratio: int) -> DataFrame:
    """(word, root) of all words with a form. Counts grow by ``ratio`` with every step, which bounds the length of a path."""
    most = found.agg(F.max("n")).first()[0] or 1
    at = found.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(1.0, math.log(most, ratio) + 1)))):
        ahead = at.select(F.col("word").alias("stop"), F.col("root").alias("next"))
        at = written(at.join(ahead, F.col("root") == F.col("stop"), "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
    return at


def op13_spelling(spark, sf_dir: str) -> DataFrame:
    """Spelling variants among all words of all documents."""
    return group_spellings(count_words(spark.read.parquet(f"{sf_dir}/documents.parquet")))

"""Stages of the corpus pipeline: one operator each, documents in, kept documents out.

Every stage returns the columns it was given (the last: pieces). A document is kept or dropped
by its own stage's decision alone; nulls, empty texts and repeated rows are treated as the
operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from attrition.llm import exact_dedup, mixing, ngram_join, packing, quality
from attrition.llm.common import written


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose probability of the top grade is below one half."""
    model = quality.train(docs, quality.graded(spark.read.parquet(f"{sf_dir}/labels.parquet")), top=2)
    return quality.score(docs, model, select=2).where("kept").select("row.*")


def dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts the document with the largest id."""
    return exact_dedup.exact_dedup(docs).where("kept").select("row.*")


def jaccard_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of documents linked by word shingles (five words, 0.8) the one with the smallest id; one without an id is kept.

    A document here is an id with its text: rows that repeat an id with other texts are told apart, each dropped by its own
    links alone; rows equal in both go together. They are known by a 64-bit hash of id and text."""
    own = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text"))
    keyed = docs.select(own.alias("own"), "doc_id", "text")
    found = written(ngram_join.jaccard_classes(keyed, words=5, num=80, den=100, id_col="own").select(F.col("doc_id").alias("own"), F.col("component_id").alias("cls")), "near-classes")
    linked = found.where("cls <> own")
    members = linked.select("own", "cls").unionByName(linked.select(F.col("cls").alias("own"), "cls")).distinct().join(keyed.select("own", "doc_id").distinct(), "own")
    first = members.groupBy("cls").agg(F.min(F.struct("doc_id", "own")).alias("first"))
    dropped = members.join(first, "cls").where("own <> first.own").select("own").distinct()
    return docs.join(dropped, own == dropped["own"], "left_anti")


def mix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents drawn for the target shares of source, language and topic (the observed ones to the power 0.9), 0.8 of all tokens in expectation."""
    out = mixing.mix(docs, ["source", "lang", "topic"], extra={"topic": mixing.topic(F.col("text"))}, power=0.9, keep=mixing.KEEP)
    return out.where("drawn").select("row.*")


def pack_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))

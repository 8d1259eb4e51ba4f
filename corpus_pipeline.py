"""Corpus pipeline: documents in, packed training sequences out.

``STAGES`` names the stages in order; each takes (spark, docs, sf_dir) and works
on all rows its predecessor kept. ``run`` writes every stage's result to the
shared scratch folder and reads it again, so that a lost executor costs one stage.
"""

from __future__ import annotations

from attrition.llm.common import written
from attrition.llm.stages import dedup_stage, jaccard_stage, mix_stage, pack_stage, quality_stage

STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", dedup_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("mix_sources", mix_stage),
    ("packing", pack_stage),
]

#: The classifier is fitted, near copies need components and packing follows the order of
#: arrival: none of it is SQL. tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; the pieces of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

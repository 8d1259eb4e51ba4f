"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from attrition.llm.alignment import op11_alignment
from attrition.llm.bpe import op12_bpe
from attrition.llm.exact_dedup import OP3_SQL, op3_exact_dedup
from attrition.llm.language_id import op5_language_id
from attrition.llm.mixing import op4_mixing
from attrition.llm.ngram_join import op8_ngram_join
from attrition.llm.packing import op6_packing
from attrition.llm.quality import op2_quality
from attrition.llm.revisits import op7_revisits
from attrition.llm.sharding import op10_sharding
from attrition.llm.spelling import op13_spelling
from attrition.llm.token_counts import op1_token_counts
from attrition.llm.topk import OP9_SQL, op9_topk

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_quality": op2_quality,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_mixing": op4_mixing,
    "op5_language_id": op5_language_id,
    "op6_packing": op6_packing,
    "op7_revisits": op7_revisits,
    "op8_ngram_join": op8_ngram_join,
    "op9_topk": op9_topk,
    "op10_sharding": op10_sharding,
    "op11_alignment": op11_alignment,
    "op12_bpe": op12_bpe,
    "op13_spelling": op13_spelling,
}
ORACLES = {"op3_exact_dedup": OP3_SQL, "op9_topk": OP9_SQL}

"""Queries and oracle SQL of this subpackage, as ``__spark_entry__.py`` registers them."""

from __future__ import annotations

from tidemark.llm.bpe import op7_byte_bpe
from tidemark.llm.decontaminate import op6_decontaminate
from tidemark.llm.embedding_join import op5_embedding_near_dedup
from tidemark.llm.licenses import OP4_SQL, op4_license_scan
from tidemark.llm.line_dedup import OP2_SQL, op2_line_dedup
from tidemark.llm.ngram_join import op9_ngram_jaccard_join
from tidemark.llm.quality import op1_quality
from tidemark.llm.substring_dedup import op3_substring_dedup
from tidemark.llm.token_count import op8_token_counts
from tidemark.llm.toxicity import op10_toxicity

QUERIES = {
    "op1_quality": op1_quality,
    "op2_line_dedup": op2_line_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_decontaminate": op6_decontaminate,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_token_counts": op8_token_counts,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL = {
    "op2_line_dedup": OP2_SQL,
    "op4_license_scan": OP4_SQL,
}

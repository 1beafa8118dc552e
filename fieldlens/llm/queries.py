"""The operators' registered queries and their SQL."""

from __future__ import annotations

from fieldlens.llm import (chat, embedding_dedup, fingerprints, hard_negatives, licenses, line_dedup, mixing, ngram_join,
                           packing, pieces, quality, substring_dedup, whitening)

QUERIES = {
    "op1_packing": packing.op1,
    "op2_licenses": licenses.op2,
    "op3_quality": quality.op3,
    "op4_chat": chat.op4,
    "op5_embedding_dedup": embedding_dedup.op5,
    "op6_substring_dedup": substring_dedup.op6,
    "op7_mixing": mixing.op7,
    "op8_line_dedup": line_dedup.op8,
    "op9_fingerprints": fingerprints.op9,
    "op10_ngram_join": ngram_join.op10,
    "op11_pieces": pieces.op11,
    "op12_whitening": whitening.op12,
    "op13_hard_negatives": hard_negatives.op13,
}

ORACLE_SQL = {
    "op4_chat": chat.SQL,
    "op6_substring_dedup": substring_dedup.SQL,
    "op8_line_dedup": line_dedup.SQL,
    "op10_ngram_join": ngram_join.SQL,
    "op13_hard_negatives": hard_negatives.SQL,
}

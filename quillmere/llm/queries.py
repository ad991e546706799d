"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, chat, cover_tree, exact_dedup, licenses, line_dedup, mixing, quality, simhash, url_filter

QUERIES = {
    "op1_cover_tree_top_k": cover_tree.op1_cover_tree_top_k,
    "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_chat_format": chat.op4_chat_format,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_quality_classifier": quality.op8_quality_classifier,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_license_scan": licenses.op10_license_scan,
}
#: No SQL: signatures (2), the tokenizer (5), the classifier (8) and license voting (10) can't be expressed.
SQL = {
    "op1_cover_tree_top_k": cover_tree.OP1_SQL,
    "op3_mix_sources": mixing.OP3_SQL,
    "op4_chat_format": chat.OP4_SQL,
    "op6_url_filter": url_filter.OP6_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
}

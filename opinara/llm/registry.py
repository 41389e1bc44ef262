"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from opinara.llm import chat, decontam, embedding_dedup, html_text, line_dedup, merkle, mixing, quality, simhash, substring_dedup, token_alignment, token_records, url_filter

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_embedding_groups": embedding_dedup.op2_embedding_groups,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_chat": chat.op4_chat,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_quality": quality.op6_quality,
    "op7_token_records": token_records.op7_token_records,
    "op8_simhash": simhash.op8_simhash,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_decontaminate": decontam.op10_decontaminate,
    "op11_token_alignment": token_alignment.op11_token_alignment,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_main_text": html_text.op13_main_text,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op1_mix_sources": mixing.OP1_SQL,
    "op2_embedding_groups": embedding_dedup.OP2_SQL,
    "op3_line_dedup": line_dedup.OP3_SQL,
    "op4_chat": chat.OP4_SQL,
    "op9_url_filter": url_filter.OP9_SQL,
    "op12_merkle_manifest": merkle.OP12_SQL,
    "op13_main_text": html_text.OP13_SQL,
}

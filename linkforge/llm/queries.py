"""Registered queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from linkforge.llm import embeddings, html_text, mixing, packing, pii, secrets, sharding, simhash, topk, toxicity

QUERIES = {
    "op1_secret_scan": secrets.query,
    "op2_source_mixing": mixing.query,
    "op3_bin_completion_packing": packing.query,
    "op4_personal_data": pii.query,
    "op5_simhash_near_duplicates": simhash.query,
    "op6_embedding_near_duplicates": embeddings.query,
    "op7_html_main_text": html_text.query,
    "op8_virtual_slot_sharding": sharding.query,
    "op9_toxicity": toxicity.query,
    "op10_exact_top_k": topk.query,
    "pipeline": corpus_pipeline.run,
}
ORACLE: dict[str, str] = {
    "op6_embedding_near_duplicates": embeddings.ORACLE,
    "op10_exact_top_k": topk.ORACLE,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL

"""The subpackage's query keys and, where SQL can state the result, their oracles."""
from __future__ import annotations

from weblog.llm import (
    bpe,
    chat,
    clustering,
    divergence,
    exact_dedup,
    fingerprint,
    html_text,
    mixing,
    near_dedup,
    quality,
    repeats,
    sharding,
    warc,
)

QUERIES = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_bpe": bpe.op2_bpe,
    "op3_repeats": repeats.op3_repeats,
    "op4_mixing": mixing.op4_mixing,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_warc": warc.op6_warc,
    "op7_html_text": html_text.op7_html_text,
    "op8_fingerprint": fingerprint.op8_fingerprint,
    "op9_chat_format": chat.op9_chat_format,
    "op10_quality": quality.op10_quality,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_centroid_clustering": clustering.op12_centroid_clustering,
    "op13_sharding": sharding.op13_sharding,
}

ORACLES = {
    "op1_near_dedup": near_dedup.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op7_html_text": html_text.ORACLE,
    "op9_chat_format": chat.ORACLE,
    "op11_source_divergence": divergence.ORACLE,
    "op12_centroid_clustering": clustering.ORACLE,
}

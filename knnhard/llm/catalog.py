"""Registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from knnhard.llm import (chat_format, conversation_repair, decontaminate, exact_dedup, hnsw_dedup, html_crf, langid, mixing, secrets,
                         simhash_dedup, token_align, toxicity, warc_zip)

QUERIES: dict[str, Callable] = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_html_crf": html_crf.op4_html_crf,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_mixing": mixing.op6_mixing,
    "op7_langid": langid.op7_langid,
    "op8_secret_forest": secrets.op8_secret_forest,
    "op9_simhash_dedup": simhash_dedup.op9_simhash_dedup,
    "op10_warc_zip": warc_zip.op10_warc_zip,
    "op11_token_align": token_align.op11_token_align,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_embedding_hnsw": hnsw_dedup.op13_embedding_hnsw,
}

ORACLES: dict[str, str] = {
    "op1_chat_format": chat_format.SQL,
    "op3_decontaminate": decontaminate.SQL,
    "op5_exact_dedup": exact_dedup.SQL,
    "op10_warc_zip": warc_zip.SQL,
    "op12_conversation_repair": conversation_repair.SQL,
}

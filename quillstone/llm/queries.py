"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from quillstone.llm import chat, decontaminate, ngram_join, packing, pii, quality, secrets, suffix_dedup, topk, warc

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_chat_format": chat.op3_chat_format,
    "op4_ngram_jaccard": ngram_join.op4_ngram_jaccard,
    "op5_pack": packing.op5_pack,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_topk": topk.op7_topk,
    "op8_warc": warc.op8_warc,
    "op9_quality": quality.op9_quality,
    "op10_secret_links": secrets.op10_secret_links,
}
SQL: dict[str, str] = {
    "op3_chat_format": chat.OP3_SQL,
    "op6_decontaminate": decontaminate.OP6_SQL,
    "op7_topk": topk.OP7_SQL,
    "op8_warc": warc.OP8_SQL,
}

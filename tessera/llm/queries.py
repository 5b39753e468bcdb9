"""The queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from tessera.llm import chat, decontaminate, extract, jaccard, packing, quality, sharding, tokenfile, urls, warc

QUERIES = {
    "op1_chat": chat.op1_chat,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_tokenfile": tokenfile.op3_tokenfile,
    "op4_jaccard": jaccard.op4_jaccard,
    "op5_warc": warc.op5_warc,
    "op6_sharding": sharding.op6_sharding,
    "op7_packing": packing.op7_packing,
    "op8_extract": extract.op8_extract,
    "op9_urls": urls.op9_urls,
    "op10_quality": quality.op10_quality,
}
ORACLES = {
    "op1_chat": chat.OP1_SQL,
    "op2_decontaminate": decontaminate.OP2_SQL,
    "op4_jaccard": jaccard.OP4_SQL,
    "op5_warc": warc.OP5_SQL,
    "op10_quality": quality.OP10_SQL,
}

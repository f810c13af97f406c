"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from dockwatch.llm import (clustering, embedding_dedup, licenses, mixing, packing, sharding, simhash, spelling,
                           substring, suffix_dedup, topk, toxicity, warc)

QUERIES = {
    "op1_simhash": simhash.query,
    "op2_mixing": mixing.query,
    "op3_substring": substring.query,
    "op4_packing": packing.query,
    "op5_toxicity": toxicity.query,
    "op6_sharding": sharding.query,
    "op7_warc": warc.query,
    "op8_licenses": licenses.query,
    "op9_topk": topk.query,
    "op10_embedding_dedup": embedding_dedup.query,
    "op11_suffix_dedup": suffix_dedup.query,
    "op12_spelling": spelling.query,
    "op13_clustering": clustering.query,
}


def statements() -> dict[str, str]:
    return {
        "op6_sharding": sharding.oracle(),
        "op7_warc": warc.ORACLE,
        "op9_topk": topk.ORACLE,
        "op13_clustering": clustering.oracle(),
    }

"""The training-data queries and the SQL that checks them."""

from __future__ import annotations

import corpus_pipeline
from tidewell.llm import checks, decontam, hardneg, jaccard, linededup, merkle, packing, rpforest, tokenbin, topk, urlfilter, warc
from tidewell.llm.hilbert import BITS, op3_hilbert_shards
from tidewell.llm.langid import op1_language_id

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_url_filter": urlfilter.op2_url_filter,
    "op3_hilbert_shards": op3_hilbert_shards,
    "op4_jaccard_join": jaccard.op4_jaccard_join,
    "op5_decontamination": decontam.op5_decontamination,
    "op6_top_k": topk.op6_top_k,
    "op7_packing": packing.op7_packing,
    "op8_warc": warc.op8_warc,
    "op9_line_dedup": linededup.op9_line_dedup,
    "op10_token_matrix": tokenbin.op10_token_matrix,
    "op11_hard_negatives": hardneg.op11_hard_negatives,
    "op12_merkle": merkle.op12_merkle,
    "op13_near_dedup": rpforest.op13_near_dedup,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op2_url_filter": urlfilter.ORACLE,
    "op3_hilbert_shards": checks.hilbert(8, BITS, ["source", "lang", "size_rank"]),
    "op4_jaccard_join": checks.JACCARD,
    "op6_top_k": topk.ORACLE,
    "op8_warc": warc.ORACLE,
    "op11_hard_negatives": hardneg.ORACLE,
    "op12_merkle": checks.MERKLE,
    "op13_near_dedup": rpforest.ORACLE,
}


def queries() -> dict:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)

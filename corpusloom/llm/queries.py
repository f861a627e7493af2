"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from corpusloom.llm import bpe, jaccard, langid, linededup, mih, mixing, periodic, quality, resampling, suffix_dedup, token_store, topk, toxicity

QUERIES = {
    "op1_token_store": token_store.op1,
    "op2_suffix_dedup": suffix_dedup.op2,
    "op3_language_id": langid.op3,
    "op4_exact_top_k": topk.op4,
    "op5_multi_index": mih.op5,
    "op6_byte_bpe": bpe.op6,
    "op7_quality": quality.op7,
    "op8_mix_sources": mixing.op8,
    "op9_jaccard": jaccard.op9,
    "op10_line_dedup": linededup.op10,
    "op11_resample": resampling.op11,
    "op12_periodic_runs": periodic.op12,
    "op13_toxicity": toxicity.op13,
}

SQL = {
    "op4_exact_top_k": topk.OP4_SQL,
    "op8_mix_sources": mixing.OP8_SQL,
    "op9_jaccard": jaccard.OP9_SQL,
    "op10_line_dedup": linededup.OP10_SQL,
    "op11_resample": resampling.OP11_SQL,
    "op12_periodic_runs": periodic.OP12_SQL,
}

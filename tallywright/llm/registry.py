"""Queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from . import chat_format, collocations, decontaminate, exact_dedup, filter_audit, jaccard_join, language_id, licenses, lm_scoring, packing, prefix_bpe, sentencepieces, toxicity


def queries() -> dict:
    return {
        "op1_sentencepiece": sentencepieces.query,
        "op2_packing": packing.query,
        "op3_exact_dedup": exact_dedup.query,
        "op4_decontaminate": decontaminate.query,
        "op5_license_scan": licenses.query,
        "op6_language_id": language_id.query,
        "op7_lm_scoring": lm_scoring.query,
        "op8_jaccard_join": jaccard_join.query,
        "op9_chat_format": chat_format.query,
        "op10_toxicity": toxicity.query,
        "op11_filter_audit": filter_audit.query,
        "op12_collocations": collocations.query,
        "op13_prefix_bpe": prefix_bpe.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": exact_dedup.SQL, "op11_filter_audit": filter_audit.SQL, "op12_collocations": collocations.SQL}

"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from gradeloom.llm.bpe import op1_bpe
from gradeloom.llm.decontamination import OP4_SQL, op4_decontamination
from gradeloom.llm.fingerprints import op2_fingerprints
from gradeloom.llm.lm_scoring import op7_lm_scores
from gradeloom.llm.near_dups import op3_near_dups
from gradeloom.llm.pii import op5_pii
from gradeloom.llm.quality import op10_quality
from gradeloom.llm.ranked_search import OP11_SQL, op11_ranked_search
from gradeloom.llm.secrets import op6_secrets
from gradeloom.llm.simhash import op13_simhash
from gradeloom.llm.spelling import op12_spelling
from gradeloom.llm.token_files import op9_token_files
from gradeloom.llm.url_filters import op8_sql, op8_url_filters


def queries() -> dict[str, Callable]:
    return {
        "op1_bpe": op1_bpe,
        "op2_fingerprints": op2_fingerprints,
        "op3_near_dups": op3_near_dups,
        "op4_decontamination": op4_decontamination,
        "op5_pii": op5_pii,
        "op6_secrets": op6_secrets,
        "op7_lm_scores": op7_lm_scores,
        "op8_url_filters": op8_url_filters,
        "op9_token_files": op9_token_files,
        "op10_quality": op10_quality,
        "op11_ranked_search": op11_ranked_search,
        "op12_spelling": op12_spelling,
        "op13_simhash": op13_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": OP4_SQL, "op8_url_filters": op8_sql(), "op11_ranked_search": OP11_SQL}

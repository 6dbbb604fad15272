"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

#: query name -> module of this subpackage that defines it
_QUERIES = {
    "op1_minhash_near_dedup": "near_dedup",
    "op2_token_output": "token_output",
    "op3_exact_dedup": "exact_dedup",
    "op4_kd_sharding": "sharding",
    "op5_ga_packing": "packing",
    "op6_pfair_mixing": "mixing",
    "op7_ann_search": "ann",
    "op8_toxicity": "toxicity",
    "op9_line_dedup": "line_dedup",
    "op10_language_id": "langid",
    "op11_vector_codes": "vector_codes",
    "op12_fill_in_middle": "fim",
    "op13_url_filter": "url_filter",
}


def queries() -> dict:
    return {name: getattr(import_module(f".{module}", __package__), name) for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    from .exact_dedup import SQL as exact
    from .fim import SQL as middles
    from .line_dedup import SQL as lines
    from .url_filter import SQL as urls
    from .vector_codes import SQL as codes

    return {**exact, **lines, **codes, **middles, **urls}

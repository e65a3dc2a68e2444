"""The queries of this subpackage and their SQL, added by ``__spark_entry__.py`` if the subpackage is there."""

from __future__ import annotations

from importlib import import_module

#: Query name -> (module, function). SQL is the module's ``ORACLE_SQL``, where SQL can express the query.
NAMES = {
    "op1_source_mixing": ("mixing", "op1"),
    "op2_suffix_dedup": ("suffix_dedup", "op2"),
    "op4_exact_topk": ("topk", "op4"),
    "op6_lattice_dedup": ("lattice", "op6"),
    "op3_url_filter": ("urls", "op3"),
    "op7_license_scan": ("licenses", "op7"),
    "op5_language_id": ("langid", "op5"),
    "op8_ngram_jaccard": ("jaccard", "op8"),
    "op9_best_fit_packing": ("packing", "op9"),
    "op10_warc_index": ("warc", "op10"),
}


def queries() -> dict:
    found = {k: getattr(import_module(f"readloom.llm.{m}"), f) for k, (m, f) in NAMES.items()}
    return found


def oracle_sql() -> dict[str, str]:
    found = {k: getattr(import_module(f"readloom.llm.{m}"), "ORACLE_SQL", None) for k, (m, _) in NAMES.items()}
    return {k: v for k, v in found.items() if v}

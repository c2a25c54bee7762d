"""Operators of a training-data pipeline, their queries and the SQL that they can be held against."""

from __future__ import annotations

from importlib import import_module

#: Query name -> (module, function, name of the module's SQL or None).
REGISTRY = {
    "op1_quality_classifier": ("quality_classifier", "op1_quality_classifier", None),
    "op2_line_dedup": ("line_dedup", "op2_line_dedup", "SQL"),
    "op3_minhash_dedup": ("minhash_dedup", "op3_minhash_dedup", None),
    "op4_media_columns": ("media_columns", "op4_media_columns", None),
    "op5_token_counts": ("token_counts", "op5_token_counts", None),
    "op6_decontaminate": ("decontaminate", "op6_decontaminate", None),
    "op7_license_scan": ("license_scan", "op7_license_scan", "SQL"),
    "op8_secret_scan": ("secret_scan", "op8_secret_scan", None),
    "op9_source_mix": ("source_mix", "op9_source_mix", "SQL"),
    "op10_suffix_dedup": ("suffix_dedup", "op10_suffix_dedup", None),
    "op11_parity_join": ("parity_join", "op11_parity_join", None),
    "op12_spelling_variants": ("spelling_variants", "op12_spelling_variants", None),
    "op13_divergence_audit": ("divergence_audit", "op13_divergence_audit", "SQL"),
}


def queries() -> dict:
    """The queries of the operators, by name."""
    return {name: getattr(import_module(f"{__name__}.{module}"), function) for name, (module, function, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    """SQL for DuckDB, for the queries that SQL can express."""
    return {name: getattr(import_module(f"{__name__}.{module}"), sql) for name, (module, _, sql) in REGISTRY.items() if sql}

"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_MODULES = {
    "op8_line_dedup": "line_dedup",
    "op9_license_scan": "license_scan",
    "op4_toxicity": "toxicity_gru",
    "op10_quality": "quality_crf",
    "op5_substring_dedup": "substring_dedup",
    "op7_ngram_join": "ngram_join",
    "op6_decontamination": "decontamination",
    "op1_packing": "packing",
    "op2_sharding": "sharding",
    "op3_exact_dedup": "exact_dedup",
    "op11_divergence": "divergence",
    "op12_mixing": "mixing",
    "op13_fill_middle": "fill_middle",
}
_SQL = {
    "op9_license_scan": ("license_scan", "OP9_SQL"), "op5_substring_dedup": ("substring_dedup", "OP5_SQL"), "op6_decontamination": ("decontamination", "OP6_SQL"), "op3_exact_dedup": ("exact_dedup", "OP3_SQL"),
    "op11_divergence": ("divergence", "OP11_SQL"), "op12_mixing": ("mixing", "OP12_SQL"), "op13_fill_middle": ("fill_middle", "OP13_SQL"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"siteloom.llm.{module}"), name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f"siteloom.llm.{module}"), key) for name, (module, key) in _SQL.items()}

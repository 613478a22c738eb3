"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("quality_rules", "passage_dedup", "html_text", "masked_lm", "kd_search", "packing", "source_mix", "quality_mil", "suffix_dedup", "partenum", "token_counts", "alignment", "ball_kmeans")
_FOUND = [import_module(f"{__package__}.{name}") for name in MODULES]  # a module that cannot be imported fails here, not when queries are asked for


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {m.QUERY: m.query for m in _FOUND}


def oracle_sql() -> dict[str, str]:
    return {m.QUERY: m.ORACLE_SQL for m in _FOUND if m.ORACLE_SQL}

"""Queries of this subpackage by name, and the SQL that some of them equal."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Query name -> module of this package that defines query() and, where SQL can express it, ORACLE_SQL.
MODULES = {
    "op1_nearest_vectors": "ann",
    "op2_near_duplicates": "dedup",
    "op3_language_id": "langid",
    "op4_mix_sources": "mixing",
    "op5_transport_streams": "mpegts",
    "op6_url_lists": "urls",
    "op7_personal_data": "pii",
    "op8_sample_segmentations": "segment",
    "op9_language_model": "lblm",
    "op10_quality": "quality",
}


def _call(module: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: importlib.import_module(f"millwright.llm.{module}").query(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _call(module) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"millwright.llm.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}

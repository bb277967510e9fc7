"""Queries of the subpackage and their SQL, in the form that __spark_entry__.py registers."""

from __future__ import annotations

import importlib
from collections.abc import Callable

#: Query, module of this subpackage.
MODULES = {
    "op1_language_id": "language_id",
    "op2_secret_scan": "secret_scan",
    "op3_near_dup": "near_dup",
    "op4_byte_bpe": "byte_bpe",
    "op5_decontaminate": "decontaminate",
    "op6_html_text": "html_text",
    "op7_line_dedup": "line_dedup",
    "op8_span_dedup": "span_dedup",
    "op9_exact_topk": "topk",
    "op10_class_lm": "class_lm",
}


def _module(name: str):
    return importlib.import_module(f"lumenframe.llm.{MODULES[name]}")


def queries() -> dict[str, Callable]:
    """Name to function(spark, sf_dir)."""
    return {name: getattr(_module(name), name) for name in MODULES}


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL, of the queries that SQL can express."""
    return {name: _module(name).ORACLE for name in MODULES if hasattr(_module(name), "ORACLE")}

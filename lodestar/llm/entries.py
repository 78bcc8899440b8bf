"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query by the module that has it.
MODULES = {
    "op1_bpe": "bpe",
    "op2_chat": "chat",
    "op3_media": "media",
    "op4_lm": "lm",
    "op5_winnow": "winnow",
    "op6_urls": "urls",
    "op7_quality": "quality",
    "op8_mixing": "mixing",
    "op9_warc": "warc",
    "op10_neardup": "neardup",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"lodestar.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, module in MODULES.items():
        sql = getattr(import_module(f"lodestar.llm.{module}"), "ORACLE_SQL", {}).get(name)
        if sql:
            out[name] = sql
    return out

"""The query catalogue: name -> (callable(spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame

MODULES: tuple[str, ...] = ("prices", "documents", "entities", "evaluation", "records", "verification", "stores", "folding", "io", "chain",
    "names")


def _entries() -> dict[str, tuple]:
    out: dict[str, tuple] = {}
    for m in MODULES:
        out |= importlib.import_module(f"factloom.plans.{m}").QUERIES
    return out


def queries() -> dict:
    return {k: v[0] for k, v in _entries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in _entries().items() if v[1]}

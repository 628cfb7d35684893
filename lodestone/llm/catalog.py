"""Registry of the subpackage's queries."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import lodestone.llm as package

#: Modules of operators; each has QUERIES and ORACLE.
MODULES = sorted(m.name for m in pkgutil.iter_modules(package.__path__) if m.name.startswith("op_"))


def _modules():
    return [importlib.import_module(f"lodestone.llm.{name}") for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for m in _modules() for k, sql in m.ORACLE.items()}

"""Every query of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("curation", "conversations", "training", "evaluation", "serving", "requests", "files", "extraction", "results", "relational")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

for _name in MODULES:
    _module = importlib.import_module(f"tessera.plans.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)

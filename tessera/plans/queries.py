"""All queries of the library, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import catalogue, numbers, shapes  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for name, f, _ in catalogue._ENTRIES}
ORACLES: dict[str, str] = {name: sql for name, _, sql in catalogue._ENTRIES if sql}

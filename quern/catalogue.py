"""All queries of the engine by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.plans import batches, details, groups, languages, packages, projects, reports, structures

_AREAS = (packages, batches, details, groups, languages, reports, projects, structures)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for area in _AREAS for k, f in area.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: q for area in _AREAS for k, q in area.ORACLE_SQL.items()}

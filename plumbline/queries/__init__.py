"""The registered queries of the reference-style operators and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.queries import attributes, runs, shapes, space, tables
from plumbline.queries.base import Query

_MODULES = (attributes, tables, shapes, space, runs)

QUERIES: dict[str, Query] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole quality specification: stop conditions, severities, issue filters, duplicates."""
    return QUERIES["quality_specification"](spark, sf_dir)

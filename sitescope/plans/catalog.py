"""All registered queries of the analytics engine, and the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitescope.plans import q_checks, q_records, q_scoring, q_spatial, q_values

Query = Callable[[SparkSession, str], DataFrame]
_FAMILIES = (q_scoring, q_values, q_spatial, q_records, q_checks)
_DECIMAL = re.compile(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])")


def doubles(sql: str) -> str:
    """SQL whose decimal literals are doubles, as they are in Spark plans here."""
    return _DECIMAL.sub(r"CAST(\1 AS DOUBLE)", sql)


QUERIES: dict[str, Query] = {name: q for family in _FAMILIES for name, q in family.QUERIES.items()}
SQL: dict[str, str] = {name: doubles(sql) for family in _FAMILIES for name, sql in family.SQL.items()}

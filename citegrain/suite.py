"""All queries of the library on the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import audits, exporting, graphs, landing, series, texts, wholes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _family in (graphs, series, audits, texts, landing, wholes, exporting):
    QUERIES |= _family.QUERIES
    ORACLE_SQL |= _family.ORACLE_SQL

#: The traversal-weighted main path of a citation network.
FLAGSHIP = "global_main_path"

"""Every query of the library's core, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from feedloop.plans import library, loops, records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**library.QUERIES, **loops.QUERIES, **records.QUERIES}
SQL: dict[str, str] = {**library.SQL, **loops.SQL, **records.SQL}

"""Registered queries: operator -> (Spark query, SQL giving the same rows)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsig.plans.driver_tables import SQL_FLEET

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Instants as wall-clock columns, the type the SQL side has."""
    instants = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp"]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in instants})


def register(name: str, sql: str | None = None, fleet: bool = True, recursive: bool = False):
    """Register a query; ``sql`` is a list of CTEs and a SELECT over the fleet tables, or a whole statement."""

    def add(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: plain(fn(spark, sf_dir))
        if sql is not None:
            body = sql.strip()
            if fleet:
                joined = f"{SQL_FLEET} {body}" if body.upper().startswith("SELECT") else f"{SQL_FLEET}, {body}"
                body = f"WITH {'RECURSIVE ' if recursive else ''}{joined}"
            ORACLES[name] = body
        return fn

    return add

"""Daily aggregates and last values kept by Structured Streaming."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsig import schema
from fleetsig.operators.alerts import Rule
from fleetsig.operators.metadata import select_signals

LATE = "4 days"


def stored_events(spark: SparkSession, root: str) -> DataFrame:
    """Events of the stored table as a stream, file by file."""
    return spark.readStream.schema(schema.EVENTS).parquet(f"{root}/data")


def deduplicated(events: DataFrame, late: str = LATE) -> DataFrame:
    """Each event key once, remembered as long as late rows may come."""
    return events.withWatermark("time", late).dropDuplicatesWithinWatermark(schema.EVENT_KEY)


def daily_delta(events: DataFrame, parameters: DataFrame, signal: Mapping, name: str = "delta", late: str = LATE) -> DataFrame:
    """max - min per UTC day, instrument and parameter name; rows later than ``late`` are not counted.

    Repeated rows do not change a maximum or minimum, so no de-duplication state is kept.
    """
    rows = select_signals(events, parameters, signal, attrs=["param_name"]).withWatermark("time", late)
    return (
        rows.groupBy(F.window("time", "1 day"), "instrument_id", "param_name")
        .agg((F.max("value_num") - F.min("value_num")).alias(name))
        .select(F.col("window.start").alias("day"), "instrument_id", "param_name", name)
    )


def last_values(events: DataFrame, parameters: DataFrame, rule: Rule, by: Sequence[str] = ("instrument_id",)) -> DataFrame:
    """Last numeric value per instrument of a rule's signal; partial aggregates meet per key, in update mode."""
    rows = select_signals(events, parameters, rule.signal).where("value_num IS NOT NULL")
    return rows.groupBy(*by).agg(F.max("time").alias("time"), F.max_by("value_num", "time").alias("last_value"))


def firing(latest: DataFrame, rule: Rule, now) -> DataFrame:
    """Which of the last values make the rule fire at ``now``."""
    at = F.lit(now).cast("timestamp")
    fresh = (F.col("time") > at - F.make_dt_interval(secs=F.lit(rule.lookback_seconds))) & (F.col("time") <= at)
    return latest.where(fresh & (F.col("last_value") == F.lit(rule.equals)))

"""Time spent per state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetsig.functions.times import DAY, day_of, elapsed, micros, whole
from fleetsig.operators.timeline import neighbours


def credited(sig: DataFrame, by: Sequence[str]) -> DataFrame:
    """Samples with ``state`` and the microseconds until the next sample of the group (0 for the last)."""
    known = sig.where(F.col("value_num").isNotNull())
    return (
        neighbours(known, by, "time", next={"_next": "time"})
        .withColumns({
            "state": whole("value_num", "long"),
            "micros": F.coalesce(elapsed("time", "_next"), F.lit(0)),
        })
        .drop("_next", "value_num")
    )


def state_durations(sig: DataFrame, by: Sequence[str]) -> DataFrame:
    """Total microseconds per group and state; time counts for the earlier sample's state."""
    return credited(sig.select(*by, "time", "value_num"), by).groupBy(*by, "state").agg(F.sum("micros").alias("micros"))


def daily_state(sig: DataFrame, key: Sequence[str] = ("instrument_id",)) -> DataFrame:
    """Mergeable state aggregate per key and UTC day: first and last sample and a map of durations."""
    by = [*key, "day"]
    dated = sig.select(*key, "time", "value_num").withColumn("day", day_of("time"))
    # one row per state first: what is gathered afterwards has the size of the enumeration
    per_state = (
        credited(dated, by)
        .groupBy(*by, "state")
        .agg(F.sum("micros").alias("micros"), F.min("time").alias("_first"), F.max("time").alias("_last"))
    )
    return per_state.groupBy(*by).agg(
        F.min("_first").alias("first_time"),
        F.min_by("state", "_first").alias("first_state"),
        F.max("_last").alias("last_time"),
        F.max_by("state", "_last").alias("last_state"),
        F.map_from_entries(F.collect_list(F.struct("state", "micros"))).alias("durations"),
    )


def interpolated_daily(daily: DataFrame, codes: DataFrame, key: Sequence[str] = ("instrument_id",)) -> DataFrame:
    """Microseconds per day in the state ``codes.running``.

    The state of the last earlier day with samples is carried into the day, and the last state of the day
    to its end. Days without samples have no row; before the very first sample nothing counts.
    """
    order = Window.partitionBy(*key, "_lane").orderBy("day")
    lanes = codes.withColumnRenamed("param_id", "_lane") if "param_id" in codes.columns else codes.withColumn("_lane", F.lit(0))
    is_running = F.col("running")
    day_us = micros("day")
    carried_in = F.when(F.col("_before") == is_running, micros("first_time") - day_us).otherwise(0)
    carried_out = F.when(F.col("last_state") == is_running, day_us + DAY - micros("last_time")).otherwise(0)
    inside = F.coalesce(F.try_element_at("durations", is_running.cast("long")), F.lit(0))
    return (
        daily.join(lanes.select(*key, "_lane", "running"), list(key))
        .withColumn("_before", F.lag("last_state").over(order))
        .select(*key, "day", (inside + carried_in + carried_out).alias("running_micros"))
    )


def session_states(sig: DataFrame, tag, codes: DataFrame) -> DataFrame:
    """Total and running time per session, and whether it was ever terminated.

    ``tag`` adds the session columns to samples. Time is credited up to the next sample only if that sample
    still lies in the session.
    """
    timed = neighbours(
        sig.where(F.col("value_num").isNotNull()).select("instrument_id", "param_id", "time", "value_num"),
        ["instrument_id", "param_id"],
        "time",
        next={"_next": "time"},
    )
    credit = F.when(F.col("_next") < F.col("end_time"), elapsed("time", "_next")).otherwise(0)
    session = ["instrument_id", "session_id", "start_time", "end_time"]
    # added up per state first, so that codes meet a few rows per session instead of every sample
    per_state = (
        tag(timed)
        .groupBy(*session, "param_id", whole("value_num", "long").alias("state"))
        .agg(F.sum(credit).alias("micros"))
    )
    return (
        per_state.join(codes, ["instrument_id", "param_id"])
        .groupBy(*session)
        .agg(
            F.sum(F.when(F.col("state") == F.col("running"), F.col("micros")).otherwise(0)).alias("running_micros"),
            F.bool_or(F.col("state") == F.col("terminated")).alias("has_terminated"),
        )
        .select(
            "instrument_id",
            "session_id",
            "start_time",
            elapsed("start_time", "end_time").alias("total_micros"),
            "running_micros",
            "has_terminated",
        )
    )

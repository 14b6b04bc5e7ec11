"""Cumulative counters: per session, per day, per bucket."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetsig.functions.times import day_of, time_bucket
from fleetsig.operators.timeline import neighbours


def with_previous(sig: DataFrame, key: Sequence[str] = ("instrument_id", "param_id")) -> DataFrame:
    """Samples with value and time of the sample before, as the reset-aware totals need them."""
    return neighbours(sig, key, "time", prev={"prev_value": "value_num", "prev_time": "time"})


def spread(value: Column) -> Column:
    """max - min: what a counter gained if it never went back."""
    return F.max(value) - F.min(value)


def peaks_before(reset_to: float, among: Column | None = None) -> Column:
    """Sum of the values just before each sample equal to ``reset_to``, inside a session.

    Needs ``prev_value``, ``prev_time`` and the session's ``start_time``. Also a repeated reset value counts.
    """
    here = (F.col("value_num") == F.lit(reset_to)) & (F.col("prev_time") >= F.col("start_time"))
    if among is not None:
        here = here & among
    return F.coalesce(F.sum(F.when(here, F.col("prev_value"))), F.lit(0.0))


def last_value(among: Column | None = None) -> Column:
    at = F.col("time") if among is None else F.when(among, F.col("time"))
    return F.coalesce(F.max_by("value_num", at), F.lit(0.0))


def session_counter(tagged: DataFrame, mode: str, session: Sequence[str] = ("instrument_id", "session_id", "start_time")) -> DataFrame:
    """Counter total per session: ``range``, ``max``, ``reset_to_1`` or ``reset_to_0``."""
    totals = {
        "range": spread(F.col("value_num")),
        "max": F.max("value_num"),
        "reset_to_1": peaks_before(1) + last_value(),
        "reset_to_0": peaks_before(0),
    }
    return tagged.groupBy(*session).agg(totals[mode].alias("total"))


def daily_delta(sig: DataFrame, by: Sequence[str], name: str = "delta") -> DataFrame:
    """max - min per UTC day and group."""
    return sig.groupBy(day_of("time").alias("day"), *by).agg(spread(F.col("value_num")).alias(name))


def daily_delta_pivoted(sig: DataFrame, columns: Mapping[str, str], by: Sequence[str] = ("instrument_id",)) -> DataFrame:
    """The same with one column per parameter name, in one aggregation."""
    return sig.groupBy(day_of("time").alias("day"), *by).agg(
        *[spread(F.when(F.col("param_name") == p, F.col("value_num"))).alias(n) for n, p in columns.items()]
    )


def deltas(samples: DataFrame, key: Sequence[str], ts: str, values: Sequence[str]) -> DataFrame:
    """Difference of each counter to the sample before, as ``delta_<name>``; negative at a reset."""
    prev = {f"_prev_{v}": v for v in values}
    return (
        neighbours(samples, key, ts, prev=prev)
        .withColumns({f"delta_{v}": F.col(v) - F.col(f"_prev_{v}") for v in values})
        .drop(*prev)
    )


def bucket_deltas(samples: DataFrame, key: Sequence[str], ts: str, values: Mapping[str, Column], step: float) -> DataFrame:
    """Reset-aware gain per bucket: a drop restarts the counter, so the new value is the gain.

    Only steps between two samples of one bucket count. ``values`` maps output names to counters.
    """
    rows = samples.select(*key, ts, *[c.alias(n) for n, c in values.items()])
    prev = {f"_prev_{n}": n for n in values} | {"_prev_ts": ts}
    stepped = neighbours(rows, key, ts, prev=prev).withColumn("time", time_bucket(ts, step))
    same = F.col("_prev_ts") >= F.col("time")

    def gain(n: str) -> Column:
        now, before = F.col(n), F.col(f"_prev_{n}")
        return F.sum(F.when(same, F.when(now < before, now).otherwise(now - before)).otherwise(0)).alias(n)

    return stepped.groupBy("time", *key).agg(*[gain(n) for n in values])

"""Intervals derived from signals, and the algebra on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetsig.functions.times import DAY, day_of, elapsed, micros, whole
from fleetsig.operators.timeline import SLICE, neighbours, running, slice_of, slice_start, slice_width, sliced


def change_points(sig: DataFrame, key: Sequence[str], ts: str, value: str) -> DataFrame:
    """Rows whose value differs from the row before, with the time of the next such row.

    The first row of a key and rows next to a NULL value are not changes. Within a slice only its first row
    and the rows that differ from their predecessor go on; the slice summaries settle whether the first row
    is a change and when the next change after the slice happens.
    """
    group = [*key, SLICE]
    inside = Window.partitionBy(*group).orderBy(ts)
    kept = (
        sliced(sig.select(*key, ts, value), key, ts)
        .withColumns({"_prev": F.lag(value).over(inside), "_first": F.lag(ts).over(inside).isNull()})
        .withColumn("_step", ~F.col("_first") & (~F.col(value).eqNullSafe(F.col("_prev"))))
        .where(F.col("_first") | F.col("_step"))
    )
    real = F.col("_step") & F.col(value).isNotNull() & F.col("_prev").isNotNull()
    per_slice = kept.groupBy(*group).agg(
        F.min_by(value, ts).alias("_head"),
        F.max_by(value, ts).alias("_tail"),
        F.min(ts).alias("_start"),
        F.min(F.when(real, F.col(ts))).alias("_inner"),
    )
    forward = Window.partitionBy(*key).orderBy(SLICE)
    later = Window.partitionBy(*key).orderBy(F.col(SLICE).desc()).rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        per_slice.withColumn("_before", F.lag("_tail").over(forward))
        .withColumn("_change", F.when(F.col("_head") != F.col("_before"), F.col("_start")).otherwise(F.col("_inner")))
        .select(*group, "_before", F.min("_change").over(later).alias("_beyond"))
    )
    return (
        kept.join(edges, group)
        .where(real | (F.col("_first") & (F.col(value) != F.col("_before"))))
        .withColumn("_next", F.coalesce(F.lead(ts).over(inside), F.col("_beyond")))
        .select(*key, ts, value, "_next")
    )


def sessions(
    sig: DataFrame,
    key: Sequence[str] = ("instrument_id", "param_id"),
    ts: str = "time",
    value: str = "value_num",
    idle: float = 0,
) -> DataFrame:
    """Change-point sessions: from a change to a non-idle value until the next change.

    A session running at the first sample is not seen; the last one is open (NULL end). Identifiers may
    repeat, so a session is known by key, identifier and start.
    """
    return (
        change_points(sig, key, ts, value)
        .where(F.col(value) != F.lit(idle))
        .select(
            *key,
            whole(value).alias("session_id"),
            F.col(ts).alias("start_time"),
            F.col("_next").alias("end_time"),
        )
    )


def tag_points(
    points: DataFrame,
    spans: DataFrame,
    key: Sequence[str],
    ts: str = "time",
    carry: Sequence[str] = ("session_id",),
) -> DataFrame:
    """Add to each point the span ``[start_time, end_time)`` it lies in; points outside are dropped.

    Spans of one key must not overlap; open and empty spans hold no points. Spans are cut at slice edges,
    so every slice finds its span among its own rows: one shuffle, no range join.
    """
    cols = ["start_time", "end_time", *carry]
    pieces = (
        spans.where(F.col("start_time") < F.col("end_time"))
        .withColumn(
            SLICE,
            F.explode(
                F.sequence(slice_of("start_time"), F.floor((micros("end_time") - 1) / slice_width()).cast("long"))
            ),
        )
        .select(
            *key,
            SLICE,
            F.greatest("start_time", slice_start(SLICE)).alias(ts),
            F.lit(0).alias("_kind"),
            F.struct(*cols).alias("_span"),
        )
    )
    rows = points.withColumns({SLICE: slice_of(ts), "_kind": F.lit(1)})
    asof = Window.partitionBy(*key, SLICE).orderBy(ts, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.unionByName(pieces, allowMissingColumns=True)
        .withColumn("_span", F.last("_span", ignorenulls=True).over(asof))
        .where((F.col("_kind") == 1) & (F.col(ts) < F.col("_span.end_time")))
        .select(*points.columns, *[F.col(f"_span.{c}").alias(c) for c in cols])
    )


def off_periods(sig: DataFrame, key: Sequence[str] = ("instrument_id",), off_value: float = 0) -> DataFrame:
    """From a sample equal to ``off_value`` to the next sample, whatever that is; an open end is dropped."""
    return (
        neighbours(sig.select(*key, "time", "value_num"), key, "time", next={"end_time": "time"})
        .where((F.col("value_num") == F.lit(off_value)) & F.col("end_time").isNotNull())
        .select(*key, F.col("time").alias("start_time"), "end_time")
    )


def state_intervals(labelled: DataFrame, keep: Sequence[str], key: Sequence[str] = ("instrument_id",)) -> DataFrame:
    """Intervals of the kept states; other states are bridged because they go before the ordering.

    ``labelled`` has the key, ``time`` and ``state``. The last interval is open (NULL end).
    """
    known = labelled.where(F.col("state").isin(*keep)).select(*key, "time", "state")
    return neighbours(known, key, "time", next={"end_time": "time"}).select(
        *key, "state", F.col("time").alias("start_time"), "end_time"
    )


def drop_overlapping(intervals: DataFrame, blockers: DataFrame, key: Sequence[str] = ("instrument_id",)) -> DataFrame:
    """Keep the closed intervals that overlap no blocker.

    An interval is hit iff the latest end among the blockers starting before its end lies after its start.
    That is one running maximum over both sets in time order, so no pair is ever formed.
    """
    cols = [c for c in intervals.columns if c not in key]
    probes = intervals.where(F.col("end_time").isNotNull()).select(
        *key,
        F.col("end_time").alias("_at"),
        F.lit(0).alias("_kind"),
        F.lit(None).cast("timestamp").alias("_until"),
        F.struct(*cols).alias("_row"),
    )
    marks = blockers.select(
        *key, F.col("start_time").alias("_at"), F.lit(1).alias("_kind"), F.col("end_time").alias("_until")
    )
    reach = running(
        probes.unionByName(marks, allowMissingColumns=True), key, "_at", ["_kind"], maxima={"_reach": "_until"}
    )
    hit = F.coalesce(F.col("_reach") > F.col("_row.start_time"), F.lit(False))
    return reach.where((F.col("_kind") == 0) & ~hit).select(*key, "_row.*").select(*intervals.columns)


def split_by_day(intervals: DataFrame) -> DataFrame:
    """One row per interval and UTC day it touches; an end at midnight touches the new day for 0 seconds."""
    days = F.sequence(day_of("start_time"), day_of("end_time"), F.expr("INTERVAL 1 DAY"))
    rest = [c for c in intervals.columns if c not in ("start_time", "end_time")]
    return (
        intervals.where(F.col("start_time") < F.col("end_time"))
        .withColumn("_day", F.explode(days))
        .select(
            *rest,
            F.col("_day").cast("date").alias("day"),
            F.greatest("start_time", "_day").alias("interval_start"),
            F.least(F.col("end_time"), F.timestamp_micros(micros("_day") + DAY)).alias("interval_end"),
        )
    )


def seconds_per_day(split: DataFrame, by: Sequence[str] = ("instrument_id", "state", "day")) -> DataFrame:
    """Seconds spent per group; microseconds are summed as integers."""
    total = F.sum(elapsed("interval_start", "interval_end"))
    return split.groupBy(*by).agg((total / F.lit(1e6)).alias("seconds"))

"""Keeping derived tables up to date."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsig.plans.views import VIEWS, Fleet
from fleetsig.sources.lake import Lake

# Views kept as day buckets; the others are recomputed whole.
DAILY = (
    "data_counters_daily", "image_counters_daily", "load_counters_daily", "epu_state_daily", "tomo_state_daily",
    "epu_running_daily", "tomo_running_daily",
)


def refresh_all(lake: Lake, views=tuple(VIEWS)) -> None:
    """Recompute views in dependency order; a view reads the views it depends on as stored."""
    fleet = lake.fleet()
    for name, (fn, needs) in VIEWS.items():
        if name in views:
            df = fn(fleet, *[_stored(lake, fleet, n) for n in needs])
            if name in DAILY:
                lake.write_view(name, dated(df), "bucket_day")
            else:
                lake.write_view(name, df)


def _stored(lake: Lake, fleet: Fleet, name: str) -> DataFrame:
    fn = VIEWS[name][0]
    return lake.view(name, fn(fleet).schema)


def dated(df: DataFrame) -> DataFrame:
    return df.withColumn("bucket_day", F.to_date("day"))


def window(now: datetime, start_offset: int = 4, end_offset: int = 1) -> tuple[date, date]:
    """Days [D - start_offset, D - end_offset): by default D-4, D-3 and D-2."""
    today = now.date()
    return today - timedelta(start_offset), today - timedelta(end_offset)


def limited(fleet: Fleet, start: date, end: date) -> Fleet:
    """The fleet with the events of some days only; prunes day partitions where there are any."""
    inside = (F.col("time") >= F.lit(str(start)).cast("timestamp")) & (F.col("time") < F.lit(str(end)).cast("timestamp"))
    if "day" in fleet.data.columns:
        inside = inside & (F.col("day") >= F.lit(start)) & (F.col("day") < F.lit(end))
    return replace(fleet, data=fleet.data.where(inside))


def merged(materialized: DataFrame, fresh: DataFrame, start: date, end: date) -> DataFrame:
    """Stored buckets outside [start, end) and fresh ones inside."""
    day = F.to_date("day")
    outside = (day < F.lit(start)) | (day >= F.lit(end))
    return materialized.where(outside).unionByName(fresh.where(~outside))


def refresh_window(lake: Lake, name: str, now: datetime, start_offset: int = 4, end_offset: int = 1) -> None:
    """Recompute the day buckets of a window from the events of those days alone.

    A view over daily states carries the last earlier state into a day, so it reads the stored daily states
    (all of them small) and only its own buckets of the window are replaced.
    """
    start, end = window(now, start_offset, end_offset)
    fn, needs = VIEWS[name]
    fleet = lake.fleet()
    if needs:
        rows = fn(fleet, *[_stored(lake, fleet, n) for n in needs])
    else:
        rows = fn(limited(fleet, start, end))
    day = F.to_date("day")
    fresh = dated(rows.where((day >= F.lit(start)) & (day < F.lit(end))))
    lake.write_view_days(name, fresh, "bucket_day", start, end)


def realtime(materialized: DataFrame, fleet: Fleet, fn: Callable[[Fleet], DataFrame], watermark: date) -> DataFrame:
    """Stored buckets before the watermark and a live aggregate of the newer events."""
    live = fn(limited(fleet, watermark, date(9999, 12, 31)))
    return materialized.where(F.to_date("day") < F.lit(watermark)).unionByName(live)

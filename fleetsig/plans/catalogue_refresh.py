"""Registered refreshes of stored views: a lake is filled, refreshed, filled further and refreshed by increments."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsig.plans import catalogue_analytics, incremental, refresh, views  # noqa: F401  (the SQL of the analytics is wrapped)
from fleetsig.plans.driver_tables import fleet
from fleetsig.plans.registry import ORACLES, plain, register
from fleetsig.session import checkpoint_dir
from fleetsig.sources.lake import Lake

# view -> (registered query with the same rows, time, name, up to three figures); the expressions are good for both engines
_SHAPES = {
    "tem_off": ("an20_off_periods", "start_time", "CAST(end_time AS STRING)", ["0", "0", "0"]),
    "vacuum_state_daily": ("an26_state_seconds_per_day", "CAST(day AS TIMESTAMP)", "state", ["seconds", "0", "0"]),
    "epu_sessions": ("an01_epu_sessions", "start_time", "CAST(end_time AS STRING)", ["session_id", "param_id", "0"]),
    "tomo_sessions": ("an02_tomo_sessions", "start_time", "CAST(end_time AS STRING)", ["session_id", "param_id", "0"]),
    "epu_runs": ("an07_epu_runs", "start_time", "CAST(has_terminated AS STRING)", ["session_id", "total_micros", "running_micros"]),
    "tomo_runs": ("an08_tomo_runs", "start_time", "CAST(has_terminated AS STRING)", ["session_id", "total_micros", "running_micros"]),
    "epu_counters": ("an13_epu_counters", "start_time", "CAST(session_id AS STRING)", ["total_image_counter", "skip_image_counter", "0"]),
    "tomo_counters": (
        "an16_tomo_counters", "start_time", "CAST(session_id AS STRING)", ["total_image_counter", "total_ts_counter", "total_sm_counter"],
    ),
}
_DAILY = {
    "data_counters_daily": "an18_data_counters_daily", "image_counters_daily": "an17_image_counters_daily",
    "load_counters_daily": "an19_load_counters_daily", "epu_state_daily": "an09_epu_state_daily",
    "tomo_state_daily": "an10_tomo_state_daily", "epu_running_daily": "an11_epu_running_daily",
    "tomo_running_daily": "an12_tomo_running_daily",
}


def _columns(view: str) -> list[str]:
    _, at, name, figures = _SHAPES[view]
    return [
        f"'{view}' AS view_name", "instrument_id", f"{at} AS at", f"{name} AS name",
        *[f"CAST({x} AS DOUBLE) AS figure_{i}" for i, x in enumerate(figures, 1)],
    ]


def _lake(spark: SparkSession, source: views.Fleet) -> Lake:
    """A lake of its own in the shared folder, with the fleet's metadata and no events."""
    lake = Lake(spark, f"{checkpoint_dir(spark)}/lake-{uuid.uuid4().hex}")
    lake.replace_all({
        "instruments": source.instruments, "parameters": source.parameters, "enum_types": source.enum_types,
        "enum_values": source.enum_values,
    })
    return lake


def _is_new(data: DataFrame):
    """What arrives after the first refresh: the last days, and some late rows of the days before."""
    newest = data.agg(F.max("time").alias("_newest")).select("_newest").scalar()
    late = (F.pmod(F.xxhash64("time", "param_id"), F.lit(40)) == 0) & (F.col("time") >= newest - F.expr("INTERVAL 7 DAYS"))
    return (F.col("time") >= newest - F.expr("INTERVAL 3 DAYS")) | late


def _union(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


@register(
    "im02_sessions_refresh",
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT {', '.join(_columns(v))} FROM ({ORACLES[q]})" for v, (q, *_) in _SHAPES.items()) + ")",
    fleet=False,
)
def _(spark, sf):
    # stored before the last days and some late rows came, then refreshed from the resume points alone
    f = fleet(spark, sf)
    lake = _lake(spark, f)
    new = _is_new(f.data)
    lake.append_events(f.data.where(~new))
    incremental.refresh_changed(lake)
    lake.append_events(f.data.where(new))
    incremental.refresh_changed(lake)
    return _union(plain(lake.view(v)).selectExpr(*_columns(v)) for v in _SHAPES)


@register(
    "im01_full_refresh",
    "SELECT * FROM (" + " UNION ALL ".join(
        # the SQL of the daily states has a row per state of a day
        f"SELECT '{v}' AS view_name, instrument_id, COUNT({'DISTINCT day' if v.endswith('state_daily') and q != 'an26_state_seconds_per_day' else '*'}) AS n FROM ({ORACLES[q]}) GROUP BY instrument_id"
        for v, q in ({v: q for v, (q, *_) in _SHAPES.items()} | _DAILY).items()
    ) + ")",
    fleet=False,
)
def _(spark, sf):
    # rows per instrument of all fifteen stored views
    f = fleet(spark, sf)
    lake = _lake(spark, f)
    lake.append_events(f.data)
    refresh.refresh_all(lake)
    return _union(
        lake.view(v).groupBy("instrument_id").agg(F.count("*").alias("n")).select(F.lit(v).alias("view_name"), "instrument_id", "n")
        for v in views.VIEWS
    )

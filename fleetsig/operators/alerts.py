"""Threshold rules, muting and notification cadence."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsig.functions.times import SECOND, micros


@dataclass(frozen=True)
class Rule:
    """Fire for an instrument whose last numeric value within the look-back equals ``equals``."""

    name: str
    signal: dict
    equals: float = 0.0
    lookback_seconds: int = 3 * 3600
    every_seconds: int = 15 * 60
    severity: str = "critical"
    folder: str = "TEM"
    module: str = "EF"


# The shipped rule, the mute times by severity, and the notification policy in seconds.
FILTER_OFF = Rule(
    "Energy filter off", {"subsystem": "EnergyFilterBrick", "param_name": "EnergyFilterIsAvailable"}
)
WEEKEND, WEEKDAY = (1, 7), (2, 3, 4, 5, 6)  # Sunday is 1
MUTES = {
    "warning": [(WEEKEND, 0, 24)],
    "caution": [(WEEKDAY, 8, 24), (WEEKEND, 0, 24), (WEEKDAY, 0, 8)],
}
REPEAT_SECONDS = {"critical": 3600}
REPEAT_OTHERWISE = 4 * 3600


def evaluate(rule: Rule, samples: DataFrame, now) -> DataFrame:
    """Instruments with their last value and whether the rule fires at ``now``; no data means no row, i.e. OK."""
    at = F.lit(now).cast("timestamp")
    recent = samples.where(
        (F.col("time") > at - F.make_dt_interval(secs=F.lit(rule.lookback_seconds)))
        & (F.col("time") <= at)
        & F.col("value_num").isNotNull()
        & ~F.isnan("value_num")
    )
    return (
        recent.groupBy("instrument_id")
        .agg(F.max("time").alias("time"), F.max_by("value_num", "time").alias("last_value"))
        .withColumn("firing", F.col("last_value") == F.lit(rule.equals))
        .withColumns({"rule": F.lit(rule.name), "severity": F.lit(rule.severity)})
    )


def mute(fired: DataFrame, schedule=MUTES, ts: str = "time") -> DataFrame:
    """Flag alerts that fall into a mute time of their severity (UTC)."""
    muted = F.lit(False)
    for severity, spans in schedule.items():
        inside = F.lit(False)
        for days, start, end in spans:
            hour = F.hour(ts)
            inside = inside | (F.dayofweek(ts).isin(*days) & (hour >= start) & (hour < end))
        muted = muted | ((F.col("severity") == severity) & inside)
    return fired.withColumn("muted", muted)


def _spaced(key, ts, interval):
    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.sort(pdf["_us"].to_numpy(np.int64))
        chosen, i = [], 0
        while i < len(at):
            chosen.append(at[i])
            i = int(np.searchsorted(at, at[i] + interval, side="left"))
        out = pd.DataFrame({"_us": np.array(chosen, dtype=np.int64)})
        for k in key:
            out[k] = pdf[k].iloc[0]
        return out[[*key, "_us"]]

    return keep


def suppress_repeats(
    fired: DataFrame, repeat_seconds: int, group: Sequence[str], every_seconds: int = 15 * 60, ts: str = "time"
) -> DataFrame:
    """Times at which a group is notified: its first firing, then the next one after each repeat interval.

    Firings are first brought to the ticks at which rules are evaluated, so a group holds at most one row
    per tick, whatever the number of alerts behind it.
    """
    tick = micros(ts) - F.pmod(micros(ts), F.lit(every_seconds * SECOND))
    ticks = fired.select(*group, tick.alias("_us")).distinct()
    kept = ticks.groupBy(*group).applyInPandas(
        _spaced(list(group), ts, repeat_seconds * SECOND), ticks.schema
    )
    return kept.select(*group, F.timestamp_micros("_us").alias(ts))

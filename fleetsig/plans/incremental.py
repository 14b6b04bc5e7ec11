"""Refreshing sessions, runs, counters, off-periods and occupancy from where they can still change.

Every import notes the earliest time it touched of each signal. For each of these views that time leads to a resume point per
key: the last moment before it that is known to stay (a change point, a sample, the start of a session or day). Stored rows from
there on are replaced by rows computed from the events from there on; everything older is kept as it is. New, late and deleted
events are one case: they only move the resume point. Changed metadata (signals, enumerations) is not noticed; that takes a
full refresh.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsig import signals as S
from fleetsig.functions.times import day_of, micros
from fleetsig.operators import intervals
from fleetsig.plans import views
from fleetsig.plans.views import VIEWS, Fleet
from fleetsig.sources.lake import Lake

VIEWS_BY_RESUME = (
    "tem_off", "vacuum_state_daily", "epu_sessions", "epu_runs", "epu_counters", "tomo_sessions", "tomo_runs", "tomo_counters",
)
_SIGNAL = ["instrument_id", "param_id"]
_LOOK_BACK_DAYS = 8


def _ever() -> Column:
    """Before all events: keys without a resume point are computed from the beginning."""
    return F.lit("0001-01-01 00:00:00").cast("timestamp")


def changed(fleet: Fleet, changes: DataFrame, *signals: Mapping, key: Sequence[str] = ("instrument_id",)) -> DataFrame:
    """Earliest changed time (``since``) of the signals, per key."""
    return changes.join(fleet.find(*signals).select(*_SIGNAL), _SIGNAL).groupBy(*key).agg(F.min("since").alias("since"))


def from_resume(data: DataFrame, resume: DataFrame, key: Sequence[str] = ("instrument_id",)) -> DataFrame:
    """Rows of the resumed keys not older than their ``resume``; the oldest one prunes days and row groups at the scan."""
    oldest = resume.agg(F.min("resume").alias("_oldest")).select("_oldest").scalar()
    rows = data.where(F.col("time") >= oldest)
    if "day" in data.columns:
        rows = rows.where(F.col("day") >= F.to_date(oldest))
    return rows.join(resume.select(*key, "resume"), list(key)).where(F.col("time") >= F.col("resume")).drop("resume")


def splice(stored: DataFrame, fresh: DataFrame, resume: DataFrame, at: str, key: Sequence[str] = ("instrument_id",)) -> DataFrame:
    """Stored rows before their key's resume point, and the fresh ones."""
    marked = stored.join(resume.select(*key, "resume"), list(key), "left")
    kept = marked.where(F.col("resume").isNull() | (F.col(at) < F.col("resume"))).select(*stored.columns)
    return kept.unionByName(fresh.select(*stored.columns))


def last_before(samples: DataFrame, since: DataFrame, key: Sequence[str] = ("instrument_id",), keep=lambda df: df) -> DataFrame:
    """Per key the time (``last``) of its last sample before ``since``; keys without one are absent.

    A bounded stretch of days is looked at first; only keys that have no sample there are looked up in all their history.
    ``keep`` may store what is used repeatedly.
    """
    key = list(key)

    def found(rows: DataFrame, wanted: DataFrame) -> DataFrame:
        inside = rows.join(wanted.select(*key, "since"), key).where(F.col("time") < F.col("since"))
        return inside.groupBy(*key).agg(F.max("time").alias("last"))

    if "day" not in samples.columns:
        return found(samples, since)
    oldest = F.to_date(since.agg(F.min("since").alias("_oldest")).select("_oldest").scalar())
    near = keep(found(samples.where(F.col("day") >= F.date_sub(oldest, _LOOK_BACK_DAYS)), since))
    rest = since.join(near, key, "left_anti")
    if rest.isEmpty():
        return near
    return near.unionByName(found(samples, rest))


def resumed(since: DataFrame, last: DataFrame, key: Sequence[str] = ("instrument_id",)) -> DataFrame:
    return since.join(last, list(key), "left").select(*key, F.coalesce("last", _ever()).alias("resume"))


def sessions(fleet: Fleet, stored: DataFrame, since: DataFrame, signal: Mapping, idle: float = 0) -> tuple[DataFrame, DataFrame]:
    """``(resume, rows from there)``. A key resumes at its last change point before ``since``, which the start and end times of
    stored sessions give; a sample of another value right before it makes it a change again.
    """
    points = stored.select(*_SIGNAL, F.struct(F.col("start_time").alias("at"), F.lit(1).alias("start"), F.col("session_id").alias("value")).alias("p"))
    ends = stored.where("end_time IS NOT NULL").select(
        *_SIGNAL, F.struct(F.col("end_time").alias("at"), F.lit(0).alias("start"), F.lit(idle).cast("int").alias("value")).alias("p")
    )
    last = points.unionByName(ends).join(since, _SIGNAL).where(F.col("p.at") < F.col("since")).groupBy(*_SIGNAL).agg(F.max("p").alias("p"))
    resume = resumed(since, last.select(*_SIGNAL, F.col("p.at").alias("last")), _SIGNAL)
    before = last.select(
        *_SIGNAL, F.timestamp_micros(micros("p.at") - 1).alias("time"), (F.col("p.value") + 1).cast("double").alias("value_num")
    )
    rows = from_resume(fleet.data, resume, _SIGNAL)
    samples = replace(fleet, data=rows).signal(signal).select(*_SIGNAL, "time", "value_num")
    return resume, intervals.sessions(samples.unionByName(before), idle=idle)


def session_resume(spans: DataFrame, since: DataFrame, spans_resume: DataFrame) -> DataFrame:
    """Per instrument the start of the first session that new samples or new change points may reach."""
    moved = spans_resume.groupBy("instrument_id").agg(F.min("resume").alias("moved"))
    both = since.join(moved, "instrument_id", "full").select("instrument_id", F.least("since", "moved").alias("since"), "moved")
    reached = spans.join(both, "instrument_id").where(F.col("end_time").isNull() | (F.col("end_time") > F.col("since")))
    first = reached.groupBy("instrument_id").agg(F.min("start_time").alias("first"))
    return both.join(first, "instrument_id", "left").select(
        "instrument_id", F.least("first", "moved").alias("resume")
    ).where("resume IS NOT NULL")


def per_session(fleet: Fleet, fn, spans: DataFrame, resume: DataFrame) -> DataFrame:
    """A per-session view over the sessions from the resume point on; a session's figures need no events outside it."""
    open_spans = spans.join(resume, "instrument_id").where(F.col("start_time") >= F.col("resume")).drop("resume")
    return fn(replace(fleet, data=from_resume(fleet.data, resume)), open_spans)


def off_resume(fleet: Fleet, since: DataFrame, keep=lambda df: df) -> DataFrame:
    """The last sample before the changed ones: it ends with the sample that now follows it."""
    return resumed(since, last_before(fleet.signal(S.SERVER), since, keep=keep))


def occupancy(
    fleet: Fleet, off: DataFrame, since: DataFrame, off_from: DataFrame, keep=lambda df: df
) -> tuple[DataFrame, DataFrame]:
    """``(resume, daily rows from there)``; the resume point is the start of a day.

    The first interval that may differ begins with the last known state before the change (of states or off-periods). Its day
    is made anew, from the state known at the beginning of that day.
    """
    both = keep(since.join(off_from, "instrument_id", "full").select(
        "instrument_id", F.least("since", F.timestamp_micros(micros("resume") + 1)).alias("since")
    ))
    known = views.vacuum_samples(fleet).where(F.col("state").isin(*S.VACUUM_CLASSES))
    resume = keep(resumed(both, last_before(known, both, keep=keep)).withColumn("resume", day_of("resume")))
    starts = resume.withColumnRenamed("resume", "since")
    reading = keep(starts.join(last_before(known, starts, keep=keep), "instrument_id", "left").select(
        "instrument_id", F.coalesce("last", "since").alias("resume")
    ))
    labelled = views.vacuum_samples(replace(fleet, data=from_resume(fleet.data, reading)))
    blockers = off.join(reading, "instrument_id").where(F.col("end_time") > F.col("resume")).select(*off.columns)
    spans = intervals.drop_overlapping(intervals.state_intervals(labelled, list(S.VACUUM_CLASSES)), blockers)
    spans = spans.unionByName(blockers.withColumn("state", F.lit("off")))
    daily = intervals.seconds_per_day(intervals.split_by_day(spans))
    fresh = daily.join(resume, "instrument_id").where(F.col("day") >= F.col("resume")).select(*daily.columns)
    return resume, fresh


@dataclass(frozen=True)
class _Family:
    """Sessions of one kind and the views built on them."""

    sessions: str
    signal: Mapping
    runs: str
    state: Mapping
    counters: str
    counted: tuple[Mapping, ...]


FAMILIES = (
    _Family("epu_sessions", S.EPU_SESSION, "epu_runs", S.EPU_STATE, "epu_counters", (S.EPU_IMAGES, S.EPU_SKIPPED)),
    _Family(
        "tomo_sessions", S.TOMO_SESSION, "tomo_runs", S.TOMO_STATE, "tomo_counters",
        (S.TOMO_IMAGES, S.TOMO_POSITIONS, S.TOMO_MAPS),
    ),
)


def refresh_changed(lake: Lake) -> list[str]:
    """Bring the views of ``VIEWS_BY_RESUME`` up to date with all noted changes; returns their names.

    Each is published as a new version. The notes are removed at the end only, and resume points do not depend on what is
    newer than them, so a refresh that died is simply repeated. Where a view was never made, all are made whole.
    """
    from fleetsig.plans import refresh

    notes = lake.pending_changes()
    if not all(lake.has_view(name) for name in VIEWS_BY_RESUME):
        refresh.refresh_all(lake, VIEWS_BY_RESUME)
    elif notes:
        fleet = lake.fleet()
        with lake.staging() as stage:
            changes = stage(lake.changes(notes))
            _refresh_off(lake, fleet, changes, stage)
            for family in FAMILIES:
                _refresh_sessions(lake, fleet, changes, family, stage)
    lake.forget_changes(notes)
    return list(VIEWS_BY_RESUME)


def _view(lake: Lake, name: str, fleet: Fleet) -> DataFrame:
    """A stored view without the rows of instruments that are gone."""
    stored = lake.view(name, VIEWS[name][0](fleet).schema)
    return stored.join(fleet.parameters.select("instrument_id").distinct(), "instrument_id", "left_semi").select(*stored.columns)


def _refresh_off(lake: Lake, fleet: Fleet, changes: DataFrame, stage) -> None:
    resume = stage(off_resume(fleet, stage(changed(fleet, changes, S.SERVER)), stage))
    fresh = views.tem_off(replace(fleet, data=from_resume(fleet.data, resume)))
    lake.write_view("tem_off", splice(_view(lake, "tem_off", fleet), fresh, resume, "start_time"))
    off = _view(lake, "tem_off", fleet)
    days, rows = occupancy(fleet, off, changed(fleet, changes, S.VACUUM), resume, stage)
    lake.write_view("vacuum_state_daily", splice(_view(lake, "vacuum_state_daily", fleet), rows, days, "day"))


def _refresh_sessions(lake: Lake, fleet: Fleet, changes: DataFrame, family: _Family, stage) -> None:
    stored = _view(lake, family.sessions, fleet)
    since = stage(changed(fleet, changes, family.signal, key=_SIGNAL))
    resume, fresh = sessions(fleet, stored, since, family.signal)
    resume = stage(resume)
    lake.write_view(family.sessions, splice(stored, fresh, resume, "start_time", _SIGNAL))
    spans = _view(lake, family.sessions, fleet)
    for name, signals in ((family.runs, (family.state,)), (family.counters, family.counted)):
        again = stage(session_resume(spans, changed(fleet, changes, *signals), resume))
        rows = per_session(fleet, VIEWS[name][0], spans, again)
        lake.write_view(name, splice(_view(lake, name, fleet), rows, again, "start_time"))

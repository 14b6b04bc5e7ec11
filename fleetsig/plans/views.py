"""The derived tables: generic operators configured with signal names.

Every view is a function of a ``Fleet`` (the stored tables) and of views computed before it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsig import signals as S
from fleetsig.functions.times import whole
from fleetsig.operators import counters, intervals, metadata, states


@dataclass(frozen=True)
class Fleet:
    """The stored tables the views read."""

    data: DataFrame
    instruments: DataFrame
    parameters: DataFrame
    enum_types: DataFrame
    enum_values: DataFrame

    def signal(self, *alternatives: Mapping, attrs=()) -> DataFrame:
        return metadata.select_signals(self.data, self.parameters, *alternatives, attrs=attrs)

    def find(self, *alternatives: Mapping) -> DataFrame:
        return metadata.find_signals(self.parameters, *alternatives)

    def codes(self, alternative: Mapping, codes: Mapping, defaults: Mapping | None = None) -> DataFrame:
        return metadata.enum_code(self.find(alternative), self.enum_values, codes, defaults)


# parameter that announced a session; keeps two such parameters of one instrument apart
LANE = "session_param_id"


def _tagger(fleet: Fleet, signal: Mapping, spans: DataFrame) -> Callable[[DataFrame], DataFrame]:
    lanes = fleet.find(signal).select("instrument_id", F.col("param_id").alias(LANE))
    spans = spans.withColumnRenamed("param_id", LANE)

    def tag(points: DataFrame) -> DataFrame:
        return intervals.tag_points(points.join(lanes, "instrument_id"), spans, ["instrument_id", LANE])

    return tag


def epu_sessions(fleet: Fleet) -> DataFrame:
    return intervals.sessions(fleet.signal(S.EPU_SESSION))


def tomo_sessions(fleet: Fleet) -> DataFrame:
    return intervals.sessions(fleet.signal(S.TOMO_SESSION))


def _runs(fleet: Fleet, tag: Callable, state: Mapping, running, defaults: Mapping | None = None) -> DataFrame:
    codes = fleet.codes(state, {"running": running, "terminated": S.TERMINATED}, defaults)
    return states.session_states(fleet.signal(state), tag, codes).where(F.col("running_micros") > 0)


def epu_runs(fleet: Fleet, sessions: DataFrame | None = None) -> DataFrame:
    spans = epu_sessions(fleet) if sessions is None else sessions
    return _runs(fleet, _tagger(fleet, S.EPU_SESSION, spans), S.EPU_STATE, S.RUNNING)


def tomo_runs(fleet: Fleet, sessions: DataFrame | None = None) -> DataFrame:
    spans = tomo_sessions(fleet) if sessions is None else sessions
    tag = _tagger(fleet, S.TOMO_SESSION, spans)
    return _runs(fleet, tag, S.TOMO_STATE, S.TOMO_RUNNING, {"terminated": -1})


def epu_counters(fleet: Fleet, sessions: DataFrame | None = None) -> DataFrame:
    """Completed and skipped images per session; sessions without images are left out."""
    both = fleet.find(S.EPU_IMAGES).select("instrument_id").join(
        fleet.find(S.EPU_SKIPPED).select("instrument_id"), "instrument_id", "left_semi"
    )
    sig = fleet.signal(S.EPU_IMAGES, S.EPU_SKIPPED, attrs=["param_name"]).join(both, "instrument_id", "left_semi")
    points = sig.select("instrument_id", "time", "value_num", "param_name")
    spans = epu_sessions(fleet) if sessions is None else sessions
    tagged = _tagger(fleet, S.EPU_SESSION, spans)(points)
    images = F.when(F.col("param_name") == S.EPU_IMAGES["param_name"], F.col("value_num"))
    skipped = F.when(F.col("param_name") == S.EPU_SKIPPED["param_name"], F.col("value_num"))
    return (
        tagged.groupBy("instrument_id", LANE, "session_id", "start_time")
        .agg(
            counters.spread(images).alias("images"),
            F.coalesce(F.max(skipped), F.lit(0.0)).alias("skipped"),
        )
        .where(F.col("images") > 0)
        .select(
            "instrument_id",
            "session_id",
            "start_time",
            whole("images").alias("total_image_counter"),
            whole("skipped").alias("skip_image_counter"),
        )
    )


def tomo_counters(fleet: Fleet, sessions: DataFrame | None = None) -> DataFrame:
    """Images (reset to 1), tilt-series positions and search maps (reset to 0) per session, in one aggregation."""
    sig = fleet.signal(S.TOMO_IMAGES, S.TOMO_POSITIONS, S.TOMO_MAPS, attrs=["param_name"]).select(
        "instrument_id", "param_id", "time", "value_num", "param_name"
    )
    has_images = fleet.find(S.TOMO_IMAGES).select("instrument_id")
    points = counters.with_previous(sig.join(has_images, "instrument_id", "left_semi"))
    spans = tomo_sessions(fleet) if sessions is None else sessions
    tagged = _tagger(fleet, S.TOMO_SESSION, spans)(points)

    def of(signal: Mapping):
        return F.col("param_name") == signal["param_name"]

    images = counters.peaks_before(1, of(S.TOMO_IMAGES)) + counters.last_value(of(S.TOMO_IMAGES))
    return (
        tagged.groupBy("instrument_id", LANE, "session_id", "start_time")
        .agg(
            images.alias("images"),
            counters.peaks_before(0, of(S.TOMO_POSITIONS)).alias("positions"),
            counters.peaks_before(0, of(S.TOMO_MAPS)).alias("maps"),
        )
        .where(F.col("images") > 0)
        .select(
            "instrument_id",
            "session_id",
            "start_time",
            whole("images").alias("total_image_counter"),
            whole("positions").alias("total_ts_counter"),
            whole("maps").alias("total_sm_counter"),
        )
    )


def epu_state_daily(fleet: Fleet) -> DataFrame:
    return states.daily_state(fleet.signal(S.EPU_STATE))


def tomo_state_daily(fleet: Fleet) -> DataFrame:
    return states.daily_state(fleet.signal(S.TOMO_STATE))


def epu_running_daily(fleet: Fleet, daily: DataFrame | None = None) -> DataFrame:
    daily = epu_state_daily(fleet) if daily is None else daily
    return states.interpolated_daily(daily, fleet.codes(S.EPU_STATE, {"running": S.RUNNING}))


def tomo_running_daily(fleet: Fleet, daily: DataFrame | None = None) -> DataFrame:
    daily = tomo_state_daily(fleet) if daily is None else daily
    return states.interpolated_daily(daily, fleet.codes(S.TOMO_STATE, {"running": S.TOMO_RUNNING}))


def image_counters_daily(fleet: Fleet) -> DataFrame:
    sig = fleet.signal(S.IMAGE_COUNTERS, attrs=["param_name"])
    return counters.daily_delta(sig, ["instrument_id", "param_name"], "daily_images")


def data_counters_daily(fleet: Fleet) -> DataFrame:
    sig = fleet.signal(S.DATA_COUNTERS, attrs=["param_name"])
    return counters.daily_delta(sig, ["instrument_id", "param_name"], "daily_terabytes")


def load_counters_daily(fleet: Fleet) -> DataFrame:
    sig = fleet.signal({"param_name": list(S.LOAD_COUNTERS.values())}, attrs=["param_name"])
    return counters.daily_delta_pivoted(sig, S.LOAD_COUNTERS)


def tem_off(fleet: Fleet) -> DataFrame:
    return intervals.off_periods(fleet.signal(S.SERVER))


def vacuum_classes(fleet: Fleet) -> DataFrame:
    """Codes of the vacuum signals with the class their label belongs to."""
    return classify_labels(
        fleet.find(S.VACUUM).select("instrument_id", "param_id", "enum_id").join(fleet.enum_values, "enum_id"),
        S.VACUUM_CLASSES,
    ).select("instrument_id", F.col("value").alias("enum_value"), "state")


def classify_labels(labels: DataFrame, classes: Mapping, otherwise: str = "unknown") -> DataFrame:
    state = F.lit(otherwise)
    for name, members in reversed(list(classes.items())):
        state = F.when(F.col("member_name").isin(*members), F.lit(name)).otherwise(state)
    return labels.withColumn("state", state)


def vacuum_samples(fleet: Fleet) -> DataFrame:
    """Samples of the vacuum signals with the class of their state."""
    codes = vacuum_classes(fleet)
    sig = fleet.signal(S.VACUUM)
    sig = sig.select("instrument_id", "time", "value_num", *(["day"] if "day" in sig.columns else []))
    return sig.join(codes.withColumn("value_num", F.col("enum_value").cast("double")), ["instrument_id", "value_num"])


def vacuum_intervals(fleet: Fleet) -> DataFrame:
    """Known vacuum states in time order, unknown ones bridged; the last one is open."""
    return intervals.state_intervals(vacuum_samples(fleet), list(S.VACUUM_CLASSES))


def occupancy_intervals(fleet: Fleet, off: DataFrame | None = None) -> DataFrame:
    """Vacuum states not touched by an off-period, and the off-periods as a state of their own."""
    off = tem_off(fleet) if off is None else off
    clean = intervals.drop_overlapping(vacuum_intervals(fleet), off)
    return clean.unionByName(off.withColumn("state", F.lit("off")))


def vacuum_state_daily(fleet: Fleet, off: DataFrame | None = None) -> DataFrame:
    return intervals.seconds_per_day(intervals.split_by_day(occupancy_intervals(fleet, off)))


# name -> (function, views it reads); in dependency order
VIEWS: dict[str, tuple[Callable, tuple[str, ...]]] = {
    "data_counters_daily": (data_counters_daily, ()),
    "image_counters_daily": (image_counters_daily, ()),
    "load_counters_daily": (load_counters_daily, ()),
    "epu_state_daily": (epu_state_daily, ()),
    "tomo_state_daily": (tomo_state_daily, ()),
    "epu_running_daily": (epu_running_daily, ("epu_state_daily",)),
    "tomo_running_daily": (tomo_running_daily, ("tomo_state_daily",)),
    "tem_off": (tem_off, ()),
    "vacuum_state_daily": (vacuum_state_daily, ("tem_off",)),
    "epu_sessions": (epu_sessions, ()),
    "epu_runs": (epu_runs, ("epu_sessions",)),
    "epu_counters": (epu_counters, ("epu_sessions",)),
    "tomo_sessions": (tomo_sessions, ()),
    "tomo_runs": (tomo_runs, ("tomo_sessions",)),
    "tomo_counters": (tomo_counters, ("tomo_sessions",)),
}

"""The panels: each is a function of the stored tables and views, a time range and, where wanted, instruments.

``instruments=None`` answers for the whole fleet at once, one group per instrument.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsig import signals as S
from fleetsig.functions.times import between, ratio
from fleetsig.operators import downsample, metadata, series
from fleetsig.plans.views import Fleet

Ids = Sequence[int] | None


def scoped(df: DataFrame, instruments: Ids, column: str = "instrument_id") -> DataFrame:
    return df if instruments is None else df.where(F.col(column).isin(*instruments))


def ranged(df: DataFrame, t_from, t_to, instruments: Ids = None, ts: str = "time") -> DataFrame:
    """Samples of a panel's time range and instruments."""
    return scoped(df, instruments).where(between(ts, t_from, t_to))


def _named(df: DataFrame, fleet: Fleet) -> DataFrame:
    names = fleet.instruments.select(F.col("id").alias("instrument_id"), F.col("name").alias("instrument"))
    return df.join(names, "instrument_id")


# fleet overview


def occupancy_share(vacuum_daily: DataFrame, t_from, t_to, instruments: Ids = None) -> DataFrame:
    # whole microseconds, so that the sums do not depend on the order of the rows
    rows = ranged(vacuum_daily, t_from, t_to, instruments, ts="day").withColumn(
        "micros", F.round(F.col("seconds") * 1e6).cast("long")
    )
    share = series.share_of_total(rows, ["instrument_id"], "state", "micros")
    return share.select(
        "instrument_id", "state", (F.col("_amount") / F.lit(1e6)).alias("duration_seconds"), "percentage"
    )


def utilisation(fleet: Fleet, epu_daily: DataFrame, tomo_daily: DataFrame, t_from, t_to, instruments: Ids = None) -> DataFrame:
    """Percent of the time range spent running, per application; 0 for an instrument that never ran."""
    both = epu_daily.withColumn("_app", F.lit("epu")).unionByName(tomo_daily.withColumn("_app", F.lit("tomo")))
    sums = ranged(both, t_from, t_to, instruments, ts="day").groupBy("instrument_id").agg(
        *[F.sum(F.when(F.col("_app") == a, F.col("running_micros"))).alias(a) for a in ("epu", "tomo")]
    )
    wall = F.lit(t_to).cast("timestamp").cast("double") - F.lit(t_from).cast("timestamp").cast("double")

    def percent(app: str) -> Column:
        seconds = F.coalesce(F.col(app), F.lit(0)) / F.lit(1e6)
        return F.round(ratio(seconds, wall) * 100.0, 2).alias(f"{app}_utilization_percent")

    ids = scoped(fleet.instruments.select(F.col("id").alias("instrument_id")), instruments)
    return ids.join(sums, "instrument_id", "left").select("instrument_id", percent("epu"), percent("tomo"))


def days_since_nonzero(fleet: Fleet, signal: Mapping, as_of, instruments: Ids = None) -> DataFrame:
    rows = scoped(fleet.signal(signal, attrs=["param_name"]), instruments).where(F.col("value_num") != 0)
    return (
        rows.groupBy("instrument_id", "param_name")
        .agg(F.max("time").alias("cryo_start_time"))
        .withColumn("days_since_cryocycle_start", F.datediff(F.lit(as_of).cast("date"), F.col("cryo_start_time").cast("date")))
    )


def daily_series(fleet: Fleet, view: DataFrame, value: str, t_from, t_to, instruments: Ids = None) -> DataFrame:
    rows = ranged(view, t_from, t_to, instruments, ts="day")
    return _named(rows, fleet).select(F.col("day").alias("time"), "instrument", F.col(value).alias("value"))


def daily_sum_series(fleet: Fleet, view: DataFrame, value: str, t_from, t_to, instruments: Ids = None) -> DataFrame:
    rows = ranged(view, t_from, t_to, instruments, ts="day").groupBy("instrument_id", "day").agg(F.sum(value).alias("value"))
    return _named(rows, fleet).groupBy(F.col("day").alias("time"), "instrument").agg(F.sum("value").alias("value"))


def off_annotations(fleet: Fleet, off: DataFrame, instruments: Ids = None, kind: str = "TEM") -> DataFrame:
    return _named(scoped(off, instruments), fleet).select(
        F.col("start_time").alias("time"),
        F.col("end_time").alias("timeEnd"),
        F.concat("instrument", F.lit(" OFF")).alias("title"),
        F.lit(f"{kind} server offline").alias("text"),
    )


# data browser


def raw_series(fleet: Fleet, signal: Mapping, t_from, t_to, instruments: Ids = None) -> DataFrame:
    rows = ranged(fleet.data, t_from, t_to, instruments)
    return metadata.select_signals(rows, fleet.parameters, signal, attrs=["display_name"]).select(
        "instrument_id", "time", F.col("value_num").alias("value"), "display_name"
    )


def decoded_series(fleet: Fleet, signal: Mapping, t_from, t_to, instruments: Ids = None) -> DataFrame:
    rows = ranged(fleet.data, t_from, t_to, instruments)
    coded = metadata.select_signals(rows, fleet.parameters, signal, attrs=["param_name", "enum_id"])
    return series.decode(coded, fleet.enum_values, "left").select(
        "instrument_id",
        "time",
        F.col("param_name").alias("parameter"),
        F.col("value_num").alias("value"),
        F.col("member_name").alias("enumeration"),
    )


def parameter_catalogue(fleet: Fleet, signal: Mapping, instruments: Ids = None) -> DataFrame:
    return scoped(fleet.find(signal), instruments).select(
        "instrument_id", "param_id", "subsystem", "component", "param_name", "display_name",
        F.coalesce("storage_unit", F.lit("")).alias("storage_unit"), "enum_id", "value_type",
    )


def enum_catalogue(fleet: Fleet, signal: Mapping, instruments: Ids = None) -> DataFrame:
    """Labels of the selected parameters' enumerations, or of all where nothing is selected.

    A selected parameter without enumeration is a selection, so it yields no labels.
    """
    selected = scoped(fleet.find(signal), instruments)
    some = selected.select("instrument_id").distinct().withColumn("_some", F.lit(True))
    used = selected.select(F.col("enum_id").alias("id")).where("id IS NOT NULL").distinct().withColumn("_used", F.lit(True))
    types = (
        scoped(fleet.enum_types, instruments)
        .join(some, "instrument_id", "left")
        .join(used, "id", "left")
        .where(F.col("_some").isNull() | F.col("_used"))
    )
    return types.select(F.col("id").alias("enum_id"), F.col("name").alias("enum_name")).join(
        fleet.enum_values, "enum_id"
    )


def instrument_choices(fleet: Fleet) -> DataFrame:
    text = F.concat("name", F.lit(" ["), "model", F.lit("] ("), F.col("serial").cast("string"), F.lit(")"))
    return fleet.instruments.select(F.col("id").alias("value"), text.alias("text"))


def parameter_choices(fleet: Fleet, column: str, signal: Mapping | None = None, distinct: bool = False) -> DataFrame:
    """Entries of a drop-down; one per parameter as in the panels unless ``distinct``."""
    rows = fleet.parameters if signal is None else fleet.find(signal)
    picked = rows.select("instrument_id", column)
    return picked.distinct() if distinct else picked


# status tables


def module_status(fleet: Fleet, modules: Mapping = S.MODULES, instruments: Ids = None) -> DataFrame:
    return series.latest_decoded(scoped(fleet.data, instruments), fleet.parameters, fleet.enum_values, modules)


def server_status(fleet: Fleet, instruments: Ids = None) -> DataFrame:
    newest = series.latest(scoped(fleet.signal(S.SERVER_SOFTWARE), instruments), ["instrument_id"], ["value_num"])
    label = F.when(F.col("value_num") == 1, "Up").when(F.col("value_num") == 0, "Down")
    return newest.select("instrument_id", F.lit("TEM server").alias("name"), label.alias("value"), "time")


def detector_status(fleet: Fleet, instruments: Ids = None) -> DataFrame:
    """Newest reading per detector, decoded afterwards: a newest code without label hides the detector."""
    rows = scoped(fleet.signal(S.AVAILABILITY, attrs=["component", "enum_id"]), instruments)
    newest = series.latest(rows, [*metadata.SIGNAL_KEY, "component", "enum_id"], ["value_num"])
    return series.decode(newest, fleet.enum_values).select(
        "instrument_id",
        F.concat(F.lit("Detector: "), "component").alias("name"),
        F.col("member_name").alias("value"),
        "time",
    )


def status_table(*tables: DataFrame) -> DataFrame:
    """Module tables merged, renamed and sorted for display."""
    merged = tables[0]
    for table in tables[1:]:
        merged = merged.unionByName(table)
    shown = merged.withColumnsRenamed({"name": "Module", "value": "Status", "time": "Updated"})
    good = F.col("Status").rlike(S.UP_VALUES)
    return shown.withColumn("good", good).orderBy("instrument_id", "Module")


def instrument_summary(fleet: Fleet, as_of, days: int = 10, instruments: Ids = None) -> DataFrame:
    """One line per instrument; none if family or serial has no positive reading in the last days."""
    data = scoped(fleet.data, instruments)
    recent = (F.col("value_num") > 0) & (
        F.col("time") > F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    )
    bounds = data.groupBy("instrument_id").agg(F.min("time").alias("oldest_data"), F.max("time").alias("latest_data"))
    family_rows = fleet.signal(S.FAMILY, attrs=["enum_id"]).where(recent)
    family = series.latest_label(family_rows, fleet.enum_values, ["instrument_id"])
    serial = series.latest(fleet.signal(S.SERIAL).where(recent), ["instrument_id"], ["value_num"])
    return (
        fleet.instruments.withColumnRenamed("id", "instrument_id")
        .join(family.select("instrument_id", F.col("member_name").alias("product_family")), "instrument_id")
        .join(serial.select("instrument_id", F.col("value_num").alias("serial_reading")), "instrument_id")
        .join(bounds, "instrument_id")
        .select(
            "instrument_id", "name", "serial_reading", "serial", "model", "product_family", "server", "ds_version",
            "oldest_data", "latest_data",
        )
    )


# detectors


def component_series(fleet: Fleet, signal: Mapping, t_from, t_to, instruments: Ids = None) -> DataFrame:
    rows = ranged(fleet.data, t_from, t_to, instruments)
    picked = metadata.select_signals(rows, fleet.parameters, signal, attrs=["component"])
    shown = series.value_text(F.col("value_num"), {0: "DOWN", 1: "UP"})
    return picked.select("instrument_id", "time", "component", "value_num", shown.alias("shown"))


def component_delta(fleet: Fleet, signal: Mapping, t_from, t_to, instruments: Ids = None) -> DataFrame:
    rows = ranged(fleet.data, t_from, t_to, instruments)
    picked = metadata.select_signals(rows, fleet.parameters, signal, attrs=["component"])
    return series.component_delta(picked, ["instrument_id", "component"])


def camera_errors(fleet: Fleet, t_from, t_to, instruments: Ids = None) -> DataFrame:
    rows = ranged(fleet.data, t_from, t_to, instruments)
    picked = metadata.select_signals(rows, fleet.parameters, S.CAMERA_ERRORS, attrs=["enum_id"])
    return series.label_histogram(picked, fleet.enum_values, ["instrument_id"], S.CAMERA_GOOD)


def pressure_series(fleet: Fleet, t_from, t_to, instruments: Ids = None) -> DataFrame:
    """Samples of the pressure gauge that belongs to the instrument's (newest known) product family."""
    known = fleet.signal(S.FAMILY, attrs=["enum_id"]).where(F.col("value_num") > 0)
    families = series.latest_label(known, fleet.enum_values, ["instrument_id"])
    gauge = F.lit(S.PRESSURE_OTHERWISE)
    for family, param in S.PRESSURE_BY_FAMILY.items():
        gauge = F.when(F.col("member_name") == family, F.lit(param)).otherwise(gauge)
    chosen = families.select("instrument_id", gauge.alias("param_name"))
    params = fleet.parameters.join(chosen, ["instrument_id", "param_name"]).select(*metadata.SIGNAL_KEY)
    return ranged(fleet.data, t_from, t_to, instruments).join(params, metadata.SIGNAL_KEY).select(
        "instrument_id", "time", F.col("value_num").alias("pressure")
    )


def downsampled(fleet: Fleet, signal: Mapping, t_from, t_to, step: float, instruments: Ids = None) -> DataFrame:
    """A series thinned to two points per screen interval."""
    span = (_seconds(t_to) - _seconds(t_from)) / step
    rows = metadata.select_signals(ranged(fleet.data, t_from, t_to, instruments), fleet.parameters, signal)
    return downsample.lttb(rows, metadata.SIGNAL_KEY, "time", "value_num", int(2 * round(span)))


def _seconds(t) -> float:
    at = t if isinstance(t, datetime) else datetime.fromisoformat(str(t))
    return (at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp()


def sensor_temperature(fleet: Fleet, t_from, t_to, step: float, instruments: Ids = None) -> DataFrame:
    rows = metadata.select_signals(
        ranged(fleet.data, t_from, t_to, instruments), fleet.parameters, S.SENSOR_TEMPERATURE, attrs=["component"]
    )
    return series.bucket_avg(rows, ["instrument_id", "component"], step, shift=-273.15, drop=0.0, name="temperature")


# computer health


def pc_health(fleet: Fleet, t_from, t_to, step: float, instruments: Ids = None, panels: Mapping = S.PC_HEALTH) -> DataFrame:
    """All health panels in one pass, told apart by ``signal``."""
    name = F.lit(None).cast("string")
    for label, signal in reversed(list(panels.items())):
        name = F.when(metadata.matches(**signal), F.lit(label)).otherwise(name)
    dim = fleet.parameters.withColumn("signal", name).where("signal IS NOT NULL").select(*metadata.SIGNAL_KEY, "signal")
    rows = metadata.with_ids_of(ranged(fleet.data, t_from, t_to, instruments), dim).join(dim, metadata.SIGNAL_KEY)
    return series.bucket_avg(rows, ["instrument_id", "signal"], step)


def server_series(fleet: Fleet, t_from, t_to, instruments: Ids = None) -> DataFrame:
    rows = ranged(fleet.data, t_from, t_to, instruments)
    return metadata.select_signals(rows, fleet.parameters, S.SERVER_SOFTWARE).select("instrument_id", "time", "value_num")


# sessions


def session_report(sessions: DataFrame, runs: DataFrame, counters: DataFrame, images: str) -> DataFrame:
    """Sessions with run time, counters, speed in images per running hour and the error flag."""
    key = ["instrument_id", "session_id", "start_time"]
    hours = F.col("running_micros") / F.lit(3.6e9)
    return (
        sessions.drop("param_id")
        .join(runs, key)
        .join(counters, key)
        .withColumn("images_per_hour", ratio(F.col(images).cast("double"), hours))
    )

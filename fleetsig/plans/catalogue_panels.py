"""Registered panel queries, answered for all instruments over the whole time range of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetsig import signals as S
from fleetsig.operators import metadata, series
from fleetsig.plans import dashboards as D
from fleetsig.plans import views
from fleetsig.plans.catalogue_analytics import (
    DATA_DAILY,
    EPU_COUNTERS,
    EPU_RUNS,
    EPU_SESSIONS,
    IMAGES_DAILY,
    LOADS_DAILY,
    OCCUPANCY,
    TEM_OFF,
    TOMO_NAMES,
    sql_running_daily,
)
from fleetsig.plans.driver_tables import fleet
from fleetsig.plans.registry import register

FROM, TO = "2024-01-01 00:00:00", "2024-01-31 00:00:00"
RANGE = f"BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}'"


@register(
    "dq01_time_range",
    "SELECT instrument_id, param_id, time, value_num FROM data "
    "WHERE time BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-12 18:00:00'",
)
def _(spark, sf):
    rows = D.ranged(fleet(spark, sf).data, "2024-01-10 06:00:00", "2024-01-12 18:00:00")
    return rows.select("instrument_id", "param_id", "time", "value_num")


@register(
    "dq02_occupancy_share",
    f"""{OCCUPANCY},
    parts AS (
      SELECT instrument_id, state, SUM(CAST(ROUND(seconds * 1e6) AS BIGINT)) / 1e6::DOUBLE AS duration_seconds
      FROM vacuum_state_daily WHERE day {RANGE} GROUP BY ALL),
    totals AS (SELECT instrument_id, SUM(duration_seconds) AS total FROM parts GROUP BY ALL)
    SELECT instrument_id, state, duration_seconds, ROUND(duration_seconds * 100.0 / total, 2) AS percentage
    FROM parts JOIN totals USING (instrument_id)""",
)
def _(spark, sf):
    return D.occupancy_share(views.vacuum_state_daily(fleet(spark, sf)), FROM, TO)


@register(
    "dq03_utilisation",
    f"""epu AS ({'WITH ' + sql_running_daily("'AutomatedAcquisitionState'", "EPU", "'Running'")}),
    tomo AS ({'WITH ' + sql_running_daily(TOMO_NAMES, "Tomography", "'Running', 'Acquiring'")}),
    es AS (SELECT instrument_id, SUM(running_micros) / 1000000.0::DOUBLE AS s FROM epu WHERE day {RANGE} GROUP BY 1),
    ts AS (SELECT instrument_id, SUM(running_micros) / 1000000.0::DOUBLE AS s FROM tomo WHERE day {RANGE} GROUP BY 1)
    SELECT i.id AS instrument_id,
      ROUND(COALESCE(es.s, 0) / (epoch(TIMESTAMP '{TO}') - epoch(TIMESTAMP '{FROM}')) * 100.0, 2) AS epu_utilization_percent,
      ROUND(COALESCE(ts.s, 0) / (epoch(TIMESTAMP '{TO}') - epoch(TIMESTAMP '{FROM}')) * 100.0, 2) AS tomo_utilization_percent
    FROM instruments i LEFT JOIN es ON es.instrument_id = i.id LEFT JOIN ts ON ts.instrument_id = i.id""",
)
def _(spark, sf):
    f = fleet(spark, sf)
    return D.utilisation(f, views.epu_running_daily(f), views.tomo_running_daily(f), FROM, TO)


@register(
    "dq04_days_since_nonzero",
    """SELECT p.instrument_id, p.param_name, MAX(d.time) AS cryo_start_time,
         CAST(date_diff('day', CAST(MAX(d.time) AS DATE), DATE '2024-02-01') AS INTEGER) AS days_since_cryocycle_start
       FROM parameters p JOIN data d ON d.instrument_id = p.instrument_id AND d.param_id = p.param_id
       WHERE p.param_name IN ('AutoloaderCryoCycleDuration', 'ColumnCryoCycleDuration') AND d.value_num <> 0
       GROUP BY 1, 2""",
)
def _(spark, sf):
    return D.days_since_nonzero(fleet(spark, sf), S.CRYO_CYCLES, "2024-02-01")


def _load_sql(column: str) -> str:
    return f"""loads AS ({LOADS_DAILY})
    SELECT i.name AS instrument, day AS time, {column} AS value
    FROM instruments i JOIN loads ON instrument_id = i.id WHERE day {RANGE}"""


@register("dq05_daily_cartridges", _load_sql("daily_cartridge_count"))
def _(spark, sf):
    f = fleet(spark, sf)
    return D.daily_series(f, views.load_counters_daily(f), "daily_cartridge_count", FROM, TO)


@register("dq05_daily_cassettes", _load_sql("daily_cassette_count"))
def _(spark, sf):
    f = fleet(spark, sf)
    return D.daily_series(f, views.load_counters_daily(f), "daily_cassette_count", FROM, TO)


def _sum_sql(view: str, column: str) -> str:
    return f"""v AS ({view}) SELECT v.day AS time, i.name AS instrument, SUM(v.{column}) AS value
    FROM v JOIN instruments i ON i.id = v.instrument_id WHERE v.day {RANGE} GROUP BY 1, 2"""


@register("dq06_daily_images", _sum_sql(IMAGES_DAILY, "daily_images"))
def _(spark, sf):
    f = fleet(spark, sf)
    return D.daily_sum_series(f, views.image_counters_daily(f), "daily_images", FROM, TO)


@register("dq06_daily_terabytes", _sum_sql(DATA_DAILY, "daily_terabytes"))
def _(spark, sf):
    f = fleet(spark, sf)
    return D.daily_sum_series(f, views.data_counters_daily(f), "daily_terabytes", FROM, TO)


@register(
    "dq07_off_annotations",
    f"""{TEM_OFF} SELECT concat(i.name, ' OFF') AS title, 'TEM server offline' AS text, start_time AS time, end_time AS "timeEnd"
      FROM instruments i JOIN tem_off ON instrument_id = i.id""",
)
def _(spark, sf):
    f = fleet(spark, sf)
    return D.off_annotations(f, views.tem_off(f))


@register(
    "dq08_raw_series",
    f"""SELECT d.instrument_id, d.time, d.value_num AS value, p.display_name
    FROM data d JOIN parameters p USING (instrument_id, param_id)
    WHERE p.subsystem = 'SystemMonitoring' AND d.time {RANGE}""",
)
def _(spark, sf):
    return D.raw_series(fleet(spark, sf), {"subsystem": "SystemMonitoring"}, FROM, TO)


@register(
    "dq09_decoded_series",
    f"""SELECT d.instrument_id, d.time, p.param_name AS parameter, d.value_num AS value, e.member_name AS enumeration
    FROM data d JOIN parameters p USING (instrument_id, param_id)
    LEFT JOIN enum_values e ON e.enum_id = p.enum_id AND e.value = d.value_num
    WHERE p.subsystem IN ('Vacuum', 'MdlGunBrick') AND d.time {RANGE}""",
)
def _(spark, sf):
    return D.decoded_series(fleet(spark, sf), {"subsystem": ["Vacuum", "MdlGunBrick"]}, FROM, TO)


@register(
    "dq10_parameter_catalogue",
    """SELECT p.instrument_id, p.param_id, p.subsystem, p.component, p.param_name, p.display_name,
         COALESCE(p.storage_unit, '') AS storage_unit, p.enum_id, p.value_type, CAST(COUNT(*) AS BIGINT) AS samples
       FROM parameters p JOIN data d USING (instrument_id, param_id)
       WHERE p.subsystem IN ('Camera', 'Vacuum') GROUP BY ALL""",
)
def _(spark, sf):
    f = fleet(spark, sf)
    sizes = f.data.groupBy(*metadata.SIGNAL_KEY).agg(F.count("*").alias("samples"))
    return D.parameter_catalogue(f, {"subsystem": ["Camera", "Vacuum"]}).join(sizes, metadata.SIGNAL_KEY)


CATALOGUE = """
target AS (SELECT instrument_id, enum_id FROM parameters WHERE param_name IN ({names})),
catalogue AS (
  SELECT et.instrument_id, et.id AS enum_id, et.name AS enum_name, ev.member_name, ev.value
  FROM enum_values ev JOIN enum_types et ON et.id = ev.enum_id
  WHERE NOT EXISTS (SELECT 1 FROM target t WHERE t.instrument_id = et.instrument_id)
     OR et.id IN (SELECT enum_id FROM target WHERE enum_id IS NOT NULL))"""
USES = """SELECT c.enum_id, c.enum_name, c.member_name, c.value, CAST(COUNT(d.time) AS BIGINT) AS uses
  FROM catalogue c LEFT JOIN parameters p ON p.enum_id = c.enum_id
  LEFT JOIN data d ON d.instrument_id = p.instrument_id AND d.param_id = p.param_id AND d.value_num = c.value
  GROUP BY ALL"""


def _uses(f, catalogue):
    """How often each label of a catalogue occurs in the data."""
    coded = f.data.join(f.parameters.where("enum_id IS NOT NULL").select(*metadata.SIGNAL_KEY, "enum_id"), metadata.SIGNAL_KEY)
    counts = coded.groupBy("enum_id", F.col("value_num").cast("int").alias("value")).agg(F.count("time").alias("uses"))
    return catalogue.join(counts, ["enum_id", "value"], "left").withColumn("uses", F.coalesce("uses", F.lit(0)))


# the map counter exists on some instruments only and has no enumeration: all labels or none
@register("dq11_enum_catalogue", CATALOGUE.format(names="'SearchMapsPerJob'") + USES)
def _(spark, sf):
    f = fleet(spark, sf)
    return _uses(f, D.enum_catalogue(f, S.TOMO_MAPS))


@register("dq11_enum_catalogue_selected", CATALOGUE.format(names="'VacuumState', 'FegState'") + USES)
def _(spark, sf):
    f = fleet(spark, sf)
    return _uses(f, D.enum_catalogue(f, {"param_name": ["VacuumState", "FegState"]}))


@register(
    "dq12_dropdowns",
    """SELECT i.name || ' [' || i.model || '] (' || i.serial || ')' AS text, p.subsystem,
         CAST(COUNT(*) AS BIGINT) AS entries, CAST(COUNT(DISTINCT p.component) AS BIGINT) AS components
       FROM instruments i JOIN parameters p ON p.instrument_id = i.id
       WHERE (i.id) IN (SELECT instrument_id FROM data) GROUP BY ALL""",
)
def _(spark, sf):
    f = fleet(spark, sf)
    labels = D.instrument_choices(f).withColumnRenamed("value", "instrument_id")
    entries = D.parameter_choices(f, "subsystem").groupBy("instrument_id", "subsystem").agg(F.count("*").alias("entries"))
    parts = f.parameters.select("instrument_id", "subsystem", "component").distinct()
    parts = parts.groupBy("instrument_id", "subsystem").agg(F.count("*").alias("components"))
    alive = f.data.select("instrument_id").distinct()
    return (
        labels.join(entries, "instrument_id")
        .join(parts, ["instrument_id", "subsystem"])
        .join(alive, "instrument_id", "left_semi")
        .drop("instrument_id")
    )


STATUS_SQL = """
named AS (
  SELECT d.instrument_id, CASE WHEN p.param_name = 'FegState' THEN 'FEG' ELSE 'Energy filter' END AS name,
         ev.member_name, d.time
  FROM data d JOIN parameters p USING (instrument_id, param_id)
  JOIN enum_values ev ON ev.enum_id = p.enum_id AND ev.value = d.value_num
  WHERE (p.param_name = 'FegState' AND p.display_name = 'Feg State' AND p.subsystem IN ('MdlGunBrick', 'MdlTemFegBrick'))
     OR (p.param_name = 'EnergyFilterIsAvailable' AND p.subsystem = 'EnergyFilterBrick')),
module_status AS (
  SELECT instrument_id, name, ARG_MAX(member_name, time) AS value, MAX(time) AS time
  FROM named GROUP BY instrument_id, name),
server_status AS (
  SELECT d.instrument_id, 'TEM server' AS name,
         CASE ARG_MAX(d.value_num, d.time) WHEN 1 THEN 'Up' WHEN 0 THEN 'Down' END AS value, MAX(d.time) AS time
  FROM data d JOIN parameters p USING (instrument_id, param_id)
  WHERE p.param_name = 'Value' AND p.component = 'Server' AND p.subsystem = 'Software' GROUP BY d.instrument_id),
newest AS (
  SELECT d.*, p.component, p.enum_id,
         ROW_NUMBER() OVER (PARTITION BY d.instrument_id, d.param_id ORDER BY d.time DESC) AS rn
  FROM data d JOIN parameters p USING (instrument_id, param_id)
  WHERE p.param_name = 'Availability' AND p.display_name IN ('Camera availability', 'Availability')),
detector_status AS (
  SELECT n.instrument_id, 'Detector: ' || n.component AS name, ev.member_name AS value, n.time
  FROM newest n JOIN enum_values ev ON ev.enum_id = n.enum_id AND ev.value = n.value_num WHERE n.rn = 1)"""


@register("dq13_module_status", f"{STATUS_SQL} SELECT * FROM module_status")
def _(spark, sf):
    return D.module_status(fleet(spark, sf))


@register("dq14_server_status", f"{STATUS_SQL} SELECT * FROM server_status")
def _(spark, sf):
    return D.server_status(fleet(spark, sf))


@register("dq15_detector_status", f"{STATUS_SQL} SELECT * FROM detector_status")
def _(spark, sf):
    return D.detector_status(fleet(spark, sf))


@register(
    "dq16_instrument_summary",
    """family AS (
      SELECT d.instrument_id, ARG_MAX(e.member_name, d.time) AS product_family
      FROM data d JOIN parameters p USING (instrument_id, param_id)
      JOIN enum_values e ON e.enum_id = p.enum_id AND e.value = d.value_num
      WHERE p.param_name = 'ProductFamily' AND d.value_num > 0 AND d.time > TIMESTAMP '2024-01-31' - INTERVAL 10 DAY
      GROUP BY 1),
    serials AS (
      SELECT d.instrument_id, ARG_MAX(d.value_num, d.time) AS serial_reading
      FROM data d JOIN parameters p USING (instrument_id, param_id)
      WHERE p.param_name = 'SerialNumber' AND d.value_num > 0 AND d.time > TIMESTAMP '2024-01-31' - INTERVAL 10 DAY
      GROUP BY 1),
    bounds AS (SELECT instrument_id, MIN(time) AS oldest_data, MAX(time) AS latest_data FROM data GROUP BY 1)
    SELECT i.id AS instrument_id, i.name, s.serial_reading, i.serial, i.model, f.product_family, i.server, i.ds_version,
           b.oldest_data, b.latest_data
    FROM instruments i JOIN family f ON f.instrument_id = i.id JOIN serials s ON s.instrument_id = i.id
    JOIN bounds b ON b.instrument_id = i.id""",
)
def _(spark, sf):
    return D.instrument_summary(fleet(spark, sf), "2024-01-31")


@register(
    "dq17_resolve_signals",
    """ids AS (
      SELECT i.id AS instrument_id,
        COALESCE((SELECT MIN(p.param_id) FROM parameters p WHERE p.instrument_id = i.id
           AND ((p.param_name = 'TiltSeries' AND p.subsystem = 'Tomography')
             OR (p.param_name = 'SearchMapsPerJob' AND p.component = 'Session'))), 0) AS param_id
      FROM instruments i)
    SELECT x.instrument_id, x.param_id, CAST(COUNT(d.time) AS BIGINT) AS samples
    FROM ids x LEFT JOIN data d ON d.instrument_id = x.instrument_id AND d.param_id = x.param_id GROUP BY ALL""",
)
def _(spark, sf):
    f = fleet(spark, sf)
    either = [
        {"param_name": "TiltSeries", "subsystem": "Tomography"},
        {"param_name": "SearchMapsPerJob", "component": "Session"},
    ]
    ids = metadata.resolve_signal(f.instruments, f.parameters, either, default=0)
    sizes = f.data.groupBy(*metadata.SIGNAL_KEY).agg(F.count("*").alias("samples"))
    return ids.join(sizes, metadata.SIGNAL_KEY, "left").withColumn("samples", F.coalesce("samples", F.lit(0)))


@register(
    "dq18_status_table",
    f"""{STATUS_SQL}, merged AS (SELECT * FROM server_status UNION ALL SELECT * FROM module_status
      UNION ALL SELECT * FROM detector_status)
    SELECT instrument_id, name AS "Module", value AS "Status", time AS "Updated",
      regexp_matches(value, '(?i)^(Up|Operate|On|Enabled|Available)$') AS good FROM merged""",
)
def _(spark, sf):
    f = fleet(spark, sf)
    return D.status_table(D.server_status(f), D.module_status(f), D.detector_status(f))


@register(
    "dq19_component_series",
    f"""SELECT d.instrument_id, d.time, p.component, d.value_num,
      CASE d.value_num WHEN 0 THEN 'DOWN' WHEN 1 THEN 'UP' ELSE CAST(d.value_num AS VARCHAR) END AS shown
    FROM data d JOIN parameters p USING (instrument_id, param_id)
    WHERE p.param_name = 'Availability' AND p.display_name IN ('Camera availability', 'Availability') AND d.time {RANGE}""",
)
def _(spark, sf):
    return D.component_series(fleet(spark, sf), S.AVAILABILITY, FROM, TO)


@register(
    "dq20_component_delta",
    f"""SELECT d.instrument_id, p.component, MAX(d.value_num) - MIN(d.value_num) AS counter_delta
    FROM data d JOIN parameters p USING (instrument_id, param_id)
    WHERE p.param_name = 'NrDisconnectionsFromCSU' AND d.time {RANGE} GROUP BY 1, 2""",
)
def _(spark, sf):
    return D.component_delta(fleet(spark, sf), S.DISCONNECTIONS, FROM, TO)


@register(
    "dq21_error_histogram",
    f"""SELECT d.instrument_id, e.member_name AS error_type, CAST(COUNT(*) AS BIGINT) AS errors
    FROM data d JOIN parameters p USING (instrument_id, param_id)
    JOIN enum_values e ON e.enum_id = p.enum_id AND e.value = d.value_num
    WHERE p.param_name = 'AvailabilityReason' AND p.component = 'EF-CCD' AND d.time {RANGE}
      AND e.member_name NOT IN ('CameraAvailable', 'RPCConnectionEstablished') GROUP BY 1, 2""",
)
def _(spark, sf):
    return D.camera_errors(fleet(spark, sf), FROM, TO)


@register(
    "dq22_family_pressure",
    f"""wanted AS MATERIALIZED (
      SELECT instrument_id, param_id, param_name, enum_id FROM parameters
      WHERE param_name IN ('ProductFamily', 'PPmPressure', 'CCGpPressure')),
    samples AS MATERIALIZED (
      SELECT d.instrument_id, d.time, d.value_num, w.param_name, w.enum_id
      FROM data d JOIN wanted w USING (instrument_id, param_id)),
    family AS MATERIALIZED (
      SELECT s.instrument_id, ARG_MAX(e.member_name, s.time) AS family
      FROM samples s JOIN enum_values e ON e.enum_id = s.enum_id AND e.value = s.value_num
      WHERE s.param_name = 'ProductFamily' AND s.value_num > 0 GROUP BY 1)
    SELECT s.instrument_id, s.time, s.value_num AS pressure
    FROM samples s JOIN family f USING (instrument_id)
    WHERE s.param_name = CASE WHEN f.family = 'Talos' THEN 'PPmPressure' ELSE 'CCGpPressure' END AND s.time {RANGE}""",
)
def _(spark, sf):
    return D.pressure_series(fleet(spark, sf), FROM, TO)


LTTB_POINTS = 60  # two for each day of the range


@register(
    "dq23_lttb",
    # the published walk, bucket after bucket
    f"""samples AS (
      SELECT d.instrument_id, d.param_id, d.time, d.value_num AS y
      FROM data d JOIN parameters p USING (instrument_id, param_id)
      WHERE p.subsystem = 'MdlFluScreenBrick' AND p.param_name = 'ScreenCurrent' AND d.time {RANGE} AND d.value_num IS NOT NULL),
    ranked AS MATERIALIZED (
      SELECT *, ROW_NUMBER() OVER w - 1 AS i, COUNT(*) OVER (PARTITION BY instrument_id, param_id) AS n,
             epoch_us(time) - MIN(epoch_us(time)) OVER (PARTITION BY instrument_id, param_id) AS x
      FROM samples WINDOW w AS (PARTITION BY instrument_id, param_id ORDER BY time)),
    edges AS (
      SELECT instrument_id, param_id, b, CAST(FLOOR((b - 1) * ((n - 2) / {LTTB_POINTS - 2}.0::DOUBLE)) AS BIGINT) + 1 AS lo,
             CAST(FLOOR(b * ((n - 2) / {LTTB_POINTS - 2}.0::DOUBLE)) AS BIGINT) AS hi
      FROM (SELECT DISTINCT instrument_id, param_id, n FROM ranked WHERE n > {LTTB_POINTS}), range(1, {LTTB_POINTS - 1}) t(b)),
    dealt AS MATERIALIZED (
      SELECT r.*, CASE WHEN i = 0 THEN 0 WHEN i = n - 1 THEN {LTTB_POINTS - 1} ELSE e.b END AS bucket
      FROM ranked r LEFT JOIN edges e ON e.instrument_id = r.instrument_id AND e.param_id = r.param_id AND r.i BETWEEN e.lo AND e.hi
      WHERE n > {LTTB_POINTS}),
    means AS MATERIALIZED (
      SELECT instrument_id, param_id, bucket, SUM(x)::DOUBLE / COUNT(*) AS mx, AVG(y) AS my FROM dealt GROUP BY ALL),
    walk AS (
      SELECT instrument_id, param_id, bucket, time, x, y FROM dealt WHERE bucket = 0
      UNION ALL
      SELECT instrument_id, param_id, bucket, time, x, y FROM (
        SELECT c.instrument_id, c.param_id, c.bucket, c.time, c.x, c.y,
               ROW_NUMBER() OVER (PARTITION BY c.instrument_id, c.param_id ORDER BY
                 ABS((w.x - m.mx) * (c.y - w.y) - (w.x - c.x) * (m.my - w.y)) DESC NULLS LAST, c.x) AS place
        FROM walk w
        JOIN dealt c ON c.instrument_id = w.instrument_id AND c.param_id = w.param_id AND c.bucket = w.bucket + 1
        LEFT JOIN means m ON m.instrument_id = w.instrument_id AND m.param_id = w.param_id AND m.bucket = w.bucket + 2)
      WHERE place = 1)
    SELECT instrument_id, param_id, time, y AS value_num FROM walk
    UNION ALL SELECT instrument_id, param_id, time, y FROM ranked WHERE n <= {LTTB_POINTS}""",
    recursive=True,
)
def _(spark, sf):
    return D.downsampled(fleet(spark, sf), S.SCREEN_CURRENT, FROM, TO, step=86400)


@register(
    "dq24_sensor_temperature",
    f"""SELECT time_bucket(INTERVAL 6 HOUR, d.time) AS time, d.instrument_id, p.component,
      ROUND(AVG(d.value_num - 273.15), 6) AS temperature
    FROM data d JOIN parameters p USING (instrument_id, param_id)
    WHERE p.param_name = 'SensorTemperature' AND p.display_name = 'Sensor temperature' AND d.time {RANGE}
      AND d.value_num <> 0 GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    out = D.sensor_temperature(fleet(spark, sf), FROM, TO, step=6 * 3600)
    return out.withColumn("temperature", F.round("temperature", 6))


@register(
    "dq25_pc_health",
    f"""SELECT time_bucket(INTERVAL 1 HOUR, d.time) AS time, d.instrument_id,
      CASE p.param_name WHEN 'CPULoadAvg' THEN 'CPU load avg' ELSE 'Memory load avg' END AS signal,
      ROUND(AVG(d.value_num), 6) AS value
    FROM data d JOIN parameters p USING (instrument_id, param_id)
    WHERE p.subsystem = 'SystemMonitoring' AND p.component = 'Windows'
      AND p.param_name IN ('CPULoadAvg', 'MemoryLoad') AND d.time {RANGE} GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    return D.pc_health(fleet(spark, sf), FROM, TO, step=3600).withColumn("value", F.round("value", 6))


@register(
    "dq26_server_series",
    f"""SELECT d.instrument_id, d.time, d.value_num FROM data d JOIN parameters p USING (instrument_id, param_id)
    WHERE p.param_name = 'Value' AND p.component = 'Server' AND p.subsystem = 'Software' AND d.time {RANGE}""",
)
def _(spark, sf):
    return D.server_series(fleet(spark, sf), FROM, TO)


@register(
    "dq27_reducers",
    """SELECT instrument_id, param_id, MIN(value_num) AS min, MAX(value_num) AS max,
      ROUND(quantile_cont(value_num, 0.5), 6) AS median, ROUND(SUM(value_num), 4) AS sum, ROUND(AVG(value_num), 6) AS mean,
      ARG_MAX(value_num, time) AS last_not_null
    FROM data GROUP BY instrument_id, param_id""",
)
def _(spark, sf):
    out = series.reduce_series(fleet(spark, sf).data, metadata.SIGNAL_KEY)
    return out.withColumns({
        "sum": F.round("sum", 4), "mean": F.round("mean", 6), "median": F.round("median", 6)
    })


@register(
    "dq28_bands",
    """latest AS (
      SELECT d.instrument_id, p.param_name, MAX(d.time) AS time,
             CAST(date_diff('day', CAST(MAX(d.time) AS DATE), DATE '2024-02-22') AS INTEGER) AS days
      FROM data d JOIN parameters p USING (instrument_id, param_id)
      WHERE p.param_name IN ('AutoloaderCryoCycleDuration', 'ColumnCryoCycleDuration') AND d.value_num <> 0 GROUP BY 1, 2)
    SELECT instrument_id, param_name, days, CASE WHEN days >= 28 THEN 'red' WHEN days >= 21 THEN 'yellow' ELSE 'green' END AS band,
      CASE days WHEN 22 THEN 'WARN' WHEN 23 THEN 'CRIT' ELSE CAST(days AS VARCHAR) END AS text FROM latest""",
)
def _(spark, sf):
    days = D.days_since_nonzero(fleet(spark, sf), S.CRYO_CYCLES, "2024-02-22").withColumnRenamed(
        "days_since_cryocycle_start", "days"
    )
    return days.select(
        "instrument_id", "param_name", "days",
        series.band(F.col("days"), [(None, "green"), (21, "yellow"), (28, "red")]).alias("band"),
        series.value_text(F.col("days"), {22: "WARN", 23: "CRIT"}).alias("text"),
    )


@register(
    "dq29_rows_to_fields",
    """per AS (
      SELECT d.instrument_id, p.component, MAX(d.value_num) - MIN(d.value_num) AS v
      FROM data d JOIN parameters p USING (instrument_id, param_id)
      WHERE p.subsystem = 'Camera' AND p.enum_id IS NULL AND p.value_type = 'int' GROUP BY 1, 2)
    SELECT instrument_id, MAX(v) FILTER (WHERE component = 'BM-Falcon') AS falcon,
      MAX(v) FILTER (WHERE component = 'EF-CCD') AS ccd FROM per GROUP BY 1""",
)
def _(spark, sf):
    f = fleet(spark, sf)
    dim = f.parameters.where("subsystem = 'Camera' AND enum_id IS NULL AND value_type = 'int'")
    rows = f.data.join(dim.select(*metadata.SIGNAL_KEY, "component"), metadata.SIGNAL_KEY)
    per = series.component_delta(rows, ["instrument_id", "component"])
    return series.rows_to_fields(
        per, ["instrument_id"], "component", "counter_delta", {"BM-Falcon": "falcon", "EF-CCD": "ccd"}
    )


@register(
    "dq30_session_report",
    f"""{EPU_RUNS}, {EPU_COUNTERS.replace(EPU_SESSIONS + ',', '')}
    SELECT s.instrument_id, s.session_id, s.start_time, s.end_time, r.total_micros, r.running_micros, r.has_terminated,
      c.total_image_counter, c.skip_image_counter,
      ROUND(CAST(c.total_image_counter AS DOUBLE) / (r.running_micros / 3.6e9), 6) AS images_per_hour
    FROM epu_sessions s JOIN runs r USING (instrument_id, session_id, start_time)
    JOIN epu_counters c USING (instrument_id, session_id, start_time) WHERE r.running_micros > 0""",
)
def _(spark, sf):
    f = fleet(spark, sf)
    spans = views.epu_sessions(f)
    report = D.session_report(spans, views.epu_runs(f, spans), views.epu_counters(f, spans), "total_image_counter")
    return report.withColumn("images_per_hour", F.round("images_per_hour", 6))

"""Registered analytics: sessions, runs, states, counters, occupancy. The SQL keeps the plain relational shape
(range joins, windows over whole histories); the Spark side is built from the sliced operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetsig import signals as S
from fleetsig.functions.times import elapsed
from fleetsig.operators import counters, intervals, metadata, states
from fleetsig.plans import views
from fleetsig.plans.driver_tables import fleet
from fleetsig.plans.registry import register


def sql_sessions(name: str, param: str, subsystem: str) -> str:
    return f"""
{name}_marks AS (
  SELECT instrument_id, param_id, time, value_num
  FROM data JOIN parameters USING (instrument_id, param_id)
  WHERE param_name = '{param}' AND subsystem = '{subsystem}'
  QUALIFY value_num <> LAG(value_num) OVER (PARTITION BY instrument_id, param_id ORDER BY time)),
{name} AS (
  SELECT m.instrument_id, m.param_id, CAST(m.value_num AS INTEGER) AS session_id, m.time AS start_time,
         (SELECT MIN(n.time) FROM {name}_marks n
          WHERE n.instrument_id = m.instrument_id AND n.param_id = m.param_id AND n.time > m.time) AS end_time
  FROM {name}_marks m WHERE m.value_num <> 0)"""


def sql_runs(sessions: str, names: str, subsystem: str, running: str, default: str) -> str:
    return f"""
codes AS (
  SELECT instrument_id, param_id, MAX(CASE WHEN member_name IN ({running}) THEN value END) AS go,
         COALESCE(MAX(CASE WHEN member_name = 'Terminated' THEN value END), {default}) AS stop
  FROM parameters JOIN enum_values USING (enum_id)
  WHERE param_name IN ({names}) AND subsystem = '{subsystem}' AND member_name IN ({running}, 'Terminated')
  GROUP BY ALL),
inside AS (
  SELECT s.*, c.go, c.stop, d.value_num AS state,
         epoch_us(LEAD(d.time) OVER (PARTITION BY s.instrument_id, s.start_time, d.param_id ORDER BY d.time)) - epoch_us(d.time) AS us
  FROM {sessions} s
  JOIN codes c ON c.instrument_id = s.instrument_id
  JOIN data d ON d.instrument_id = s.instrument_id AND d.param_id = c.param_id
             AND d.time >= s.start_time AND d.time < s.end_time),
runs AS (
  SELECT instrument_id, session_id, start_time,
         CAST(epoch_us(end_time) - epoch_us(start_time) AS BIGINT) AS total_micros,
         CAST(COALESCE(SUM(us) FILTER (WHERE state = go), 0) AS BIGINT) AS running_micros,
         BOOL_OR(state = stop) AS has_terminated
  FROM inside GROUP BY instrument_id, session_id, start_time, end_time)"""


EPU_SESSIONS = sql_sessions("epu_sessions", "EpuSessionID", "EPU")
TOMO_SESSIONS = sql_sessions("tomo_sessions", "SessionId", "Tomography")
EPU_RUNS = f"{EPU_SESSIONS}, {sql_runs('epu_sessions', repr('AutomatedAcquisitionState'), 'EPU', repr('Running'), 'NULL')}"
TOMO_NAMES = "'Tomo5TiltSeriesState', 'TiltSeries'"
TOMO_RUNS = f"{TOMO_SESSIONS}, {sql_runs('tomo_sessions', TOMO_NAMES, 'Tomography', repr('Running') + ', ' + repr('Acquiring'), '-1')}"


@register("an01_epu_sessions", f"{EPU_SESSIONS} SELECT * FROM epu_sessions")
def _(spark, sf):
    return views.epu_sessions(fleet(spark, sf))


@register("an02_tomo_sessions", f"{TOMO_SESSIONS} SELECT * FROM tomo_sessions")
def _(spark, sf):
    return views.tomo_sessions(fleet(spark, sf))


@register(
    "an03_select_signals",
    """SELECT d.time, d.instrument_id, d.param_id, d.value_num, p.component
    FROM data d JOIN parameters p USING (instrument_id, param_id)
    WHERE p.subsystem = 'Camera' AND p.param_name IN ('Availability', 'AcquisitionJobs')""",
)
def _(spark, sf):
    f = fleet(spark, sf)
    return f.signal(
        {"subsystem": "Camera", "param_name": ["Availability", "AcquisitionJobs"]}, attrs=["component"]
    ).drop("value_text")


@register(
    "an04_enum_codes",
    """SELECT p.instrument_id, p.param_id,
         MAX(e.value) FILTER (WHERE e.member_name IN ('Running', 'Acquiring')) AS running,
         COALESCE(MAX(e.value) FILTER (WHERE e.member_name = 'Terminated'), -1) AS terminated,
         COUNT(DISTINCT d.time) AS samples
       FROM parameters p JOIN enum_values e ON e.enum_id = p.enum_id
       JOIN data d ON d.instrument_id = p.instrument_id AND d.param_id = p.param_id
       WHERE p.param_name IN ('AutomatedAcquisitionState', 'Tomo5TiltSeriesState', 'TiltSeries')
         AND e.member_name IN ('Running', 'Acquiring', 'Terminated')
       GROUP BY p.instrument_id, p.param_id""",
)
def _(spark, sf):
    f = fleet(spark, sf)
    states_of = {"param_name": [S.EPU_STATE["param_name"], *S.TOMO_STATE["param_name"]]}
    codes = f.codes(states_of, {"running": S.TOMO_RUNNING, "terminated": S.TERMINATED}, {"terminated": -1})
    sizes = f.signal(states_of).groupBy("instrument_id", "param_id").agg(F.count("time").alias("samples"))
    return codes.join(sizes, metadata.SIGNAL_KEY)


@register(
    "an05_state_durations",
    """timed AS (
      SELECT d.instrument_id, d.param_id, CAST(d.value_num AS BIGINT) AS state,
             epoch_us(LEAD(d.time) OVER (PARTITION BY d.instrument_id, d.param_id ORDER BY d.time)) - epoch_us(d.time) AS us
      FROM data d JOIN parameters p USING (instrument_id, param_id)
      WHERE p.enum_id IS NOT NULL)
    SELECT instrument_id, param_id, state, CAST(SUM(COALESCE(us, 0)) AS BIGINT) AS micros
    FROM timed GROUP BY ALL""",
)
def _(spark, sf):
    f = fleet(spark, sf)
    sig = f.data.join(f.parameters.where("enum_id IS NOT NULL").select(*metadata.SIGNAL_KEY), metadata.SIGNAL_KEY)
    return states.state_durations(sig, metadata.SIGNAL_KEY)


@register(
    "an06_tag_points",
    """marks AS MATERIALIZED (
      SELECT instrument_id, param_id, time, value_num
      FROM data JOIN parameters USING (instrument_id, param_id)
      WHERE param_name = 'EpuSessionID' AND subsystem = 'EPU'
      QUALIFY value_num <> LAG(value_num) OVER (PARTITION BY instrument_id, param_id ORDER BY time)),
    spans AS MATERIALIZED (
      SELECT instrument_id, CAST(value_num AS INTEGER) AS session_id, time AS start_time,
             LEAD(time) OVER (PARTITION BY instrument_id, param_id ORDER BY time) AS end_time
      FROM marks),
    points AS MATERIALIZED (
      SELECT d.instrument_id, d.time, d.value_num
      FROM data d JOIN parameters p USING (instrument_id, param_id) WHERE p.param_name = 'CompletedExposuresCount')
    SELECT d.instrument_id, d.time, d.value_num, s.session_id, s.start_time, s.end_time
    FROM points d ASOF JOIN spans s ON d.instrument_id = s.instrument_id AND d.time >= s.start_time
    WHERE s.session_id <> 0 AND d.time < s.end_time""",
)
def _(spark, sf):
    f = fleet(spark, sf)
    points = f.signal(S.EPU_IMAGES).select("instrument_id", "time", "value_num")
    return intervals.tag_points(points, views.epu_sessions(f), ["instrument_id"])


@register("an07_epu_runs", f"{EPU_RUNS} SELECT * FROM runs WHERE running_micros > 0")
def _(spark, sf):
    return views.epu_runs(fleet(spark, sf))


@register("an08_tomo_runs", f"{TOMO_RUNS} SELECT * FROM runs WHERE running_micros > 0")
def _(spark, sf):
    return views.tomo_runs(fleet(spark, sf))


def sql_daily(names: str, subsystem: str) -> str:
    return f"""
day_points AS (
  SELECT d.instrument_id, date_trunc('day', d.time)::TIMESTAMP AS day, d.time, CAST(d.value_num AS BIGINT) AS state,
         LEAD(d.time) OVER (PARTITION BY d.instrument_id, date_trunc('day', d.time) ORDER BY d.time) AS nxt
  FROM data d JOIN parameters p USING (instrument_id, param_id)
  WHERE p.param_name IN ({names}) AND p.subsystem = '{subsystem}'),
day_edges AS (
  SELECT instrument_id, day, MIN(time) AS first_time, ARG_MIN(state, time) AS first_state,
         MAX(time) AS last_time, ARG_MAX(state, time) AS last_state
  FROM day_points GROUP BY ALL),
day_states AS (
  SELECT instrument_id, day, state,
         CAST(SUM(COALESCE(epoch_us(nxt) - epoch_us(time), 0)) AS BIGINT) AS micros
  FROM day_points GROUP BY ALL)"""


def sql_running_daily(names: str, subsystem: str, running: str) -> str:
    return f"""{sql_daily(names, subsystem)},
running_code AS (
  SELECT p.instrument_id, MAX(e.value) AS code FROM parameters p JOIN enum_values e ON e.enum_id = p.enum_id
  WHERE p.param_name IN ({names}) AND p.subsystem = '{subsystem}' AND e.member_name IN ({running})
  GROUP BY p.instrument_id, p.param_id),
carried AS (
  SELECT *, LAG(last_state) OVER (PARTITION BY instrument_id ORDER BY day) AS before FROM day_edges)
SELECT c.instrument_id, c.day,
  CAST(COALESCE((SELECT SUM(s.micros) FROM day_states s
             WHERE s.instrument_id = c.instrument_id AND s.day = c.day AND s.state = r.code), 0)
   + CASE WHEN c.before = r.code THEN epoch_us(c.first_time) - epoch_us(c.day) ELSE 0 END
   + CASE WHEN c.last_state = r.code THEN epoch_us(c.day) + 86400000000 - epoch_us(c.last_time) ELSE 0 END AS BIGINT)
   AS running_micros
FROM carried c JOIN running_code r USING (instrument_id)"""


SQL_STATES = """ SELECT e.*, s.state, s.micros FROM day_edges e JOIN day_states s USING (instrument_id, day)"""


def flat(daily):
    """One row per state of the daily aggregate."""
    return daily.select(
        "instrument_id", "day", "first_time", "first_state", "last_time", "last_state",
        F.explode("durations").alias("state", "micros"),
    )


@register("an09_epu_state_daily", sql_daily("'AutomatedAcquisitionState'", "EPU") + SQL_STATES)
def _(spark, sf):
    return flat(views.epu_state_daily(fleet(spark, sf)))


@register("an10_tomo_state_daily", sql_daily(TOMO_NAMES, "Tomography") + SQL_STATES)
def _(spark, sf):
    return flat(views.tomo_state_daily(fleet(spark, sf)))


@register("an11_epu_running_daily", sql_running_daily("'AutomatedAcquisitionState'", "EPU", "'Running'"))
def _(spark, sf):
    return views.epu_running_daily(fleet(spark, sf))


@register("an12_tomo_running_daily", sql_running_daily(TOMO_NAMES, "Tomography", "'Running', 'Acquiring'"))
def _(spark, sf):
    return views.tomo_running_daily(fleet(spark, sf))


EPU_COUNTERS = f"""{EPU_SESSIONS},
epu_counters AS (
  SELECT s.instrument_id, s.session_id, s.start_time,
         CAST(MAX(d.value_num) FILTER (WHERE p.param_name = 'CompletedExposuresCount')
            - MIN(d.value_num) FILTER (WHERE p.param_name = 'CompletedExposuresCount') AS INTEGER) AS total_image_counter,
         CAST(COALESCE(MAX(d.value_num) FILTER (WHERE p.param_name = 'SkippedExposuresCount'), 0) AS INTEGER) AS skip_image_counter
  FROM epu_sessions s
  JOIN data d ON d.instrument_id = s.instrument_id AND d.time >= s.start_time AND d.time < s.end_time
  JOIN parameters p ON p.instrument_id = d.instrument_id AND p.param_id = d.param_id
  WHERE p.subsystem = 'EPU' AND p.param_name IN ('CompletedExposuresCount', 'SkippedExposuresCount')
  GROUP BY s.instrument_id, s.session_id, s.start_time
  HAVING total_image_counter > 0)"""


@register("an13_epu_counters", f"{EPU_COUNTERS} SELECT * FROM epu_counters")
def _(spark, sf):
    return views.epu_counters(fleet(spark, sf))


def sql_tagged(param: str, name: str) -> str:
    return f"""{name} AS (
  SELECT s.instrument_id, s.session_id, s.start_time, d.time, d.value_num,
         LAG(d.value_num) OVER (PARTITION BY s.instrument_id, s.start_time ORDER BY d.time) AS prev
  FROM tomo_sessions s
  JOIN data d ON d.instrument_id = s.instrument_id AND d.time >= s.start_time AND d.time < s.end_time
  JOIN parameters p ON p.instrument_id = d.instrument_id AND p.param_id = d.param_id
  WHERE p.subsystem = 'Tomography' AND p.param_name = '{param}')"""


RESET1 = f"""{TOMO_SESSIONS}, {sql_tagged('TemImageCount', 'img')},
img_totals AS (
  SELECT instrument_id, session_id, start_time,
         COALESCE(SUM(CASE WHEN value_num = 1 THEN prev END), 0) + ARG_MAX(value_num, time) AS total
  FROM img GROUP BY instrument_id, session_id, start_time)"""


def sql_reset0(param: str, name: str) -> str:
    return f"""{sql_tagged(param, name)},
{name}_totals AS (
  SELECT instrument_id, session_id, start_time,
         COALESCE(SUM(CASE WHEN value_num = 0 THEN prev END), 0) AS total
  FROM {name} GROUP BY instrument_id, session_id, start_time)"""


def _session_total(spark, sf, signal, mode):
    f = fleet(spark, sf)
    points = counters.with_previous(f.signal(signal).select("instrument_id", "param_id", "time", "value_num"))
    tagged = intervals.tag_points(points, views.tomo_sessions(f).drop("param_id"), ["instrument_id"])
    return counters.session_counter(tagged, mode)


@register("an14_counter_reset_to_1", f"{RESET1} SELECT * FROM img_totals")
def _(spark, sf):
    return _session_total(spark, sf, S.TOMO_IMAGES, "reset_to_1")


@register(
    "an15_counter_reset_to_0",
    f"{TOMO_SESSIONS}, {sql_reset0('TiltSeriesNumberOfPositions', 'ts')} SELECT * FROM ts_totals",
)
def _(spark, sf):
    return _session_total(spark, sf, S.TOMO_POSITIONS, "reset_to_0")


TOMO_COUNTERS = f"""{RESET1}, {sql_reset0('TiltSeriesNumberOfPositions', 'ts')}, {sql_reset0('SearchMapsPerJob', 'sm')},
tomo_counters AS (
  SELECT i.instrument_id, i.session_id, i.start_time, CAST(i.total AS INTEGER) AS total_image_counter,
         CAST(COALESCE(t.total, 0) AS INTEGER) AS total_ts_counter,
         CAST(COALESCE(m.total, 0) AS INTEGER) AS total_sm_counter
  FROM img_totals i LEFT JOIN ts_totals t USING (instrument_id, session_id, start_time)
  LEFT JOIN sm_totals m USING (instrument_id, session_id, start_time)
  WHERE i.total > 0)"""


@register("an16_tomo_counters", f"{TOMO_COUNTERS} SELECT * FROM tomo_counters")
def _(spark, sf):
    return views.tomo_counters(fleet(spark, sf))


def sql_list(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def sql_daily_delta(names: str, out: str) -> str:
    return f"""SELECT day, instrument_id, param_name, hi - lo AS {out} FROM (
      SELECT CAST(date_trunc('day', time) AS TIMESTAMP) AS day, instrument_id, param_name, MAX(value_num) AS hi, MIN(value_num) AS lo
      FROM parameters JOIN data USING (instrument_id, param_id) WHERE param_name IN ({names}) GROUP BY ALL)"""


IMAGES_DAILY = sql_daily_delta(sql_list(S.IMAGE_COUNTERS["param_name"]), "daily_images")
DATA_DAILY = sql_daily_delta(sql_list(S.DATA_COUNTERS["param_name"]), "daily_terabytes")
_GAINS = ", ".join(
    f"MAX(value_num) FILTER (WHERE param_name = '{p}') - MIN(value_num) FILTER (WHERE param_name = '{p}') AS {n}"
    for n, p in S.LOAD_COUNTERS.items()
)
LOADS_DAILY = f"""SELECT CAST(date_trunc('day', time) AS TIMESTAMP) AS day, instrument_id, {_GAINS}
  FROM parameters JOIN data USING (instrument_id, param_id)
  WHERE param_name IN ({sql_list(S.LOAD_COUNTERS.values())}) GROUP BY ALL"""


@register("an17_image_counters_daily", IMAGES_DAILY)
def _(spark, sf):
    return views.image_counters_daily(fleet(spark, sf))


@register("an18_data_counters_daily", DATA_DAILY)
def _(spark, sf):
    return views.data_counters_daily(fleet(spark, sf))


@register("an19_load_counters_daily", LOADS_DAILY)
def _(spark, sf):
    return views.load_counters_daily(fleet(spark, sf))


TEM_OFF = """
beats AS (
  SELECT instrument_id, time, value_num FROM data JOIN parameters USING (instrument_id, param_id)
  WHERE component = 'Server' AND param_name = 'Value'),
tem_off AS (
  SELECT b.instrument_id, b.time AS start_time, MIN(c.time) AS end_time
  FROM beats b JOIN beats c ON c.instrument_id = b.instrument_id AND c.time > b.time
  WHERE b.value_num = 0 GROUP BY b.instrument_id, b.time)"""


@register("an20_off_periods", f"{TEM_OFF} SELECT * FROM tem_off")
def _(spark, sf):
    return views.tem_off(fleet(spark, sf))


_CASES = " ".join(f"WHEN e.member_name IN ({sql_list(m)}) THEN '{c}'" for c, m in S.VACUUM_CLASSES.items())
CLASSES = f"""
classes AS (
  SELECT p.instrument_id, p.param_id, e.member_name, e.value, CASE {_CASES} ELSE 'unknown' END AS state
  FROM parameters p JOIN enum_values e USING (enum_id) WHERE p.param_name = 'VacuumState')"""
KNOWN = f"""{CLASSES},
labelled AS (
  SELECT d.instrument_id, c.state, d.time AS start_time
  FROM data d JOIN classes c ON c.instrument_id = d.instrument_id AND c.param_id = d.param_id AND c.value = d.value_num
  WHERE c.state <> 'unknown'),
known AS (
  SELECT l.*, (SELECT MIN(m.start_time) FROM labelled m
               WHERE m.instrument_id = l.instrument_id AND m.start_time > l.start_time) AS end_time
  FROM labelled l)"""
CLEAN = f"""{KNOWN}, {TEM_OFF},
clean AS (
  SELECT k.* FROM known k
  WHERE k.end_time IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM tem_off o WHERE o.instrument_id = k.instrument_id
      AND k.start_time < o.end_time AND k.end_time > o.start_time)),
all_states AS (
  SELECT instrument_id, 'off' AS state, start_time, end_time FROM tem_off
  UNION ALL BY NAME SELECT * FROM clean)"""
SPLIT = f"""{CLEAN},
calendar AS (
  SELECT CAST(UNNEST(generate_series(date_trunc('day', MIN(time)), MAX(time), INTERVAL 1 DAY)) AS TIMESTAMP) AS midnight FROM data),
split AS (
  SELECT a.instrument_id, a.state, CAST(c.midnight AS DATE) AS day,
         CASE WHEN a.start_time > c.midnight THEN a.start_time ELSE c.midnight END AS interval_start,
         CASE WHEN a.end_time < c.midnight + INTERVAL 1 DAY THEN a.end_time ELSE c.midnight + INTERVAL 1 DAY END AS interval_end
  FROM all_states a JOIN calendar c ON c.midnight <= a.end_time AND c.midnight + INTERVAL 1 DAY > a.start_time
  WHERE a.end_time > a.start_time)"""
OCCUPANCY = f"""{SPLIT},
vacuum_state_daily AS (
  SELECT instrument_id, state, day,
         SUM(epoch_us(interval_end) - epoch_us(interval_start)) / 1000000.0::DOUBLE AS seconds
  FROM split GROUP BY instrument_id, state, day)"""


@register(
    "an21_label_classes",
    f"""{CLASSES} SELECT c.instrument_id, c.state, CAST(COUNT(*) AS BIGINT) AS samples
    FROM data d JOIN classes c ON c.instrument_id = d.instrument_id AND c.param_id = d.param_id AND c.value = d.value_num
    GROUP BY ALL""",
)
def _(spark, sf):
    f = fleet(spark, sf)
    codes = views.vacuum_classes(f).withColumn("value_num", F.col("enum_value").cast("double"))
    sig = f.signal(S.VACUUM)
    return sig.join(codes, ["instrument_id", "value_num"]).groupBy("instrument_id", "state").agg(F.count("*").alias("samples"))


@register("an22_state_intervals", f"{KNOWN} SELECT * FROM known")
def _(spark, sf):
    return views.vacuum_intervals(fleet(spark, sf))


@register("an23_drop_overlapping", f"{CLEAN} SELECT * FROM clean")
def _(spark, sf):
    f = fleet(spark, sf)
    return intervals.drop_overlapping(views.vacuum_intervals(f), views.tem_off(f))


@register("an24_occupancy_intervals", f"{CLEAN} SELECT * FROM all_states")
def _(spark, sf):
    return views.occupancy_intervals(fleet(spark, sf))


@register("an25_split_by_day", f"{SPLIT} SELECT * FROM split")
def _(spark, sf):
    return intervals.split_by_day(views.occupancy_intervals(fleet(spark, sf)))


@register("an26_state_seconds_per_day", f"{OCCUPANCY} SELECT * FROM vacuum_state_daily")
def _(spark, sf):
    return views.vacuum_state_daily(fleet(spark, sf))

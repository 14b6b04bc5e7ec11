"""Registered queries on alerts, alarm import and counter snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fleetsig import schema, signals
from fleetsig.operators import alarms, alerts, snapshots
from fleetsig.plans.catalogue_analytics import EPU_SESSIONS
from fleetsig.plans.driver_tables import events, fleet, read
from fleetsig.plans.registry import register
from fleetsig.session import checkpoint_dir
from fleetsig.sources import alarm_store, tabular
from fleetsig.sources.lake import Lake
from fleetsig.streaming import ordered, sessions

# alerts

NOW = "2024-01-31 00:00:00"


@register(
    "al01_last_value_rule",
    """recent AS (
      SELECT d.instrument_id, d.time, d.value_num FROM data d JOIN parameters p USING (instrument_id, param_id)
      WHERE p.subsystem = 'EnergyFilterBrick' AND p.param_name = 'EnergyFilterIsAvailable' AND d.value_num IS NOT NULL
        AND d.time > TIMESTAMP '2024-01-31' - INTERVAL 3 DAY AND d.time <= TIMESTAMP '2024-01-31')
    SELECT instrument_id, MAX(time) AS time, ARG_MAX(value_num, time) AS last_value,
      ARG_MAX(value_num, time) = 0 AS firing, 'Energy filter off' AS rule, 'critical' AS severity
    FROM recent GROUP BY instrument_id""",
)
def _(spark, sf):
    f = fleet(spark, sf)
    rule = alerts.Rule("Energy filter off", alerts.FILTER_OFF.signal, lookback_seconds=3 * 86400)
    return alerts.evaluate(rule, f.signal(rule.signal), NOW)


def _fired(spark, sf):
    severity = F.when(F.col("k") % 3 == 0, "critical").when(F.col("k") % 3 == 1, "warning").otherwise("caution")
    return events(spark, sf).where("event_type = 'error'").select("event_id", "instrument_id", "time", severity.alias("severity"))


@register(
    "al03_mute_schedule",
    """fired AS (SELECT event_id, instrument_id, time,
        CASE k % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'caution' END AS severity
      FROM ev WHERE event_type = 'error')
    SELECT *, CASE severity WHEN 'warning' THEN dayofweek(time) IN (0, 6) WHEN 'caution' THEN TRUE ELSE FALSE END AS muted
    FROM fired""",
)
def _(spark, sf):
    return alerts.mute(_fired(spark, sf))


@register(
    "al04_repeat_interval",
    """ticks AS (
      SELECT DISTINCT instrument_id, CASE k % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'caution' END AS severity,
        time_bucket(INTERVAL 15 MINUTE, time) AS time
      FROM ev WHERE event_type = 'error'),
    hops AS (
      SELECT t.*, (SELECT MIN(n.time) FROM ticks n WHERE n.instrument_id = t.instrument_id AND n.severity = t.severity
                   AND n.time >= t.time + INTERVAL 4 HOUR) AS nxt FROM ticks t),
    sent AS (
      WITH RECURSIVE chain AS (
        SELECT instrument_id, severity, MIN(time) AS time FROM ticks GROUP BY 1, 2
        UNION ALL
        SELECT h.instrument_id, h.severity, h.nxt FROM chain c JOIN hops h
          ON h.instrument_id = c.instrument_id AND h.severity = c.severity AND h.time = c.time
        WHERE h.nxt IS NOT NULL)
      SELECT * FROM chain)
    SELECT instrument_id, severity, time FROM sent""",
)
def _(spark, sf):
    return alerts.suppress_repeats(_fired(spark, sf), 4 * 3600, ["instrument_id", "severity"])


# alarm import: parts are the error definitions, line items the notifications

DEFS_SQL = """
defs AS (
  SELECT CAST(p_partkey AS INTEGER) AS "ErrorDefinitionID", CAST(p_size % 7 AS INTEGER) AS "SubsystemID", 'S' || (p_size % 7) AS "Subsystem",
    CAST(p_size % 5 AS INTEGER) AS "DeviceTypeID", 'T' || (p_size % 5) AS "DeviceType",
    CAST(p_partkey % 13 AS INTEGER) AS "DeviceInstanceID", 'D' || (p_partkey % 13) AS "DeviceInstance",
    CAST(p_partkey % 17 AS INTEGER) AS "ErrorCodeID", 'C' || (p_partkey % 17) AS "ErrorCode"
  FROM part),
stored_defs AS (SELECT * FROM defs WHERE "ErrorDefinitionID" <= (SELECT MAX("ErrorDefinitionID") / 2 FROM defs)),
fresh AS (SELECT * FROM defs WHERE "ErrorDefinitionID" > (SELECT MAX("ErrorDefinitionID") FROM stored_defs))"""


def _definitions(spark, sf):
    part, key, size = read(spark, sf, "part"), F.col("p_partkey"), F.col("p_size")

    def number(c):
        return c.cast("int")

    defs = part.select(
        number(key).alias("ErrorDefinitionID"),
        number(size % 7).alias("SubsystemID"), F.concat(F.lit("S"), size % 7).alias("Subsystem"),
        number(size % 5).alias("DeviceTypeID"), F.concat(F.lit("T"), size % 5).alias("DeviceType"),
        number(key % 13).alias("DeviceInstanceID"), F.concat(F.lit("D"), key % 13).alias("DeviceInstance"),
        number(key % 17).alias("ErrorCodeID"), F.concat(F.lit("C"), key % 17).alias("ErrorCode"),
    )
    half = defs.select(F.max("ErrorDefinitionID") / 2).scalar()
    return defs, defs.where(F.col("ErrorDefinitionID") <= half)


@register("ue01_new_definitions", f"{DEFS_SQL} SELECT * FROM fresh")
def _(spark, sf):
    defs, stored = _definitions(spark, sf)
    return alarms.new_definitions(stored, defs)


def _dimension_sql() -> str:
    parts = []
    for name, (key, columns) in alarms.DIMENSIONS.items():
        ids = " || '/' || ".join(f'"{k}"' for k in key)
        label = next(c for c, n in columns.items() if n == "IdentifyingName")
        parts.append(f"""SELECT DISTINCT '{name}' AS dimension, '' || {ids} AS key, "{label}" AS label FROM defs""")
    return DEFS_SQL + " " + " UNION ALL ".join(parts)


def _dimensions(stored):
    out = {}
    for name, (key, columns) in alarms.DIMENSIONS.items():
        out[name] = stored.select(*[F.col(c).alias(n) for c, n in columns.items()]).dropDuplicates(key)
    return out


@register("ue02_normalised_dimensions", _dimension_sql())
def _(spark, sf):
    defs, stored = _definitions(spark, sf)
    tables = alarms.normalise(_dimensions(stored), alarms.new_definitions(stored, defs))
    out = None
    for name, (key, _cols) in alarms.DIMENSIONS.items():
        one = tables[name].select(
            F.lit(name).alias("dimension"), F.concat_ws("/", *key).alias("key"), F.col("IdentifyingName").alias("label")
        )
        out = one if out is None else out.unionByName(one)
    return out


@register(
    "ue03_definitions",
    f"""{DEFS_SQL} SELECT "ErrorDefinitionID", "SubsystemID", "DeviceTypeID", "ErrorCodeID", "DeviceInstanceID" FROM defs""",
)
def _(spark, sf):
    defs, stored = _definitions(spark, sf)
    return alarms.add_definitions(
        stored.select(*alarms.DEFINITION_COLUMNS), alarms.new_definitions(stored, defs)
    )


ERRORS_SQL = f"""{DEFS_SQL},
notes AS (
  SELECT l_shipdate + to_seconds(CAST(l_linenumber AS INTEGER)) AS time, CAST(l_suppkey % 25 AS INTEGER) AS instrument, CAST(l_partkey AS INTEGER) AS error,
    'E' || l_partkey || ' on ' || (l_suppkey % 25) AS message
  FROM lineitem),
stored AS (
  SELECT DISTINCT time, instrument, error, message FROM notes
  WHERE instrument % 6 <> 0 AND time < TIMESTAMP '1997-01-01' + to_days(CAST(instrument * 30 AS INTEGER))),
marks AS (SELECT instrument, MAX(time) AS mark FROM stored GROUP BY 1),
added AS (
  SELECT DISTINCT n.time, n.instrument, n.error, n.message FROM notes n JOIN defs d ON d."ErrorDefinitionID" = n.error
  LEFT JOIN marks m ON m.instrument = n.instrument WHERE n.time > COALESCE(m.mark, TIMESTAMP '1900-01-01'))"""


def _notifications(spark, sf):
    items = read(spark, sf, "lineitem")
    instrument = (F.col("l_suppkey") % 25).cast("int")
    return items.select(
        F.timestamp_micros(F.unix_micros("l_shipdate") + F.col("l_linenumber") * 1_000_000).alias("ErrorDtm"),
        F.col("l_partkey").cast("int").alias("ErrorDefinitionID"),
        F.concat(F.lit("E"), "l_partkey", F.lit(" on "), instrument).alias("MessageText"),
        instrument.alias("instrument_id"),
    )


@register(
    "ue05_incremental_import",
    ERRORS_SQL.replace("WHERE instrument % 6 <> 0 AND", "WHERE instrument % 6 <> 0 AND second(time) <> 3 AND error > 0 AND") + """
    SELECT time AS "Time", instrument AS "InstrumentID", error AS "ErrorID", message AS "MessageText" FROM stored
    UNION ALL SELECT * FROM added WHERE error > 0""",
)
def _(spark, sf):
    # an empty store takes definitions from id 1 on, so errors of definition 0 stay unknown; two imports of all instruments' servers into stored tables; what the first has not seen and lies below its marks stays out
    lake = Lake(spark, f"{checkpoint_dir(spark)}/alarms-{uuid.uuid4().hex}")
    lake.replace("instruments", fleet(spark, sf).instruments)
    defs, _ = _definitions(spark, sf)
    notes = _notifications(spark, sf)
    limit = F.date_add(F.lit("1997-01-01").cast("date"), F.col("instrument_id") * 30).cast("timestamp")
    early = (F.col("instrument_id") % 6 != 0) & (F.second("ErrorDtm") != 3) & (F.col("ErrorDtm") < limit)
    for seen in (notes.where(early), notes):
        alarm_store.import_alarms(lake, lambda kind, servers, seen=seen: seen if kind == "notifications" else defs)
    return lake.errors()


@register(
    "ue04_incremental_errors",
    f"""{ERRORS_SQL}, allrows AS (SELECT * FROM stored UNION ALL SELECT * FROM added)
    SELECT time AS "Time", instrument AS "InstrumentID", error AS "ErrorID", message AS "MessageText" FROM allrows""",
)
def _(spark, sf):
    defs, stored_defs = _definitions(spark, sf)
    notes = _notifications(spark, sf)
    limit = F.date_add(F.lit("1997-01-01").cast("date"), F.col("instrument_id") * 30).cast("timestamp")
    stored = notes.where((F.col("instrument_id") % 6 != 0) & (F.col("ErrorDtm") < limit)).select(
        F.col("ErrorDtm").alias("Time"), F.col("instrument_id").alias("InstrumentID"),
        F.col("ErrorDefinitionID").alias("ErrorID"), "MessageText",
    ).dropDuplicates(alarms.ERROR_KEY)
    tables = _dimensions(stored_defs) | {
        "error_definitions": stored_defs.select(*alarms.DEFINITION_COLUMNS), "errors": stored,
    }
    return alarms.import_incremental(tables, defs, notes)["errors"]


# counter snapshots: every event is a snapshot of one statement of one user

STATS_SQL = """
stats AS (
  SELECT time AS collected_at, CAST(instrument_id AS BIGINT) AS queryid, user_id % 3 AS userid,
    event_id % 4000 AS calls, CAST(event_id % 4000 AS DOUBLE) * 2 AS total_plan_time,
    CAST((event_id % 4000) * 8 + k AS DOUBLE) AS total_exec_time,
    CAST(event_id // 4 AS DOUBLE) AS blk_read_time, CAST(event_id // 8 AS DOUBLE) AS blk_write_time,
    event_id * 5 + k AS shared_blks_hit, event_id + k // 10 AS shared_blks_read,
    event_id // 2 AS local_blks_read, event_id // 3 AS temp_blks_read, event_id AS wal_bytes
  FROM ev)"""
FROM, TO = "2024-01-01 00:00:00", "2024-01-31 00:00:00"
DELTAS_SQL = f"""{STATS_SQL},
deltas AS (
  SELECT *, {', '.join(f'{c} - LAG({c}) OVER w AS delta_{c}' for c in snapshots.COUNTERS)}
  FROM stats WINDOW w AS (PARTITION BY queryid, userid ORDER BY collected_at))"""


def stats(spark, sf):
    e, k = F.col("event_id"), F.col("k")
    turn = e % 4000
    return events(spark, sf).select(
        F.col("time").alias("collected_at"),
        F.col("instrument_id").cast("bigint").alias("queryid"),
        (F.col("user_id") % 3).alias("userid"),
        turn.alias("calls"),
        (turn.cast("double") * 2).alias("total_plan_time"),
        (turn * 8 + k).cast("double").alias("total_exec_time"),
        F.floor(e / 4).cast("double").alias("blk_read_time"),
        F.floor(e / 8).cast("double").alias("blk_write_time"),
        (e * 5 + k).alias("shared_blks_hit"),
        (e + F.floor(k / 10)).alias("shared_blks_read"),
        F.floor(e / 2).alias("local_blks_read"),
        F.floor(e / 3).alias("temp_blks_read"),
        e.alias("wal_bytes"),
    )


def _six(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@register(
    "cs01_counter_deltas",
    f"SELECT queryid, userid, collected_at, {', '.join(f'{c}, delta_{c}' for c in snapshots.COUNTERS)} FROM deltas".join(
        [DELTAS_SQL + " ", ""]
    ),
)
def _(spark, sf):
    return snapshots.statement_deltas(stats(spark, sf), FROM, TO)


PERCALL_SQL = f"""{DELTAS_SQL},
percall AS (
  SELECT time_bucket(INTERVAL 1 DAY, collected_at) AS time, delta_calls,
    (delta_total_plan_time + delta_total_exec_time) / NULLIF(delta_calls, 0) AS ms,
    delta_blk_read_time + delta_blk_write_time AS io
  FROM deltas)"""


def _percentile_sql(fn: str) -> str:
    return f"""{PERCALL_SQL}
    SELECT time, ROUND(COALESCE({fn}(ms, 0.5), 0), 6) AS median_time, ROUND(COALESCE({fn}(ms, 0.95), 0), 6) AS p95_time,
      ROUND(COALESCE(SUM(io) / NULLIF(SUM(delta_calls), 0), 0), 6) AS avg_io_time FROM percall GROUP BY time"""


@register("cs02_runtime_percentiles", _percentile_sql("quantile_disc"))
def _(spark, sf):
    out = snapshots.estimated_runtime_percentiles(stats(spark, sf), FROM, TO, 86400)
    return _six(out, "median_time", "p95_time", "avg_io_time")


@register("cs02_runtime_percentiles_exact", _percentile_sql("quantile_cont"))
def _(spark, sf):
    out = snapshots.runtime_percentiles(stats(spark, sf), FROM, TO, 86400)
    return _six(out, "median_time", "p95_time", "avg_io_time")


@register(
    "cs03_top_statements",
    f"""{DELTAS_SQL},
    per AS (
      SELECT queryid, userid, SUM(delta_calls) AS calls, SUM(delta_total_plan_time + delta_total_exec_time) AS ms,
        COALESCE(SUM(delta_blk_read_time + delta_blk_write_time), 0) AS io
      FROM deltas WHERE delta_calls > 0 GROUP BY 1, 2)
    SELECT a.queryid, n.n_name AS query, r.r_name AS rolname, ROUND(a.ms / NULLIF(a.calls, 0), 6) AS avg_time,
      ROUND(a.calls::DOUBLE / 43200.0, 6) AS calls_per_min,
      ROUND(a.ms / NULLIF(SUM(a.ms) OVER (), 0) * 100, 6) AS pct_runtime,
      ROUND(a.io / NULLIF(SUM(a.io) OVER (), 0) * 100, 6) AS pct_io
    FROM per a JOIN nation n ON n.n_nationkey = a.queryid JOIN region r ON r.r_regionkey = a.userid""",
)
def _(spark, sf):
    texts = read(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("queryid"), F.col("n_name").alias("query"))
    users = read(spark, sf, "region").select(F.col("r_regionkey").cast("bigint").alias("userid"), F.col("r_name").alias("rolname"))
    out = snapshots.top_statements(stats(spark, sf), texts, users, FROM, TO)
    return _six(out, "avg_time", "calls_per_min", "pct_runtime", "pct_io")


@register(
    "cs04_range_summary",
    f"""{STATS_SQL},
    g AS (
      SELECT queryid, MAX(calls) - MIN(calls) AS calls, MAX(total_exec_time) - MIN(total_exec_time) AS ms,
        MAX(total_exec_time) AS mx, MAX(shared_blks_read) - MIN(shared_blks_read) + MAX(local_blks_read) - MIN(local_blks_read)
          + MAX(temp_blks_read) - MIN(temp_blks_read) AS blocks FROM stats GROUP BY 1)
    SELECT queryid, ROUND(ms / NULLIF(calls, 0), 6) AS avg_time_per_call, ROUND(mx / NULLIF(calls, 0), 6) AS max_time_per_call,
      ROUND(CAST(blocks * 8192 AS DOUBLE) / NULLIF(calls, 0), 6) AS bytes_per_call, calls AS total_calls FROM g""",
)
def _(spark, sf):
    out = snapshots.range_summary(stats(spark, sf), FROM, TO)
    return _six(out, "avg_time_per_call", "max_time_per_call", "bytes_per_call")


GAINS_SQL = f"""{STATS_SQL},
steps AS (
  SELECT *, time_bucket(INTERVAL 12 HOUR, collected_at) AS time, blk_read_time + blk_write_time AS io,
    LAG(total_exec_time) OVER w AS p_ms, LAG(blk_read_time + blk_write_time) OVER w AS p_io, LAG(calls) OVER w AS p_calls,
    LAG(shared_blks_hit) OVER w AS p_hit, LAG(shared_blks_read) OVER w AS p_read
  FROM stats WINDOW w AS (PARTITION BY queryid, userid, time_bucket(INTERVAL 12 HOUR, collected_at) ORDER BY collected_at)),
gains AS (
  SELECT time, queryid, userid,
    {', '.join(f"COALESCE(SUM(CASE WHEN {v} < {p} THEN {v} ELSE {v} - {p} END), 0) AS {n}" for v, p, n in [
        ('total_exec_time', 'p_ms', 'ms'), ('io', 'p_io', 'io_ms'), ('calls', 'p_calls', 'n_calls'),
        ('shared_blks_hit', 'p_hit', 'hit'), ('shared_blks_read', 'p_read', 'rd')])}
  FROM steps GROUP BY 1, 2, 3)"""


@register(
    "cs05_reset_aware_delta",
    f"""{GAINS_SQL} SELECT time, queryid, userid, ms AS total_time, io_ms AS total_io_time, CAST(n_calls AS BIGINT) AS calls
    FROM gains""",
)
def _(spark, sf):
    return snapshots.activity(stats(spark, sf), FROM, TO, 12 * 3600)


@register(
    "cs06_cache_hits",
    f"""{GAINS_SQL} SELECT time, queryid, userid,
      CASE WHEN hit + rd > 0 THEN ROUND(100.0 * hit::DOUBLE / (hit + rd), 6) END AS pct_from_cache,
      CASE WHEN hit + rd > 0 THEN ROUND(100.0 * rd::DOUBLE / (hit + rd), 6) END AS pct_from_disk,
      ROUND((rd * 8192)::DOUBLE / n_calls, 6) AS bytes_per_call FROM gains WHERE n_calls > 0""",
)
def _(spark, sf):
    out = snapshots.cache_hits(stats(spark, sf), FROM, TO, 12 * 3600)
    return _six(out, "pct_from_cache", "pct_from_disk", "bytes_per_call")


@register(
    "cs08_snapshot_totals",
    f"""{STATS_SQL} SELECT date_trunc('minute', collected_at)::TIMESTAMP AS collected_at, CAST(SUM(calls) AS BIGINT) AS calls,
      SUM(total_exec_time) AS total_exec_time, CAST(SUM(wal_bytes) AS BIGINT) AS wal_bytes FROM stats GROUP BY 1""",
)
def _(spark, sf):
    rows = stats(spark, sf).withColumn("collected_at", F.date_trunc("minute", "collected_at"))
    return snapshots.snapshot_totals(rows, ["calls", "total_exec_time", "wal_bytes"])


@register(
    "cs09_statement_texts",
    """SELECT DISTINCT user_id AS queryid, 'select ' || user_id AS query FROM ev""",
)
def _(spark, sf):
    rows = events(spark, sf).select(
        F.col("user_id").alias("queryid"), F.concat(F.lit("select "), "user_id").alias("query")
    )
    known = rows.where("queryid % 2 = 0").distinct()
    return snapshots.add_texts(known, rows)


# server log: messages written from events, parsed back


def _log(spark, sf):
    ev, k, e = events(spark, sf), F.col("k"), F.col("event_id")
    vacuum = F.concat(
        F.when(k % 5 == 0, "automatic aggressive vacuum to prevent wraparound of table \"db.public.t").otherwise(
            F.when(k % 5 == 1, F.lit('automatic vacuum of table "other.public.t')).otherwise(F.lit('automatic vacuum of table "db.public.t'))
        ),
        e % 9, F.lit('": index scans: '), k % 4, F.lit("\npages: "), k, F.lit(" removed, 5 remain\ntuples: "), k * 3,
        F.lit(" removed, "), e, F.lit(" remain"), F.when(k % 7 == 0, " to prevent wraparound").otherwise(F.lit("")),
        F.lit("\nsystem usage: elapsed: "), k, F.lit(".25 s"),
    )
    plan = F.concat(
        F.lit("duration: "), k, F.lit(".5 ms  plan:\n{\n  \"Query Text\": \"select\",\n  \"Plan\": {\"Total Cost\": "), e,
        F.lit(".75, \"Shared Read Blocks\": "), k, F.lit(", \"Shared I/O Read Time\": "), k % 10, F.lit(".125}\n}"),
    )
    return ev.select(
        F.col("time").alias("log_time"),
        F.lit("report").alias("user_name"),
        F.lit("db").alias("database_name"),
        F.when(k % 11 == 0, "WARNING").otherwise("LOG").alias("error_severity"),
        F.when(F.col("event_type") == "error", vacuum).when(F.col("event_type") == "click", plan).otherwise(F.lit("noise")).alias("message"),
        F.when(F.col("event_type") == "error", "autovacuum worker").otherwise("client backend").alias("backend_type"),
        e.alias("query_id"),
    )


@register(
    "cs10_maintenance_log",
    """SELECT 'public.t' || (event_id % 9) AS relation, time AS started_at,
      time + to_microseconds(k * 1000000 + 250000) AS finished_at, CAST(k % 4 AS BIGINT) AS index_scans, CAST(k AS BIGINT) AS pages_removed,
      CAST(k * 3 AS BIGINT) AS tuples_removed, event_id AS tuples_remain, k % 7 = 0 AS wraparound
    FROM ev WHERE event_type = 'error' AND k % 11 <> 0 AND k % 5 > 1""",
)
def _(spark, sf):
    return snapshots.maintenance_runs(_log(spark, sf), "db").drop("details")


PLANS_SQL = """
plans AS (
  SELECT time, event_id AS queryid, k + 0.5::DOUBLE AS duration, event_id + 0.75::DOUBLE AS total_cost,
    CAST(k * 8192 AS BIGINT) AS bytes_read, k % 10 + 0.125::DOUBLE AS io_read_time
  FROM ev WHERE event_type = 'click' AND k % 11 <> 0)"""


@register("cs11_plan_log", f"{PLANS_SQL} SELECT * FROM plans")
def _(spark, sf):
    return snapshots.logged_plans(_log(spark, sf), "db", "report").drop("plan")


@register(
    "cs07_slow_plans",
    f"{PLANS_SQL} SELECT *, ROUND(io_read_time / duration * 100.0, 6) AS io_read_pct FROM plans",
)
def _(spark, sf):
    out = snapshots.slow_plans(snapshots.logged_plans(_log(spark, sf), "db", "report").drop("plan"))
    return _six(out, "io_read_pct")


# the same rule with its shipped look-back of three hours


@register(
    "al02_look_back",
    """recent AS (
      SELECT d.instrument_id, d.time, d.value_num FROM data d JOIN parameters p USING (instrument_id, param_id)
      WHERE p.subsystem = 'EnergyFilterBrick' AND p.param_name = 'EnergyFilterIsAvailable' AND d.value_num IS NOT NULL
        AND d.time > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 3 HOUR AND d.time <= TIMESTAMP '2024-01-20 12:00:00')
    SELECT instrument_id, MAX(time) AS time, ARG_MAX(value_num, time) AS last_value,
      ARG_MAX(value_num, time) = 0 AS firing, 'Energy filter off' AS rule, 'critical' AS severity
    FROM recent GROUP BY instrument_id""",
)
def _(spark, sf):
    f = fleet(spark, sf)
    return alerts.evaluate(alerts.FILTER_OFF, f.signal(alerts.FILTER_OFF.signal), "2024-01-20 12:00:00")


@register(
    "ue05_all_servers",
    """SELECT CAST(l_linenumber AS INTEGER) AS instrument_id, l_shipdate AS "ErrorDtm", CAST(l_partkey AS INTEGER) AS "ErrorDefinitionID"
    FROM lineitem""",
    fleet=False,
)
def _(spark, sf):
    # one source per line number stands for one server per instrument
    items = read(spark, sf, "lineitem")
    sources = {
        n: items.where(F.col("l_linenumber") == n).select(
            F.col("l_shipdate").alias("ErrorDtm"), F.col("l_partkey").cast("int").alias("ErrorDefinitionID")
        )
        for n in sorted(r[0] for r in items.select("l_linenumber").distinct().where("l_linenumber IS NOT NULL").collect())
    }
    return tabular.union_sources(sources)


@register(
    "st01_streaming_sessions",
    f"""{EPU_SESSIONS} SELECT * FROM epu_sessions WHERE end_time IS NOT NULL""",
)
def _(spark, sf):
    # two micro-batches, the second starting from the state the first left
    sig = fleet(spark, sf).signal(signals.EPU_SESSION)
    closed, state = sessions.advance(None, sig.where("time < '2024-01-16'"))
    later, _after = sessions.advance(state, sig.where("time >= '2024-01-16'"))
    return closed.unionByName(later)


@register(
    "st01_ordered_stream",
    f"""{EPU_SESSIONS} SELECT * FROM epu_sessions WHERE end_time IS NOT NULL""",
)
def _(spark, sf):
    # a real stream: batches that are shuffled and overlap, then a sample long after all others, twice, to let the watermark pass
    sig = fleet(spark, sf).signal(signals.EPU_SESSION).select(*schema.EVENTS.fieldNames())
    root = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    turn = F.pmod(F.xxhash64("time", "instrument_id"), F.lit(10))
    after = sig.agg(F.max("time").alias("time")).select(
        (F.col("time") + F.expr("INTERVAL 100 DAYS")).alias("time"), F.lit(-1).alias("instrument_id"), F.lit(1).alias("param_id"),
        F.lit(0.0).alias("value_num"), F.lit(None).cast("string").alias("value_text"),
    )
    for part in (sig.where(turn < 6), sig.where(turn > 3), after, after):
        part.write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema(schema.EVENTS).parquet(f"{root}/in")
        ordered.stream_ordered_sessions(spark, source, f"{root}/out", f"{root}/late", f"{root}/state", late="60 days").awaitTermination()
    return spark.read.parquet(f"{root}/out").drop("batch")

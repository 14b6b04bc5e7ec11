"""The driver's tables read as a fleet: nations are the instruments, events their samples.

Each event type stands for several signals; the integer ``k`` in ``props`` and ``value`` supply the values.
The same signal list feeds the Spark frames here and the SQL of the oracle.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsig.plans.views import Fleet
from fleetsig.session import prepare

# param_id, event type, subsystem, component, param_name, display_name, unit, value_type, enum, modulus
# modulus > 0: value is k % modulus; 0: value is the event's value, with k % 10 = 0 meaning a bad reading of 0
SIGNALS = [
    (1, "view", "EPU", "Session", "EpuSessionID", "Session", "", "int", 0, 4),
    (2, "click", "EPU", "Session", "AutomatedAcquisitionState", "State", "", "int", 1, 3),
    (3, "purchase", "EPU", "Session", "CompletedExposuresCount", "Completed", "", "int", 0, 7),
    (4, "purchase", "EPU", "Session", "SkippedExposuresCount", "Skipped", "", "int", 0, 3),
    (5, "view", "Tomography", "Session", "SessionId", "Session", "", "int", 0, 3),
    (6, "click", "Tomography", "Session", "Tomo5TiltSeriesState", "State", "", "int", 2, 4),
    (7, "purchase", "Tomography", "Session", "TemImageCount", "Images", "", "int", 0, 5),
    (8, "signup", "Tomography", "Session", "TiltSeriesNumberOfPositions", "Positions", "", "int", 0, 4),
    (9, "error", "Tomography", "Session", "SearchMapsPerJob", "Maps", "", "int", 0, 3),
    (10, "error", "Software", "Server", "Value", "Server", "", "int", 0, 2),
    (11, "signup", "Vacuum", "Column", "VacuumState", "Vacuum state", "", "int", 3, 6),
    (12, "purchase", "Autoloader", "Loader", "LoadCartridgeCounter", "Cartridges", "", "int", 0, 100),
    (13, "signup", "Autoloader", "Loader", "LoadCassetteCounter", "Cassettes", "", "int", 0, 50),
    (14, "click", "Camera", "EF-CCD", "AcquisitionNumber", "Acquisitions", "", "int", 0, 90),
    (15, "view", "Camera", "BM-Falcon", "AcquisitionJobs", "Jobs", "", "int", 0, 80),
    (16, "error", "Camera", "BM-Falcon", "NumberOffloadedTerabytes", "Offloaded", "TB", "int", 0, 70),
    (17, "view", "Camera", "BM-Falcon", "Availability", "Camera availability", "", "int", 4, 3),
    (18, "click", "Camera", "EF-CCD", "Availability", "Availability", "", "int", 4, 2),
    (19, "signup", "Camera", "EF-CCD", "AvailabilityReason", "Reason", "", "int", 5, 4),
    (20, "purchase", "Camera", "BM-Falcon", "SensorTemperature", "Sensor temperature", "K", "float", 0, 0),
    (21, "view", "SystemMonitoring", "Windows", "CPULoadAvg", "CPU load", "%", "float", 0, 0),
    (22, "error", "SystemMonitoring", "Windows", "MemoryLoad", "Memory load", "%", "float", 0, 0),
    (23, "signup", "General", "Instrument", "ProductFamily", "Family", "", "int", 6, 3),
    (24, "error", "General", "Instrument", "SerialNumber", "Serial", "", "int", 0, 9),
    (25, "click", "Vacuum", "Projection", "PPmPressure", "Pressure", "Pa", "float", 0, 0),
    (26, "purchase", "Vacuum", "Projection", "CCGpPressure", "Pressure", "Pa", "float", 0, 0),
    (27, "error", "EnergyFilterBrick", "Filter", "EnergyFilterIsAvailable", "Filter", "", "int", 4, 2),
    (28, "view", "MdlGunBrick", "Feg", "FegState", "Feg State", "", "int", 7, 5),
    (29, "click", "Camera", "BM-Falcon", "NrDisconnectionsFromCSU", "Disconnections", "", "int", 0, 60),
    (30, "signup", "Autoloader", "Cryo", "AutoloaderCryoCycleDuration", "Duration", "s", "int", 0, 3),
    (31, "error", "Column", "Cryo", "ColumnCryoCycleDuration", "Duration", "s", "int", 0, 4),
    (32, "purchase", "MdlFluScreenBrick", "Screen", "ScreenCurrent", "Screen current", "nA", "float", 0, 0),
]

# enumeration number, name, labels by code; some codes that occur have no label
ENUMS = [
    (1, "AcquisitionState", ["Idle", "Running", "Terminated"]),
    (2, "TiltSeriesState", ["Idle", "Acquiring", "Paused", "Stopped"]),
    (3, "VacuumState", ["AllVacuumColumnValvesClosed", "AllVacuumColumnValvesOpened", "CryoCycle", "TMPmOnColumn", "Venting"]),
    (4, "Availability", ["No", "Available"]),
    (5, "AvailabilityReason", ["CameraAvailable", "RPCConnectionEstablished", "RPCTimeout", "DriverFault"]),
    (6, "ProductFamily", ["Unset", "Talos", "Titan"]),
    (7, "FegState", ["Off", "Standby", "Operate", "Conditioning"]),
]


def _lit(v) -> str:
    return f"'{v}'" if isinstance(v, str) else str(v)


def sql_values(rows) -> str:
    return ", ".join("(" + ", ".join(_lit(v) for v in row) + ")" for row in rows)


def _inline(ddl: str, rows) -> Column:
    """Rows of a fixed list next to every instrument."""
    names = [field.split()[0] for field in ddl.split(", ")]
    text = json.dumps([dict(zip(names, row)) for row in rows])
    return F.inline(F.from_json(F.lit(text), f"ARRAY<STRUCT<{ddl.replace(' ', ': ')}>>".replace(",: ", ", ")))


def enum_rows():
    return [(no, label, code) for no, _, labels in ENUMS for code, label in enumerate(labels)]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table with its wall-clock columns as instants (UTC)."""
    df = prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")
    naive = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive})


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with instrument and ``k``."""
    return read(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").alias("time"),
        (F.col("user_id") % 25).cast("int").alias("instrument_id"),
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def _signal_list(spark: SparkSession) -> DataFrame:
    return spark.sql(
        f"SELECT * FROM VALUES {sql_values(SIGNALS)} AS s(param_id, event_type, subsystem, component, "
        "param_name, display_name, unit, value_type, enum_no, modulus)"
    )


def fleet(spark: SparkSession, sf_dir: str, by_user: bool = False) -> Fleet:
    """The stored tables. ``by_user`` makes every user an instrument of its own (more, colder keys)."""
    prepare(spark)
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    ids = F.col("n_nationkey")
    instruments = nation.select(
        ids.alias("id"),
        F.concat(F.lit("I-"), ids).alias("instrument"),
        (ids + 1000).alias("serial"),
        F.concat(F.lit("Model "), "n_regionkey").alias("model"),
        F.col("n_name").alias("name"),
        F.lit("tem").alias("template"),
        F.concat(F.lit("10.0.0."), ids).alias("server"),
        F.lit("2.1").alias("ds_version"),
    )
    if by_user:
        users = read(spark, sf_dir, "events").select(F.col("user_id").cast("int").alias("id")).distinct()
        instruments = users.select("id", F.col("id").cast("string").alias("name"))
    listed = _inline(
        "param_id INT, subsystem STRING, component STRING, param_name STRING, display_name STRING, unit STRING, "
        "value_type STRING, enum_no INT",
        [(r[0], *r[2:9]) for r in SIGNALS],
    )
    iid = F.col("instrument_id")
    parameters = (
        instruments.select(F.col("id").alias("instrument_id"), listed)
        # the older models: another name for the tilt state, no map counter
        .withColumn(
            "param_name",
            F.when((F.col("param_id") == 6) & (iid % 2 == 1), F.lit("TiltSeries")).otherwise(F.col("param_name")),
        )
        .where(~((F.col("param_id") == 9) & (iid % 5 == 0)))
        .select(
            "instrument_id", "param_id", "subsystem", "component", "param_name", "display_name",
            F.nullif("unit", F.lit("")).alias("display_unit"),
            F.nullif("unit", F.lit("")).alias("storage_unit"),
            F.when(F.col("enum_no") > 0, iid * 100 + F.col("enum_no")).alias("enum_id"),
            "value_type",
        )
    )
    enum_types = instruments.select(F.col("id").alias("instrument_id"), _inline("no INT, name STRING", [e[:2] for e in ENUMS])).select(
        (iid * 100 + F.col("no")).alias("id"), "instrument_id", "name"
    )
    enum_values = instruments.select(F.col("id").alias("instrument_id"), _inline("no INT, member_name STRING, value INT", enum_rows())).select(
        (iid * 100 + F.col("no")).alias("enum_id"), "member_name", "value"
    )
    ev = events(spark, sf_dir)
    if by_user:
        ev = ev.withColumn("instrument_id", F.col("user_id").cast("int"))
    reading = F.when(F.col("k") % 10 == 0, F.lit(0.0)).otherwise(F.col("value"))
    data = ev.join(_signal_list(spark).select("param_id", "event_type", "modulus"), "event_type").select(
        "time",
        "instrument_id",
        "param_id",
        F.when(F.col("modulus") > 0, F.expr("try_mod(k, modulus)").cast("double")).otherwise(reading).alias("value_num"),
        F.lit(None).cast("string").alias("value_text"),
    )
    return Fleet(data, instruments, parameters, enum_types, enum_values)


# The same tables for the oracle.
SQL_FLEET = f"""
sig(param_id, event_type, subsystem, component, param_name, display_name, unit, value_type, enum_no, modulus) AS (
  VALUES {sql_values(SIGNALS)}),
enum_list(no, name) AS (VALUES {sql_values([e[:2] for e in ENUMS])}),
member_list(no, member_name, value) AS (VALUES {sql_values(enum_rows())}),
ev AS (
  SELECT event_id, ts AS time, CAST(user_id % 25 AS INTEGER) AS instrument_id, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events),
instruments AS (
  SELECT n_nationkey AS id, 'I-' || n_nationkey AS instrument, n_nationkey + 1000 AS serial,
         'Model ' || n_regionkey AS model, n_name AS name, 'tem' AS template, '10.0.0.' || n_nationkey AS server,
         '2.1' AS ds_version
  FROM nation),
parameters AS (
  SELECT i.id AS instrument_id, s.param_id, s.subsystem, s.component,
         CASE WHEN s.param_id = 6 AND i.id % 2 = 1 THEN 'TiltSeries' ELSE s.param_name END AS param_name,
         s.display_name, NULLIF(s.unit, '') AS display_unit, NULLIF(s.unit, '') AS storage_unit,
         CASE WHEN s.enum_no > 0 THEN i.id * 100 + s.enum_no END AS enum_id, s.value_type
  FROM instruments i, sig s
  WHERE NOT (s.param_id = 9 AND i.id % 5 = 0)),
enum_types AS (SELECT i.id * 100 + e.no AS id, i.id AS instrument_id, e.name FROM instruments i, enum_list e),
enum_values AS (
  SELECT i.id * 100 + m.no AS enum_id, m.member_name, m.value FROM instruments i, member_list m),
data AS (
  SELECT e.time, e.instrument_id, s.param_id,
         CASE WHEN s.modulus > 0 THEN CAST(e.k % s.modulus AS DOUBLE)
              WHEN e.k % 10 = 0 THEN 0.0 ELSE e.value END AS value_num,
         CAST(NULL AS VARCHAR) AS value_text
  FROM ev e JOIN sig s ON s.event_type = e.event_type)
"""

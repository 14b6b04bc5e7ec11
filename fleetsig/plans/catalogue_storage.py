"""Registered queries on ingestion, stored tables, metadata history and refresh."""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import functions as F

from fleetsig import schema
from fleetsig.functions.convert import numeric_value, text_value, utc_instant
from fleetsig.operators import metadata
from fleetsig.plans import refresh, views
from fleetsig.plans.catalogue_analytics import DATA_DAILY, IMAGES_DAILY, LOADS_DAILY
from fleetsig.plans.driver_tables import events, fleet, read
from fleetsig.plans.registry import register
from fleetsig.session import checkpoint_dir
from fleetsig.sources import lake, tabular, xml_export
from fleetsig.sources.pieces import written

# Exported text of an event: type by event type, with texts that do not convert.
TYPES = {"view": "int", "click": "bool", "purchase": "float", "error": "str", "signup": "int"}


def exported(spark, sf):
    """Events as an export would state them: kind and raw text of the value."""
    ev = events(spark, sf)
    kind = F.lit(None).cast("string")
    for name, target in TYPES.items():
        kind = F.when(F.col("event_type") == name, F.lit(target)).otherwise(kind)
    k = F.col("k")
    raw = (
        F.when(F.col("event_type") == "view", F.when(k % 10 == 3, F.lit("broken")).otherwise(k.cast("string")))
        .when(F.col("event_type") == "signup", F.when(k % 10 == 4, F.concat(k.cast("string"), F.lit(".0"))).otherwise(F.concat(F.lit(" "), k.cast("string"))))
        .when(F.col("event_type") == "click", F.when(k % 2 == 0, F.lit(" true ")).when(k % 3 == 0, F.lit("True")).otherwise(F.lit("false")))
        .when(F.col("event_type") == "purchase", F.when(k % 10 == 5, F.lit("")).otherwise(F.col("value").cast("string")))
        .otherwise(F.when(k % 10 == 6, F.lit("")).otherwise(F.concat(F.lit("msg "), k.cast("string"))))
    )
    return ev.withColumns({
        "kind": kind,
        "raw": raw,
        "param_id": F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2)
        .when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "error", 4).otherwise(5),
    })


TYPED_SQL = """
raw AS (
  SELECT event_id, time, instrument_id, event_type, k, value,
    CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 ELSE 5 END AS param_id
  FROM ev),
typed AS (
  SELECT event_id, time, instrument_id, param_id,
    CASE event_type
      WHEN 'view' THEN CASE WHEN k % 10 <> 3 THEN CAST(k AS DOUBLE) END
      WHEN 'signup' THEN CASE WHEN k % 10 <> 4 THEN CAST(k AS DOUBLE) END
      WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE
      WHEN 'purchase' THEN CASE WHEN k % 10 <> 5 THEN value END END AS value_num,
    CASE WHEN event_type = 'error' AND k % 10 <> 6 THEN 'msg ' || k END AS value_text
  FROM raw)"""
KNOWN_PARAMS = "SELECT DISTINCT instrument_id, param_id FROM raw WHERE NOT (instrument_id % 4 = 1 AND param_id IN (2, 5))"


def _known(ex):
    """Metadata without two parameters on some instruments, so that values get rejected."""
    missing = (F.col("instrument_id") % 4 == 1) & F.col("param_id").isin(2, 5)
    return ex.where(~missing).select("instrument_id", "param_id", F.col("kind").alias("value_type")).distinct()


def _as_xml(ex):
    """One ValueData element per event, parsed back with the reader's own schema."""
    offset = F.expr("make_dt_interval(0, 1)")
    stamp = F.concat(F.date_format(F.col("time") + offset, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+01:00"))
    element = F.concat(
        F.lit('<ValueData ParameterID="'), F.col("param_id").cast("string"), F.lit('"><ParameterValues><ParameterValue Timestamp="'),
        stamp, F.lit('"><Value>'), F.col("raw"), F.lit("</Value></ParameterValue></ParameterValues></ValueData>"),
    )
    parsed = F.from_xml(element, schema.XML_VALUE_DATA, {"ignoreSurroundingSpaces": "false"})
    return ex.select("instrument_id", parsed.alias("x")).select("instrument_id", "x.*")


def _parsed(spark, sf):
    ex = exported(spark, sf)
    values = xml_export.explode_values(_as_xml(ex), keep=["instrument_id"])
    return xml_export.type_values(values, _known(ex))


@register(
    "io01_xml_events",
    f"""{TYPED_SQL} SELECT time, instrument_id, param_id, value_num, value_text FROM typed
    JOIN ({KNOWN_PARAMS}) USING (instrument_id, param_id) WHERE value_num IS NOT NULL OR value_text IS NOT NULL""",
)
def _(spark, sf):
    return xml_export.accepted(_parsed(spark, sf))


def _scratch(spark) -> str:
    return f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


@register(
    "io01_xml_files",
    f"""{TYPED_SQL} SELECT time, instrument_id, param_id, value_num, value_text FROM typed
    JOIN ({KNOWN_PARAMS}) USING (instrument_id, param_id) WHERE value_num IS NOT NULL OR value_text IS NOT NULL""",
)
def _(spark, sf):
    # one export per instrument, each parameter one element with all its values
    ex = exported(spark, sf)
    stamp = F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    value = F.concat(
        F.lit('<ParameterValue Timestamp="'), stamp, F.lit('"><Value>'), F.coalesce("raw", F.lit("")), F.lit("</Value></ParameterValue>")
    )
    lines = ex.select("instrument_id", "param_id", F.lit(1).alias("part"), "time", value.alias("line"))
    elements = ex.select("instrument_id", "param_id").distinct()
    begin = F.concat(F.lit('<ValueData ParameterID="'), "param_id", F.lit('"><ParameterValues>'))
    for part, line in ((0, begin), (2, F.lit("</ParameterValues></ValueData>"))):
        lines = lines.unionByName(elements.select("*", F.lit(part).alias("part"), line.alias("line")), allowMissingColumns=True)
    folder = _scratch(spark)
    ordered = lines.repartition("instrument_id").sortWithinPartitions("instrument_id", "param_id", "part", "time")
    ordered.select("instrument_id", "line").write.partitionBy("instrument_id").text(folder)
    values = xml_export.values_of_pieces(written(xml_export.value_pieces(spark, folder)))
    owner = F.regexp_extract(xml_export.FILE, r"instrument_id=(\d+)", 1).cast("int")
    return xml_export.accepted(xml_export.type_values(values.withColumn("instrument_id", owner), _known(ex)))


@register(
    "io07_registry",
    "SELECT instrument, CAST(serial AS INTEGER) AS serial, model, name, 'tem' AS type, template, server FROM instruments",
)
def _(spark, sf):
    # the registry is one JSON list over several lines; its rows are those of the instruments
    listed = fleet(spark, sf).instruments.select(
        "instrument", "serial", "model", "name", F.lit("tem").alias("type"), "template", "server"
    )
    folder = _scratch(spark)
    whole = listed.agg(F.to_json(F.collect_list(F.struct(*listed.columns)), {"pretty": "true"}))
    whole.coalesce(1).write.text(folder)
    return tabular.read_registry(spark, folder)


@register(
    "io09_csv_events",
    """SELECT time, instrument_id, CAST(k AS INTEGER) AS param_id, CASE WHEN event_type <> 'error' THEN value END AS value_num,
      CASE WHEN event_type = 'error' THEN 'a "b", c' || k END AS value_text FROM ev""",
)
def _(spark, sf):
    error = F.col("event_type") == "error"
    ev = events(spark, sf).select(
        "time", "instrument_id", F.col("k").alias("param_id"), F.when(~error, F.col("value")).alias("value_num"),
        F.when(error, F.concat(F.lit('a "b", c'), "k")).alias("value_text"),
    )
    folder = _scratch(spark)
    ev.write.csv(folder, timestampFormat="yyyy-MM-dd HH:mm:ss.SSSSSSXXX")
    return tabular.read_events_csv(spark, folder)


@register(
    "io17_csv_export",
    """SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, CAST(k AS VARCHAR) AS k, 'x "' || event_type || '", ' || k AS note FROM ev""",
)
def _(spark, sf):
    # the exported file read as plain text columns under its header
    note = F.concat(F.lit('x "'), "event_type", F.lit('", '), F.col("k").cast("string"))
    folder = _scratch(spark)
    tabular.export_csv(events(spark, sf).select("event_id", "event_type", "k", note.alias("note")), folder)
    return spark.read.csv(folder, header=True)


@register(
    "io16_server_log",
    """SELECT time AS log_time, event_id AS session_line_num, event_id AS query_id, 'LOG' AS error_severity,
      CASE event_type WHEN 'click' THEN 'plan:' || chr(10) || '{' || chr(10) || ' "k": ' || k || chr(10) || '}'
        WHEN 'error' THEN 'said "no", twice' || chr(10) || chr(10) || 'line ' || k ELSE 'noise ' || k END AS message
    FROM ev""",
)
def _(spark, sf):
    ev, k = events(spark, sf), F.col("k").cast("string")
    message = (
        F.when(F.col("event_type") == "click", F.concat(F.lit('plan:\n{\n "k": '), k, F.lit("\n}")))
        .when(F.col("event_type") == "error", F.concat(F.lit('said "no", twice\n\nline '), k))
        .otherwise(F.concat(F.lit("noise "), k))
    )
    line = F.concat(
        F.date_format("time", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(' UTC,"report",db,1,,s,'), "event_id", F.lit(',,,,,LOG,,"'),
        F.replace(message, F.lit('"'), F.lit('""')), F.lit('",,,,,,,,,,client backend,,'), "event_id",
    )
    folder = _scratch(spark)
    ev.select(line).write.text(folder)
    log = tabular.read_server_log(spark, folder)
    return log.select("log_time", "session_line_num", "query_id", "error_severity", "message")


@register("io02_typed_values", f"{TYPED_SQL} SELECT event_id, value_num, value_text FROM typed WHERE value_num IS NOT NULL OR value_text IS NOT NULL")
def _(spark, sf):
    ex = exported(spark, sf)
    return ex.select(
        "event_id",
        numeric_value(F.col("raw"), F.col("kind")).alias("value_num"),
        text_value(F.col("raw"), F.col("kind")).alias("value_text"),
    ).where("value_num IS NOT NULL OR value_text IS NOT NULL")


@register(
    "io03_unknown_parameters",
    f"""{TYPED_SQL} SELECT instrument_id, param_id, CAST(COUNT(*) AS BIGINT) AS rejected
    FROM raw WHERE (instrument_id, param_id) NOT IN ({KNOWN_PARAMS}) GROUP BY 1, 2""",
)
def _(spark, sf):
    rejects = xml_export.rejected(_parsed(spark, sf))
    return rejects.groupBy("instrument_id", "param_id").agg(F.count("*").alias("rejected"))


@register(
    "io03_unconverted_values",
    f"""{TYPED_SQL} SELECT instrument_id, param_id, 'value' AS reason, CAST(COUNT(*) AS BIGINT) AS refused
    FROM raw JOIN ({KNOWN_PARAMS}) USING (instrument_id, param_id)
    WHERE (event_type = 'view' AND k % 10 = 3) OR (event_type = 'signup' AND k % 10 = 4) GROUP BY 1, 2""",
)
def _(spark, sf):
    lost = xml_export.unconverted(_parsed(spark, sf))
    return lost.groupBy("instrument_id", "param_id", "reason").agg(F.count("*").alias("refused"))


@register("io04_utc_instants", "SELECT event_id, time FROM ev")
def _(spark, sf):
    ev = events(spark, sf)
    shift = (F.col("event_id") % 5).cast("int")
    sign = F.when(shift == 0, F.lit("Z")).otherwise(F.concat(F.lit("+0"), shift.cast("string"), F.lit(":00")))
    local = F.timestamp_micros(F.unix_micros("time") + shift * 3_600_000_000)
    text = F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), sign)
    return ev.select("event_id", utc_instant(text).alias("time"))


@register("io10_append_dedup", "SELECT DISTINCT time, instrument_id, param_id, value_num, value_text FROM data")
def _(spark, sf):
    data = fleet(spark, sf).data
    stored = data.where("time < '2024-01-16 12:00:00'")
    again = data.where("time >= '2024-01-09'").unionByName(data.where("time >= '2024-01-20'"))
    return stored.unionByName(lake.append_dedup(stored, again))


@register(
    "io13_typed_properties",
    """marks AS (SELECT instrument_id, MAX(time) AS mark FROM ev WHERE event_id % 7 = 0 AND instrument_id % 3 <> 0
                AND time < TIMESTAMP '2024-01-15' GROUP BY 1)
    SELECT e.time, e.instrument_id, CAST(e.k AS INTEGER) AS param_id,
      CASE event_type WHEN 'purchase' THEN value WHEN 'view' THEN CAST(k AS DOUBLE)
           WHEN 'click' THEN CAST(k % 2 AS DOUBLE) END AS value_num,
      CASE WHEN event_type IN ('error', 'signup') THEN 'txt' || k END AS value_text
    FROM ev e LEFT JOIN marks m USING (instrument_id) WHERE e.time > COALESCE(m.mark, TIMESTAMP '1900-01-01')""",
)
def _(spark, sf):
    ev = events(spark, sf)
    kind, k = F.col("event_type"), F.col("k")
    properties = ev.select(
        "instrument_id",
        F.col("time").alias("event_dtm"),
        k.alias("event_property_type_id"),
        F.when(kind == "purchase", F.col("value")).alias("value_float"),
        F.when(kind == "view", k).alias("value_int"),
        F.when(kind == "click", k % 2 == 1).alias("value_bool"),
        F.when(kind.isin("error", "signup"), F.concat(F.lit("txt"), k)).alias("value_string"),
    )
    stored = ev.where("event_id % 7 = 0 AND instrument_id % 3 <> 0 AND time < '2024-01-15'")
    return tabular.typed_property_events(properties, stored)


@register(
    "io14_enums_from_config",
    """SELECT DISTINCT 'E' || (k % 10) AS name, m.member_name, m.value FROM ev,
       (VALUES ('on', 1), ('off', 0)) AS m(member_name, value)
       UNION SELECT DISTINCT 'E' || (k % 10), 'user' || (k % 4), 10 + k % 4 FROM ev""",
)
def _(spark, sf):
    k = F.col("k")
    config = F.concat(
        F.lit('<root xmlns:nil="urn:x"><Instrument><G><Parm ID="'), k, F.lit('" Enum="E'), k % 10,
        F.lit('"/><Parm ID="7"/></G></Instrument><Enums><Enum Name="E'), k % 10,
        F.lit('"><Value Name="on" ID="1"/><Value Name="off" ID="0"/><Value Name="user'), k % 4, F.lit('" ID="'), k % 4 + 10,
        F.lit('"/></Enum></Enums></root>'),
    )
    return xml_export.enums_from_config(events(spark, sf).select(config.alias("config")))[1]


@register(
    "io14_params_from_config",
    "SELECT DISTINCT k AS param_id, 'E' || (k % 10) AS enum_name FROM ev",
)
def _(spark, sf):
    k = F.col("k")
    config = F.concat(
        F.lit('<root xmlns:nil="urn:x"><Instrument><G><Parm ID="'), k, F.lit('" Enum="E'), k % 10,
        F.lit('"/><Parm ID="7"/></G></Instrument></root>'),
    )
    return xml_export.enums_from_config(events(spark, sf).select(config.alias("config")))[0]


@register(
    "io15_active_parameters",
    """SELECT CAST(p.p_partkey AS BIGINT) AS param_id, p.p_size AS event_id, 'event ' || n.n_name AS event_name,
      p.p_name AS param_name, p.p_brand AS display_name, 'u' || p.p_size AS display_unit, 's' || p.p_size AS storage_unit,
      r.r_name AS value_type, p.p_retailprice AS abs_min, p.p_retailprice * 2 AS abs_max,
      p.p_retailprice + 1 AS caution_min, p.p_retailprice + 2 AS caution_max, p.p_retailprice + 3 AS warning_min,
      p.p_retailprice + 4 AS warning_max, p.p_retailprice + 5 AS critical_min, p.p_retailprice + 6 AS critical_max
    FROM part p JOIN region r ON r.r_regionkey = p.p_partkey % 5 JOIN nation n ON n.n_nationkey = p.p_size
    WHERE p.p_size % 3 <> 0""",
    fleet=False,
)
def _(spark, sf):
    part, size, price = read(spark, sf, "part"), F.col("p_size"), F.col("p_retailprice")
    types = part.select(
        F.col("p_partkey").alias("event_property_type_id"),
        size.alias("event_type_id"),
        (F.col("p_partkey") % 5).alias("parameter_type_id"),
        F.col("p_name").alias("identifying_name"),
        F.col("p_brand").alias("label"),
        F.concat(F.lit("u"), size).alias("display_units"),
        F.concat(F.lit("s"), size).alias("storage_units"),
        price.alias("absolute_min"),
        (price * 2).alias("absolute_max"),
        *[
            (price + i + 1).alias(n)
            for i, n in enumerate(
                ["caution_min", "caution_max", "warning_min", "warning_max", "critical_min", "critical_max"]
            )
        ],
        (size % 3 != 0).alias("is_active"),
    )
    kinds = read(spark, sf, "region").select(
        F.col("r_regionkey").alias("parameter_type_id"), F.col("r_name").alias("identifying_name")
    )
    names = read(spark, sf, "nation").select(
        F.col("n_nationkey").alias("event_type_id"), F.concat(F.lit("event "), "n_name").alias("identifying_name")
    )
    return tabular.active_parameters(types, kinds, names)


@register(
    "io18_delete_before",
    "SELECT * FROM data WHERE NOT (instrument_id = 7 AND time < TIMESTAMP '2024-01-15')",
)
def _(spark, sf):
    return lake.delete_before(fleet(spark, sf).data, 7, "2024-01-15")


@register(
    "io19_delete_instrument",
    """SELECT 'data' AS tbl, instrument_id AS owner, CAST(COUNT(*) AS BIGINT) AS n FROM data WHERE instrument_id <> 7 GROUP BY 2
    UNION ALL SELECT 'parameters', instrument_id, COUNT(*) FROM parameters WHERE instrument_id <> 7 GROUP BY 2
    UNION ALL SELECT 'instruments', id, COUNT(*) FROM instruments WHERE id <> 7 GROUP BY 2
    UNION ALL SELECT 'enum_types', instrument_id, COUNT(*) FROM enum_types WHERE instrument_id <> 7 GROUP BY 2
    UNION ALL SELECT 'enum_values', t.instrument_id, COUNT(*) FROM enum_values v JOIN enum_types t ON t.id = v.enum_id
      WHERE t.instrument_id <> 7 GROUP BY 2
    UNION ALL SELECT 'parameters_history', instrument_id, COUNT(*) FROM parameters WHERE instrument_id <> 7 GROUP BY 2
    UNION ALL SELECT 'enum_values_history', t.instrument_id, COUNT(*) FROM enum_values v JOIN enum_types t ON t.id = v.enum_id
      WHERE t.instrument_id <> 7 GROUP BY 2""",
)
def _(spark, sf):
    f = fleet(spark, sf)
    left = lake.delete_instrument(
        {
            "data": f.data, "parameters": f.parameters, "instruments": f.instruments,
            "enum_types": f.enum_types, "enum_values": f.enum_values,
            "parameters_history": f.parameters, "enum_values_history": f.enum_values,
        },
        7,
    )
    owner = {
        "instruments": F.col("id"),
        "enum_values": F.floor(F.col("enum_id") / 100).cast("int"),
        "enum_values_history": F.floor(F.col("enum_id") / 100).cast("int"),
    }
    out = None
    for name, df in left.items():
        counted = (
            df.groupBy(owner.get(name, F.col("instrument_id")).alias("owner"))
            .agg(F.count("*").alias("n"))
            .withColumn("tbl", F.lit(name))
        )
        out = counted if out is None else out.unionByName(counted)
    return out


@register(
    "io20_purge",
    """SELECT 'orders' AS tbl, o_orderkey AS id FROM orders WHERE o_orderdate >= TIMESTAMP '1999-03-01' - INTERVAL 6 MONTH
    UNION ALL SELECT 'lineitem', l_orderkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-03-01' - INTERVAL 6 MONTH""",
    fleet=False,
)
def _(spark, sf):
    kept = lake.purge(
        {
            "orders": (read(spark, sf, "orders"), "o_orderdate"),
            "lineitem": (read(spark, sf, "lineitem"), "l_shipdate"),
        },
        "1999-03-01",
    )
    return kept["orders"].select(F.lit("orders").alias("tbl"), F.col("o_orderkey").alias("id")).unionByName(
        kept["lineitem"].select(F.lit("lineitem").alias("tbl"), F.col("l_orderkey").alias("id"))
    )


# metadata


@register(
    "md01_instrument_get_or_create",
    """SELECT c_custkey AS id, c_name AS instrument, c_mktsegment AS model FROM customer WHERE c_acctbal < 5000
    UNION ALL
    SELECT (SELECT MAX(c_custkey) FROM customer WHERE c_acctbal < 5000)
           + ROW_NUMBER() OVER (ORDER BY md5(c_name)[1:3], c_name), c_name, 'new ' || c_mktsegment
    FROM customer WHERE NOT (c_acctbal < 5000)""",
    fleet=False,
)
def _(spark, sf):
    customer = read(spark, sf, "customer")
    known = customer.where("c_acctbal < 5000").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("instrument"), F.col("c_mktsegment").alias("model")
    )
    incoming = customer.select(
        F.col("c_name").alias("instrument"), F.concat(F.lit("new "), "c_mktsegment").alias("model")
    )
    return metadata.get_or_create(known, incoming, ["instrument"])


@register(
    "md02_enum_type_get_or_create",
    """known AS (
      SELECT MIN(c_custkey) AS id, c_nationkey AS instrument_id, c_mktsegment AS name FROM customer
      WHERE c_mktsegment < 'C' GROUP BY 2, 3),
    fresh AS (
      SELECT DISTINCT c_nationkey AS instrument_id, c_mktsegment AS name FROM customer
      WHERE (c_nationkey, c_mktsegment) NOT IN (SELECT instrument_id, name FROM known))
    SELECT * FROM known UNION ALL
    SELECT (SELECT MAX(id) FROM known) + ROW_NUMBER() OVER (ORDER BY md5(instrument_id || '|' || name)[1:3], instrument_id, name),
      instrument_id, name FROM fresh""",
)
def _(spark, sf):
    rows = read(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("instrument_id"), F.col("c_mktsegment").alias("name")
    )
    known = rows.where("name < 'C'").groupBy("instrument_id", "name").agg(F.min("id").alias("id"))
    return metadata.get_or_create(known.select("id", "instrument_id", "name"), rows.drop("id"), ["instrument_id", "name"])


# Old and new state of a dimension: customers, some attributes changed, some rows only on one side.
ATTRS = ["segment", "balance", "nation"]
OLD_NEW_SQL = """
old AS (SELECT c_custkey AS id, c_mktsegment AS segment, c_acctbal AS balance,
          CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_nationkey END AS nation
        FROM customer WHERE c_mktsegment <> 'MACHINERY'),
new AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'X' ELSE c_mktsegment END AS segment, c_acctbal AS balance,
          CASE WHEN c_custkey % 22 = 0 THEN NULL ELSE c_nationkey END AS nation
        FROM customer WHERE c_mktsegment <> 'FURNITURE')"""


def _old_new(spark, sf):
    c, key = read(spark, sf, "customer"), F.col("c_custkey")
    base = [F.col("c_acctbal").alias("balance")]
    old = c.where("c_mktsegment <> 'MACHINERY'").select(
        key.alias("id"), F.col("c_mktsegment").alias("segment"), *base,
        F.when(key % 11 != 0, F.col("c_nationkey")).alias("nation"),
    )
    new = c.where("c_mktsegment <> 'FURNITURE'").select(
        key.alias("id"), F.when(key % 7 == 0, F.lit("X")).otherwise(F.col("c_mktsegment")).alias("segment"), *base,
        F.when(key % 22 != 0, F.col("c_nationkey")).alias("nation"),
    )
    return old, new


def _upsert_sql(attrs) -> str:
    old = ", ".join(["id", *attrs])
    return f"{OLD_NEW_SQL} SELECT {old} FROM new UNION ALL SELECT {old} FROM old WHERE id NOT IN (SELECT id FROM new)"


def _history_sql(attrs) -> str:
    cols = ", ".join(f"o.{a}" for a in ["id", *attrs])
    differ = " OR ".join(f"o.{a} IS DISTINCT FROM n.{a}" for a in attrs)
    return f"""{OLD_NEW_SQL} SELECT {cols}, TIMESTAMP '2024-02-01' AS inserted
    FROM old o JOIN new n ON n.id = o.id WHERE {differ}"""


@register("md03_enum_value_upsert", _upsert_sql(["segment"]))
def _(spark, sf):
    return metadata.upsert(*_old_new(spark, sf), ["id"], ["segment"])


@register("md04_parameter_upsert", _upsert_sql(ATTRS))
def _(spark, sf):
    return metadata.upsert(*_old_new(spark, sf), ["id"], ATTRS)


@register("md05_enum_value_history", _history_sql(["segment"]))
def _(spark, sf):
    return metadata.changed_rows(*_old_new(spark, sf), ["id"], ["segment"], "2024-02-01")


@register("md06_parameter_history", _history_sql(ATTRS))
def _(spark, sf):
    return metadata.changed_rows(*_old_new(spark, sf), ["id"], ATTRS, "2024-02-01")


@register(
    "md07_resolve_enums",
    """types AS (SELECT MIN(c_custkey) AS id, c_nationkey AS instrument_id, c_mktsegment AS name FROM customer
               WHERE c_acctbal > 8000 GROUP BY 2, 3)
    SELECT c.c_custkey AS param_id, c.c_nationkey AS instrument_id, t.id AS enum_id
    FROM customer c LEFT JOIN types t ON t.instrument_id = c.c_nationkey AND t.name = c.c_mktsegment""",
)
def _(spark, sf):
    c = read(spark, sf, "customer")
    params = c.select(
        F.col("c_custkey").alias("param_id"), F.col("c_nationkey").alias("instrument_id"),
        F.col("c_mktsegment").alias("enum_name"),
    )
    types = c.where("c_acctbal > 8000").groupBy(
        F.col("c_nationkey").alias("instrument_id"), F.col("c_mktsegment").alias("name")
    ).agg(F.min("c_custkey").alias("id"))
    return metadata.resolve_enums(params, types)


# refresh

NOW = datetime(2024, 1, 23, 12)


def _stale(f, until: str):
    """The fleet as it was when its events ended earlier."""
    return refresh.limited(f, date(1, 1, 1), date(9999, 1, 1)).__class__(
        f.data.where(F.col("time") < F.lit(until).cast("timestamp")),
        f.instruments, f.parameters, f.enum_types, f.enum_values,
    )


@register(
    "im02_windowed_refresh",
    f"SELECT * FROM ({IMAGES_DAILY}) WHERE day < TIMESTAMP '2024-01-22'",
)
def _(spark, sf):
    # stored when the events ended in the middle of a day that the refresh window covers
    f = fleet(spark, sf)
    stored = views.image_counters_daily(_stale(f, "2024-01-20 06:00:00"))
    start, end = refresh.window(NOW)
    return refresh.merged(stored, views.image_counters_daily(refresh.limited(f, start, end)), start, end)


@register("im03_backfill", LOADS_DAILY)
def _(spark, sf):
    # late events reached days before any refresh window; only recomputing everything repairs them
    f = fleet(spark, sf)
    stored = views.load_counters_daily(_stale(f, "2024-01-10"))
    start, end = date(2000, 1, 1), date(2100, 1, 1)
    return refresh.merged(stored, views.load_counters_daily(refresh.limited(f, start, end)), start, end)


@register("im04_realtime_view", DATA_DAILY)
def _(spark, sf):
    f = fleet(spark, sf)
    stored = views.data_counters_daily(_stale(f, "2024-01-18 09:00:00"))
    return refresh.realtime(stored, f, views.data_counters_daily, date(2024, 1, 18))


# the two metadata sections of an export, written from events and parsed back


@register(
    "io05_xml_enumerations",
    """SELECT DISTINCT 'I-' || instrument_id AS instrument, 'E' || (k % 10) AS enum_name, 'm' || (k + s.i) AS member_name,
      k + s.i AS value FROM ev, (VALUES (0), (100)) AS s(i)""",
)
def _(spark, sf):
    k = F.col("k")
    element = F.concat(
        F.lit('<Enumeration Name="E'), k % 10, F.lit('" Instrument="I-'), F.col("instrument_id"),
        F.lit('"><Literal Name="m'), k, F.lit('"> '), k, F.lit(' </Literal><Literal Name="m'), k + 100, F.lit('">'), k + 100,
        F.lit("</Literal></Enumeration>"),
    )
    parsed = F.from_xml(element, schema.XML_ENUMERATION, {"ignoreSurroundingSpaces": "false"})
    rows = events(spark, sf).select(F.lit("f").alias(xml_export.FILE), parsed.alias("x")).select(xml_export.FILE, "x.*")
    return xml_export.flatten_enumerations(rows).drop(xml_export.FILE).distinct()


@register(
    "io06_xml_parameters",
    """SELECT CAST(event_id AS INTEGER) AS param_id, 'S' || (k % 5) AS subsystem, 'C' || (k % 7) AS component, 'p' || k AS param_name,
      'd' || k AS display_name, NULL::VARCHAR AS display_unit, CASE WHEN k % 2 = 0 THEN 'mm' END AS storage_unit,
      CASE WHEN k % 3 = 0 THEN 'E' || k END AS enum_name,
      CASE event_type WHEN 'view' THEN 'int' WHEN 'click' THEN 'bool' WHEN 'purchase' THEN 'float' ELSE 'str' END AS value_type,
      k AS event_id, 'e' || k AS event_name, CASE WHEN k % 4 <> 0 THEN value END AS abs_min, 100.0::DOUBLE AS abs_max
    FROM ev""",
)
def _(spark, sf):
    k, kind = F.col("k"), F.col("event_type")
    exported_type = F.when(kind == "view", "Int").when(kind == "click", "Boolean").when(kind == "purchase", "Float").when(
        kind == "error", "String"
    ).otherwise("Unheard")
    attrs = {
        "ID": F.col("event_id"), "Name": F.concat(F.lit("p"), k), "DisplayName": F.concat(F.lit("d"), k),
        "DisplayUnit": F.lit(""), "StorageUnit": F.when(k % 2 == 0, "mm").otherwise(""), "Type": exported_type,
        "EnumerationName": F.when(k % 3 == 0, F.concat(F.lit("E"), k)), "EventID": k, "EventName": F.concat(F.lit("e"), k),
        "AbsoluteMinimum": F.when(k % 4 != 0, F.col("value").cast("string")).otherwise(""), "AbsoluteMaximum": F.lit("100"),
    }
    text = F.concat_ws(" ", *[
        F.concat(F.lit(f'{name}="'), value.cast("string"), F.lit('"')) for name, value in attrs.items()
    ])
    element = F.concat(
        F.lit('<Instrument Name="i"><Component Name="S'), k % 5, F.lit('"><Component Name="C'), k % 7, F.lit('"><Parameter '),
        text, F.lit("/></Component></Component></Instrument>"),
    )
    parsed = F.from_xml(element, schema.XML_INSTRUMENT)
    rows = events(spark, sf).select(
        F.col("event_id").cast("string").alias(xml_export.FILE), parsed.getField("Component").alias("_tree")
    )
    return xml_export.flatten_parameters(rows).drop(xml_export.FILE)

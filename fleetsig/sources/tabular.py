"""Flat and relational sources, and the CSV sink."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsig import schema
from fleetsig.sources.pieces import quoted_records, read_pieces, written

MODELS = ("tem", "sem")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Instrument registry (one JSON list); entries of an unknown type are refused."""
    rows = spark.read.schema(
        "instrument STRING, serial INT, model STRING, name STRING, type STRING, template STRING, server STRING"
    ).json(path, multiLine=True)
    wrong = F.concat(F.lit("instrument type not recognized: "), F.coalesce("type", F.lit("none")))
    return rows.withColumn("type", F.when(F.col("type").isin(*MODELS), F.col("type")).otherwise(F.raise_error(wrong)))


def read_events_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless five-column CSV; an empty field is NULL, a malformed line fails the load."""
    return spark.read.csv(path, schema=schema.EVENTS, nullValue="", emptyValue="", mode="FAILFAST")


def read_server_log(spark: SparkSession, path: str, stage=written) -> DataFrame:
    """Server log in CSV form with its declared columns; messages may span lines.

    Many tasks read one file (see ``quoted_records``). ``stage`` writes the lines, which are used twice, to a table.
    """
    records = quoted_records(stage(read_pieces(spark, path, "\n")))
    options = {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1"}
    return records.select(F.from_csv("record", schema.SERVER_LOG.toDDL(), options).alias("_r")).select("_r.*")


def read_alarm_source(spark: SparkSession, url: str, table: str, since=None, time_column: str = "ErrorDtm", **options: str) -> DataFrame:
    """A table of a remote relational database; the lower bound (an instant in UTC as text, or an id) is pushed to it."""
    df = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    if since is None:
        return df
    return df.where(F.col(time_column) > (F.lit(since).cast("timestamp") if isinstance(since, str) else F.lit(since)))


def typed_property_events(properties: DataFrame, stored: DataFrame) -> DataFrame:
    """Events from typed value columns, newer than what is stored of their instrument."""
    mark = stored.groupBy("instrument_id").agg(F.max("time").alias("_mark"))
    number = F.coalesce("value_float", F.col("value_int").cast("double"), F.col("value_bool").cast("int").cast("double"))
    newer = F.col("event_dtm") > F.coalesce("_mark", F.lit("1900-01-01").cast("timestamp"))
    return (
        properties.join(mark, "instrument_id", "left")
        .where(newer)
        .select(
            F.col("event_dtm").alias("time"),
            "instrument_id",
            F.col("event_property_type_id").alias("param_id"),
            number.alias("value_num"),
            F.col("value_string").alias("value_text"),
        )
    )


def active_parameters(property_types: DataFrame, parameter_types: DataFrame, event_types: DataFrame) -> DataFrame:
    """Metadata of the active parameters with their caution, warning and critical limits."""
    limits = [f"{level}_{end}" for level in ("caution", "warning", "critical") for end in ("min", "max")]
    kinds = parameter_types.select("parameter_type_id", F.col("identifying_name").alias("value_type"))
    kinds_of_event = event_types.select("event_type_id", F.col("identifying_name").alias("event_name"))
    return (
        property_types.where("is_active")
        .join(kinds, "parameter_type_id")
        .join(kinds_of_event, "event_type_id")
        .select(
            F.col("event_property_type_id").alias("param_id"),
            F.col("event_type_id").alias("event_id"),
            "event_name",
            F.col("identifying_name").alias("param_name"),
            F.col("label").alias("display_name"),
            F.col("display_units").alias("display_unit"),
            F.col("storage_units").alias("storage_unit"),
            "value_type",
            F.col("absolute_min").alias("abs_min"),
            F.col("absolute_max").alias("abs_max"),
            *limits,
        )
    )


def union_sources(sources: dict[int, DataFrame]) -> DataFrame:
    """One frame over per-instrument sources, each marked with its instrument."""
    marked = [df.withColumn("instrument_id", F.lit(i)) for i, df in sources.items()]
    return reduce(DataFrame.unionByName, marked)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)

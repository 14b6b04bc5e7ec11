"""Incremental import of error definitions and notifications."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# dimension -> (key, source columns, stored columns)
DIMENSIONS = {
    "subsystem": (["SubsystemID"], {"SubsystemID": "SubsystemID", "Subsystem": "IdentifyingName"}),
    "device_type": (["DeviceTypeID"], {"DeviceTypeID": "DeviceTypeID", "DeviceType": "IdentifyingName"}),
    "device_instance": (
        ["DeviceInstanceID", "DeviceTypeID"],
        {"DeviceInstanceID": "DeviceInstanceID", "DeviceTypeID": "DeviceTypeID", "DeviceInstance": "IdentifyingName"},
    ),
    "error_code": (
        ["DeviceTypeID", "ErrorCodeID"],
        {"DeviceTypeID": "DeviceTypeID", "ErrorCodeID": "ErrorCodeID", "ErrorCode": "IdentifyingName"},
    ),
}
DEFINITION_COLUMNS = ["ErrorDefinitionID", "SubsystemID", "DeviceTypeID", "ErrorCodeID", "DeviceInstanceID"]
ERROR_KEY = ["Time", "InstrumentID", "ErrorID"]


def add_absent(existing: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """Existing rows and those incoming ones whose key is new."""
    key = list(key)
    return existing.unionByName(incoming.dropDuplicates(key).join(existing.select(*key), key, "left_anti"))


def new_definitions(existing: DataFrame, source: DataFrame) -> DataFrame:
    """Definitions above the highest id stored (0 if none is)."""
    mark = existing.select(F.coalesce(F.max("ErrorDefinitionID"), F.lit(0)))
    return source.where(F.col("ErrorDefinitionID") > mark.scalar())


def normalise(dimensions: dict[str, DataFrame], fresh: DataFrame) -> dict[str, DataFrame]:
    """The four dimensions with the identifiers of new definitions added."""
    out = {}
    for name, (key, columns) in DIMENSIONS.items():
        rows = fresh.select(*[F.col(c).alias(n) for c, n in columns.items()])
        out[name] = add_absent(dimensions[name], rows, key)
    return out


def add_definitions(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    return add_absent(existing, fresh.select(*DEFINITION_COLUMNS), ["ErrorDefinitionID"])


def new_errors(existing: DataFrame, definitions: DataFrame, notifications: DataFrame) -> DataFrame:
    """Notifications of known definitions, later than what is stored of their instrument, one per key.

    ``notifications`` carries ``instrument_id``, so one pass serves the whole fleet. A row at or before the
    stored time of its instrument is never taken.
    """
    return errors_after(marks_of(existing), definitions, notifications)


def marks_of(errors: DataFrame) -> DataFrame:
    """The latest stored time of every instrument: instrument_id, mark."""
    return errors.groupBy(F.col("InstrumentID").alias("instrument_id")).agg(F.max("Time").alias("mark"))


def errors_after(marks: DataFrame, definitions: DataFrame, notifications: DataFrame) -> DataFrame:
    """Notifications of known definitions above their instrument's mark, one per key."""
    known = definitions.select("ErrorDefinitionID")
    later = F.col("ErrorDtm") > F.coalesce("mark", F.lit("1900-01-01").cast("timestamp"))
    rows = (
        notifications.join(known, "ErrorDefinitionID", "left_semi")
        .join(marks, "instrument_id", "left")
        .where(later)
        .select(
            F.col("ErrorDtm").alias("Time"),
            F.col("instrument_id").alias("InstrumentID"),
            F.col("ErrorDefinitionID").alias("ErrorID"),
            "MessageText",
        )
    )
    return rows.dropDuplicates(ERROR_KEY)


def import_incremental(tables: dict[str, DataFrame], source_definitions: DataFrame, notifications: DataFrame) -> dict[str, DataFrame]:
    """All alarm tables after an import. ``tables``: the four dimensions, ``error_definitions``, ``errors``."""
    fresh = new_definitions(tables["error_definitions"], source_definitions)
    out = normalise(tables, fresh)
    out["error_definitions"] = add_definitions(tables["error_definitions"], fresh)
    out["errors"] = tables["errors"].unionByName(
        new_errors(tables["errors"], out["error_definitions"], notifications)
    )
    return out

"""The stored alarm tables and their import by increments.

Errors are appended by month, older files stay as they are. How far each instrument has been read is a small table of marks,
which the sources get as lower bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsig import schema
from fleetsig.operators import alarms
from fleetsig.sources.lake import Lake, append_dedup
from fleetsig.sources.servers import Server

# Table and column names of the alarm store.
TABLES = {
    "subsystem": "SubsystemID INT, IdentifyingName STRING",
    "device_type": "DeviceTypeID INT, IdentifyingName STRING",
    "device_instance": "DeviceInstanceID INT, DeviceTypeID INT, IdentifyingName STRING",
    "error_code": "DeviceTypeID INT, ErrorCodeID INT, IdentifyingName STRING",
    "error_definitions": ", ".join(f"{c} INT" for c in alarms.DEFINITION_COLUMNS),
}

Source = Callable[[str, Sequence[Server]], DataFrame]


def import_alarms(lake: Lake, source: Source) -> None:
    """Add what is new on all servers. ``source(kind, servers)`` gives the definitions or notifications of the servers
    above the bound each of them carries, notifications with ``instrument_id``.

    Definitions come first, then errors, then marks; an import that was cut short can be repeated, as errors are compared with
    those stored of the same months.
    """
    servers = _servers(lake)
    if not servers:
        return
    with lake.staging() as stage:
        stored = {n: lake.read(f"alarms/{n}", ddl) for n, ddl in TABLES.items()}
        top = stored["error_definitions"].agg(F.max("ErrorDefinitionID")).first()[0]
        asked = [Server(s.instrument_id, s.server, top) for s in servers]
        defs = stage(source("definitions", asked).drop("instrument_id").dropDuplicates(["ErrorDefinitionID"]))
        fresh = alarms.new_definitions(stored["error_definitions"], defs)
        known = alarms.add_definitions(stored["error_definitions"], fresh)
        after = alarms.normalise({n: stored[n] for n in alarms.DIMENSIONS}, fresh) | {"error_definitions": known}
        if not defs.isEmpty():
            lake.replace_all({f"alarms/{n}": df for n, df in after.items()})
        marks = lake.alarm_marks()
        definitions = lake.read("alarms/error_definitions", TABLES["error_definitions"])
        new = stage(alarms.errors_after(marks, definitions, source("notifications", servers)))
        lake.append_errors(new, lambda existing, rows: append_dedup(existing, rows, alarms.ERROR_KEY))
        moved = new.groupBy(F.col("InstrumentID").alias("instrument_id")).agg(F.max("Time").alias("mark"))
        lake.move_marks(moved)


def _servers(lake: Lake) -> list[Server]:
    """One entry per instrument with a server, with its mark."""
    since = F.date_format("mark", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("since")
    marks = lake.alarm_marks().select("instrument_id", since)
    named = lake.read("instruments", schema.INSTRUMENTS).where("server IS NOT NULL").select(F.col("id").alias("instrument_id"), "server")
    return [Server(*r) for r in named.join(marks, "instrument_id", "left").orderBy("instrument_id").collect()]

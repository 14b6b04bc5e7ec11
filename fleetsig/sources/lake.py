"""The stored tables: parquet directories, the events partitioned by UTC day.

Alarm errors are partitioned by month. Small tables are replaced by writing a new version next to the old one. Rewritten days of the events go
through a staged copy, which is then published by dynamic partition overwrite.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from contextlib import contextmanager
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType, TimestampType

from fleetsig import schema
from fleetsig.operators.alarms import marks_of
from fleetsig.plans.views import Fleet
from fleetsig.session import prepare

ERRORS = "alarms/errors"
_ERROR_MONTHS, _MARKS = "alarms/error_months", "alarms/marks"
_ERROR_COLUMNS = "Time TIMESTAMP, InstrumentID INT, ErrorID INT, MessageText STRING"
# parameter first: most questions ask for one signal of the whole fleet
SORT = ["param_id", "instrument_id", "time"]
CHANGES = "instrument_id INT, param_id INT, since TIMESTAMP"
_STORED_EVENTS = StructType([*schema.EVENTS.fields, StructField("day", DateType())])


def append_dedup(existing: DataFrame, incoming: DataFrame, key: Sequence[str] = tuple(schema.EVENT_KEY)) -> DataFrame:
    """Rows of ``incoming`` with a key not stored yet, one per key."""
    return incoming.dropDuplicates(list(key)).join(existing.select(*key), list(key), "left_anti")


def delete_before(df: DataFrame, instrument_id: int, before, ts: str = "time", instrument: str = "instrument_id") -> DataFrame:
    """Without the instrument's rows older than a date (UTC midnight)."""
    old = (F.col(instrument) == instrument_id) & (F.col(ts) < F.lit(before).cast("timestamp"))
    return df.where(~F.coalesce(old, F.lit(False)))


def delete_instrument(tables: dict[str, DataFrame], instrument_id: int) -> dict[str, DataFrame]:
    """All tables without an instrument and what belongs to it; enumeration values and their history go with their type."""
    owner = {"instruments": "id", ERRORS: "InstrumentID"}
    of_type = ("enum_values", "enum_values_history")
    left = {
        name: df.where(F.col(owner.get(name, "instrument_id")) != instrument_id)
        for name, df in tables.items()
        if name not in of_type
    }
    for name in of_type:
        if name in tables:
            gone = tables["enum_types"].where(F.col("instrument_id") == instrument_id).select(F.col("id").alias("_gone"))
            left[name] = tables[name].join(gone, F.col("enum_id") == F.col("_gone"), "left_anti")
    return left


def purge(tables: dict[str, tuple[DataFrame, str]], as_of, drop_after: str = "6 months") -> dict[str, DataFrame]:
    """Snapshot tables (frame, time column) without rows older than the retention period."""
    limit = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {drop_after}")
    return {name: df.where(F.col(ts) >= limit) for name, (df, ts) in tables.items()}


class Lake:
    """Where the tables of one fleet live."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = prepare(spark), root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    # small tables, each kept as numbered versions of which the newest complete one counts

    def read(self, name: str, struct=None) -> DataFrame:
        """A stored table, empty if it was never written."""
        if name == ERRORS and self._has_parts(_ERROR_MONTHS):
            return self.errors()
        versions = self._versions(name)
        if versions:
            return self.spark.read.parquet(f"{self.path(name)}/version={versions[-1]}")
        if struct is None:
            raise FileNotFoundError(self.path(name))
        return self.spark.createDataFrame([], struct)

    def replace(self, name: str, df: DataFrame) -> None:
        """Give a table new content, which may be computed from the old one."""
        self.replace_all({name: df})

    def replace_all(self, tables: dict[str, DataFrame]) -> None:
        """Replace several tables that may be computed from each other's old content.

        A job that dies leaves the versions it completed; running it again starts from those. Old versions stay readable
        for whoever holds them until ``vacuum`` removes them by age.
        """
        kept = {name: self._versions(name) for name in tables}
        for name, df in tables.items():
            version = (kept[name][-1] if kept[name] else 0) + 1
            df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(
                f"{self.path(name)}/version={version}"
            )

    def vacuum(self, older_than_seconds: float = 7 * 86_400) -> list[str]:
        """Remove versions of small tables and views that were replaced longer ago than that; returns their paths."""
        limit = (time.time() - older_than_seconds) * 1000
        gone = []
        for name in self._versioned():
            fs, _ = self._fs(self.path(name))
            versions = self._versions(name)
            for old, newer in zip(versions, versions[1:]):
                marker = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/version={newer}/_SUCCESS")
                if fs.getFileStatus(marker).getModificationTime() <= limit:
                    gone.append(f"{self.path(name)}/version={old}")
        for path in gone:
            self._remove(path)
        return gone

    def _versioned(self, below: str = "") -> list[str]:
        """Names of the tables that are kept as versions."""
        fs, where = self._fs(f"{self.root}/{below}" if below else self.root)
        found = []
        for entry in fs.listStatus(where) if fs.exists(where) else []:
            child = entry.getPath().getName()
            if child.startswith("version="):
                return [below]
            if entry.isDirectory() and "=" not in child and not child.startswith("_"):
                found += self._versioned(f"{below}/{child}" if below else child)
        return found

    def _versions(self, name: str) -> list[int]:
        fs, where = self._fs(self.path(name))
        if not fs.exists(where):
            return []
        found = [f.getPath() for f in fs.listStatus(where) if f.getPath().getName().startswith("version=")]
        done = [d for d in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(d, "_SUCCESS"))]
        return sorted(int(d.getName().split("=")[1]) for d in done)

    # tables that only grow

    def log(self, name: str, struct) -> DataFrame:
        fs, where = self._fs(self.path(name))
        if not fs.exists(where):
            return self.spark.createDataFrame([], struct)
        return self.spark.read.schema(struct).parquet(self.path(name))

    def append(self, name: str, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.path(name))

    def fleet(self) -> Fleet:
        return Fleet(
            self.events(),
            self.read("instruments", schema.INSTRUMENTS),
            self.read("parameters", schema.PARAMETERS),
            self.read("enum_types", schema.ENUM_TYPES),
            self.read("enum_values", schema.ENUM_VALUES),
        )

    # events

    def events(self, days: Sequence[date] | None = None) -> DataFrame:
        """Stored events with their ``day``; ``days`` prunes partitions."""
        if self._has_events():
            df = self.spark.read.schema(_STORED_EVENTS).parquet(self.path("data"))
        else:
            df = self.spark.createDataFrame([], schema.EVENTS).withColumn("day", F.to_date("time"))
        return df if days is None else df.where(F.col("day").isin(*days))

    def append_events(self, incoming: DataFrame) -> None:
        """Add events whose key is not stored; a second import of the same rows changes nothing.

        Only the days the rows fall on are compared.
        """
        rows = incoming.select(*schema.EVENTS.fieldNames()).withColumn("day", F.to_date("time"))
        if not self._has_events():
            self._write_days(rows.dropDuplicates(schema.EVENT_KEY), "append")
            self._note_changes(_earliest(rows))
            return
        days = _days(rows)
        if not days:
            return
        with self.staging() as stage:
            fresh = stage(append_dedup(self.events(days), rows))
            if fresh.isEmpty():
                return
            # noted before, as a repeated import finds these rows stored; and after, for a refresh that came in between
            noted = _earliest(fresh)
            self._note_changes(noted)
            self._write_days(fresh, "append")
            self._note_changes(noted)

    def _has_events(self) -> bool:
        return self._has_parts("data")

    def _has_parts(self, name: str) -> bool:
        """Whether a partitioned table has rows."""
        fs, where = self._fs(self.path(name))
        return bool(fs.exists(where)) and any("=" in f.getPath().getName() for f in fs.listStatus(where))

    def delete_events(self, condition) -> None:
        """Remove matching events by rewriting the days that hold some."""
        days = _days(self.events().where(condition))
        if not days:
            return
        with self.staging() as stage:
            gone = stage(_earliest(self.events(days).where(condition)))
            self._note_changes(gone)
            survivors = stage(self.events(days).where(~F.coalesce(condition, F.lit(False))))
            left = set(_days(survivors))
            if left:
                self._write_days(survivors, "overwrite")
            for day in days:
                if day not in left:
                    self._remove(f"{self.path('data')}/day={day}")
            # once more for a refresh that came between the first note and the end
            self._note_changes(gone)

    def _note_changes(self, earliest: DataFrame) -> None:
        """Note the earliest time touched of each signal, a folder per import, for the refresh of derived tables."""
        earliest.write.parquet(f"{self.path('changes')}/note={uuid.uuid4().hex}")

    def pending_changes(self) -> list[str]:
        """Notes no refresh has dealt with; their number is that of imports and deletions since the last refresh."""
        fs, where = self._fs(self.path("changes"))
        found = [f.getPath() for f in fs.listStatus(where)] if fs.exists(where) else []
        done = [p for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(p.toString() for p in done)

    def changes(self, notes: Sequence[str]) -> DataFrame:
        """Earliest time touched (``since``) of each signal."""
        rows = self.spark.read.schema(CHANGES).parquet(*notes)
        return rows.groupBy("instrument_id", "param_id").agg(F.min("since").alias("since"))

    def forget_changes(self, notes: Sequence[str]) -> None:
        for path in notes:
            self._remove(path)

    def compact(self, days: Sequence[date] | None = None) -> None:
        """Rewrite days of events, each import having added files to them, as few sorted files."""
        rows = self.events(days)
        wanted = _days(rows) if days is None else list(days)
        for day in wanted:
            with self.staging() as stage:
                staged = stage(self.events([day]))
                if not staged.isEmpty():
                    self._write_days(staged, "overwrite")

    def delete_before(self, instrument_id: int, before: date) -> None:
        """Remove an instrument's events and alarms older than a date."""
        self.delete_events((F.col("instrument_id") == instrument_id) & (F.col("time") < F.lit(str(before)).cast("timestamp")))
        self.delete_errors((F.col("InstrumentID") == instrument_id) & (F.col("Time") < F.lit(str(before)).cast("timestamp")), instrument_id)

    # errors, which grow by month; and how far each instrument's have been read

    def errors(self) -> DataFrame:
        """Stored errors, whichever month they are of."""
        return self._error_months().drop("month")

    def _error_months(self, months: Sequence[date] | None = None) -> DataFrame:
        if self._has_parts(_ERROR_MONTHS):
            df = self.spark.read.schema(f"{_ERROR_COLUMNS}, month DATE").parquet(self.path(_ERROR_MONTHS))
        else:
            # a store that still keeps them as one table, or none
            whole = self.read(ERRORS) if self._versions(ERRORS) else self.spark.createDataFrame([], _ERROR_COLUMNS)
            df = whole.withColumn("month", _month("Time"))
        return df if months is None else df.where(F.col("month").isin(*months))

    def append_errors(self, rows: DataFrame, unseen) -> None:
        """Add the rows that ``unseen(stored, rows)`` leaves, comparing only with the months they fall on."""
        if not self._has_parts(_ERROR_MONTHS) and self._versions(ERRORS):
            self._write_errors(self._error_months(), "append")
        dated = rows.withColumn("month", _month("Time"))
        months = _days(dated, "month")
        if not months:
            return
        with self.staging() as stage:
            self._write_errors(stage(unseen(self._error_months(months), dated)), "append")

    def delete_errors(self, condition, instrument_id: int) -> None:
        """Remove an instrument's matching errors by rewriting the months that hold some; its mark follows what is left."""
        months = _days(self._error_months().where(condition), "month")
        if not months:
            return
        if not self._has_parts(_ERROR_MONTHS):
            self._write_errors(self._error_months(), "append")
        with self.staging() as stage:
            survivors = stage(self._error_months(months).where(~F.coalesce(condition, F.lit(False))))
            left = set(_days(survivors, "month"))
            if left:
                self._write_errors(survivors, "overwrite")
            for month in months:
                if month not in left:
                    self._remove(f"{self.path(_ERROR_MONTHS)}/month={month}")
            others = self.alarm_marks().where(F.col("instrument_id") != instrument_id)
            own = marks_of(self.errors().where(F.col("InstrumentID") == instrument_id))
            self.replace(_MARKS, others.unionByName(own))

    def alarm_marks(self) -> DataFrame:
        """Up to where each instrument's errors are stored: instrument_id, mark."""
        if self._versions(_MARKS):
            return self.read(_MARKS)
        return marks_of(self.errors())

    def move_marks(self, moved: DataFrame) -> None:
        both = self.alarm_marks().unionByName(moved)
        self.replace(_MARKS, both.groupBy("instrument_id").agg(F.max("mark").alias("mark")))

    def _write_errors(self, rows: DataFrame, mode: str) -> None:
        ordered = rows.hint("rebalance", "month").sortWithinPartitions("month", "InstrumentID", "Time")
        ordered.write.mode(mode).partitionBy("month").parquet(self.path(_ERROR_MONTHS))

    def delete_instrument(self, instrument_id: int) -> None:
        small = {
            name: self.read(name, struct)
            for name, struct in (
                ("instruments", schema.INSTRUMENTS), ("parameters", schema.PARAMETERS),
                ("enum_types", schema.ENUM_TYPES), ("enum_values", schema.ENUM_VALUES),
            )
        }
        stamped = [*schema.PARAMETERS.fields, StructField("inserted", TimestampType())]
        logs = {
            "parameters_history": self.log("parameters_history", StructType(stamped)),
            "enum_values_history": self.log(
                "enum_values_history", StructType([*schema.ENUM_VALUES.fields, StructField("inserted", TimestampType())])
            ),
        }
        left = delete_instrument(small | logs, instrument_id)
        # its files may come again once the instrument is registered anew
        files = self.log("imported_files", "path STRING, modificationTime TIMESTAMP")
        owners = self.log("import_counts", "source_file STRING, instrument_id INT").where(F.col("instrument_id") == instrument_id)
        left["imported_files"] = files.join(owners, F.col("path") == F.col("source_file"), "left_anti")
        for name in (*logs, "imported_files"):
            self._rewrite_log(name, left.pop(name))
        self.replace_all(left)
        self.delete_errors(F.col("InstrumentID") == instrument_id, instrument_id)
        self.delete_events(F.col("instrument_id") == instrument_id)

    def _rewrite_log(self, name: str, rows: DataFrame) -> None:
        """Give a growing table new content, computed from the old one."""
        fs, where = self._fs(self.path(name))
        if fs.exists(where):
            with self.staging() as stage:
                stage(rows).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(self.path(name))

    # derived tables

    def view(self, name: str, struct: StructType | None = None) -> DataFrame:
        """A derived table; the schema is needed where it may have no rows yet."""
        reader = self.spark.read if struct is None else self.spark.read.schema(struct)
        return reader.parquet(self._newest_view(name))

    def _newest_view(self, name: str) -> str:
        versions = self._versions(f"views/{name}")
        if not versions:
            raise FileNotFoundError(self.path(f"views/{name}"))
        return self.path(f"views/{name}/version={versions[-1]}")

    def write_view(self, name: str, df: DataFrame, partition: str | None = None) -> None:
        """Give a derived table new content, as a new version: readers keep what they have, a failed job changes nothing."""
        versions = self._versions(f"views/{name}")
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
        if partition:
            writer = writer.partitionBy(partition)
        writer.parquet(self.path(f"views/{name}/version={(versions[-1] if versions else 0) + 1}"))

    def has_view(self, name: str) -> bool:
        return bool(self._versions(f"views/{name}"))

    def write_view_days(self, name: str, df: DataFrame, column: str, start: date, end: date) -> None:
        """Replace the days [start, end) of a derived table, also by nothing, as a new version beside the one readers hold."""
        day = F.col(column)
        kept = self.view(name, df.schema).where(~((day >= F.lit(start)) & (day < F.lit(end))))
        self.write_view(name, kept.unionByName(df), column)

    # files

    def _write_days(self, rows: DataFrame, mode: str) -> None:
        # rebalance splits a day that is much larger than the others over several tasks and files
        (
            rows.hint("rebalance", "day")
            .sortWithinPartitions("day", *SORT)
            .write.mode(mode)
            .partitionBy("day")
            .parquet(self.path("data"))
        )

    @contextmanager
    def staging(self):
        """Gives a function that writes a frame to a table of its own, removed when the block ends."""
        written = []

        def stage(df: DataFrame) -> DataFrame:
            written.append(self._stage(df))
            return self.spark.read.schema(df.schema).parquet(written[-1])

        try:
            yield stage
        finally:
            for path in written:
                self._remove(path)

    def _stage(self, df: DataFrame) -> str:
        staged = self.path(f"_staging/{uuid.uuid4().hex}")
        df.write.parquet(staged)
        return staged

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _remove(self, path: str) -> None:
        fs, where = self._fs(path)
        fs.delete(where, True)


def _earliest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("instrument_id", "param_id").agg(F.min("time").alias("since"))


def _days(rows: DataFrame, column: str = "day") -> list[date]:
    """Distinct days of the rows (or months); their number is bounded by the calendar."""
    return [r[0] for r in rows.select(column).distinct().where(F.col(column).isNotNull()).collect()]


def _month(ts: str):
    # errors are far fewer than events: a folder per day would hold next to nothing
    return F.trunc(ts, "month")


def parse_day(text: str) -> date:
    """DD-MM-YYYY as used on the command line."""
    return datetime.strptime(text, "%d-%m-%Y").date()

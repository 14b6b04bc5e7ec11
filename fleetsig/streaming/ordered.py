"""Sessions from a stream whose samples come late and out of order.

Samples of a signal wait in a buffer of time slices in the state store. An event-time timer at the end of each slice releases it
once the watermark has passed it, so change points are found in time order whatever order the samples came in. A sample older
than the watermark can no longer be placed; it goes to a table of rejects instead of being dropped. Only touched slices
are written per micro-batch, and only changes of the state store are kept per micro-batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetsig.functions.times import micros
from fleetsig.streaming.aggregates import LATE

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SESSION, REJECT = "session", "reject"
FOUND = "instrument_id INT, param_id INT, kind STRING, session_id INT, start_us LONG, end_us LONG, value DOUBLE"


class OrderedSessions(StatefulProcessor):
    """Change-point sessions of one signal; rows out are closed sessions and rejected samples."""

    def __init__(self, slice_seconds: int, idle: float):
        self.width, self.idle = slice_seconds * 1_000_000, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slice long", "times array<long>, readings array<double>")
        self.last = handle.getValueState("last", "reading double, open_id int, open_start long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        for pdf in rows:
            late = pdf["us"] < passed
            if late.any():
                yield self._out(key, [(REJECT, None, us, None, v) for us, v in zip(pdf["us"][late], pdf["value_num"][late])])
            for number, part in pdf[~late].groupby(pdf["us"] // self.width):
                self._store(int(number), part)

    def _store(self, number: int, part: pd.DataFrame) -> None:
        """Add samples to a slice; one that is there already stays as it is."""
        held = {}
        if self.waiting.containsKey((number,)):
            times, readings = self.waiting.getValue((number,))
            held = dict(zip(times, readings))
        else:
            self.handle.registerTimer((number + 1) * self.width // 1000)
        for us, v in zip(part["us"].tolist(), part["value_num"].tolist()):
            held.setdefault(us, None if v is None or math.isnan(v) else v)
        times = sorted(held)
        self.waiting.updateValue((number,), (times, [held[t] for t in times]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ready = sorted(n for (n,) in self.waiting.keys() if (n + 1) * self.width <= passed)
        if not ready:
            return
        reading, open_id, open_start = self.last.get() if self.last.exists() else (None, None, None)
        closed = []
        for number in ready:
            for us, v in zip(*self.waiting.getValue((number,))):
                if v is not None and reading is not None and v != reading:
                    if open_start is not None:
                        closed.append((SESSION, open_id, open_start, us, None))
                    open_id, open_start = (round(v), us) if v != self.idle else (None, None)
                reading = v
            self.waiting.removeKey((number,))
        self.last.update((reading, open_id, open_start))
        if closed:
            yield self._out(key, closed)

    @staticmethod
    def _out(key, rows: list) -> pd.DataFrame:
        out = pd.DataFrame([(*key, *r) for r in rows], columns=[c.split()[0] for c in FOUND.split(", ")])
        return out.astype({"session_id": "Int32", "start_us": "Int64", "end_us": "Int64", "value": "Float64"})

    def close(self) -> None:
        pass


def ordered_sessions(samples: DataFrame, late: str = LATE, slice_seconds: int = 3600, idle: float = 0) -> DataFrame:
    """``FOUND`` rows of a stream of samples ``(instrument_id, param_id, time, value_num)``.

    The watermark stands on a copy of the time that goes no further: a time column that carries it would make Spark drop
    late samples before they can be counted.
    """
    clocked = samples.withColumn("_clock", F.col("time")).withWatermark("_clock", late)
    rows = clocked.where("time IS NOT NULL").select("instrument_id", "param_id", micros("time").alias("us"), "value_num")
    return rows.groupBy("instrument_id", "param_id").transformWithStateInPandas(
        OrderedSessions(slice_seconds, idle), FOUND, "Append", "EventTime"
    )


def stream_ordered_sessions(
    spark: SparkSession, samples: DataFrame, out: str, rejects: str, checkpoint: str, late: str = LATE,
    slice_seconds: int = 3600, trigger: dict | None = None,
):
    """Write closed sessions to ``out`` and samples that came too late to ``rejects``; returns the streaming query.

    Both are folders by micro-batch, so a replayed one overwrites its own rows.
    """
    spark.conf.set(_STORE, _ROCKS)  # state with timers needs this store
    found = ordered_sessions(samples, late, slice_seconds)

    def run(batch: DataFrame, batch_id: int) -> None:
        path = f"{checkpoint}/found/{batch_id}"
        batch.write.mode("overwrite").partitionBy("kind").parquet(path)
        rows = batch.sparkSession.read.schema(batch.schema).parquet(path)
        start, end = F.timestamp_micros("start_us"), F.timestamp_micros("end_us")
        key = ["instrument_id", "param_id"]
        rows.where(F.col("kind") == SESSION).select(*key, "session_id", start.alias("start_time"), end.alias("end_time")).write.mode(
            "overwrite"
        ).parquet(f"{out}/batch={batch_id}")
        rows.where(F.col("kind") == REJECT).select(*key, start.alias("time"), F.col("value").alias("value_num")).write.mode(
            "overwrite"
        ).parquet(f"{rejects}/batch={batch_id}")

    return (
        found.writeStream.foreachBatch(run)
        .option("checkpointLocation", f"{checkpoint}/query")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def reject_counts(rejects: DataFrame) -> DataFrame:
    """Samples per signal and day that came too late to be placed."""
    return rejects.groupBy("instrument_id", "param_id", F.to_date("time").alias("day")).agg(F.count("*").alias("rejected"))

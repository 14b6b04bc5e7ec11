"""Sessions from a stream: the batch operator on each micro-batch plus one state row per signal.

The state (last sample and open session of each signal) is a small table written once per micro-batch. Output
and state are addressed by batch id, so a replayed micro-batch overwrites its own rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsig.functions.times import whole
from fleetsig.operators.intervals import change_points

KEY = ["instrument_id", "param_id"]


def advance(
    state: DataFrame | None,
    rows: DataFrame,
    key: Sequence[str] = tuple(KEY),
    idle: float = 0,
    keep: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> tuple[DataFrame, DataFrame]:
    """Closed sessions and new state after a micro-batch. ``keep`` may store the change points, used repeatedly.

    State columns: key, ``time`` and ``value_num`` of the last sample, ``open_id`` and ``open_start`` of the
    session still running. Rows not later than the last sample seen of their signal are ignored.
    """
    key = list(key)
    rows = rows.select(*key, "time", "value_num")
    if state is not None:
        last = state.select(*key, F.col("time").alias("_seen"))
        rows = rows.join(last, key, "left").where(F.col("_seen").isNull() | (F.col("time") > F.col("_seen"))).drop("_seen")
        ordered = rows.unionByName(state.select(*key, "time", "value_num"))
    else:
        ordered = rows
    changes = keep(change_points(ordered, key, "time", "value_num"))
    begun = changes.where(F.col("value_num") != F.lit(idle)).select(
        *key, whole("value_num").alias("session_id"), F.col("time").alias("start_time"), F.col("_next").alias("end_time")
    )
    first = changes.groupBy(*key).agg(F.min("time").alias("_first"))
    closed = begun.where("end_time IS NOT NULL")
    opened = begun.where("end_time IS NULL").select(
        *key, F.col("session_id").alias("open_id"), F.col("start_time").alias("open_start")
    )
    if state is not None:
        running = state.where("open_start IS NOT NULL").select(*key, "open_id", "open_start")
        ended = running.join(first, key).select(
            *key, F.col("open_id").alias("session_id"), F.col("open_start").alias("start_time"), F.col("_first").alias("end_time")
        )
        closed = closed.unionByName(ended)
        opened = opened.unionByName(running.join(first, key, "left_anti"))
    newest = ordered.groupBy(*key).agg(F.max("time").alias("time"), F.max_by("value_num", "time").alias("value_num"))
    return closed, newest.join(opened, key, "left")


def stream_sessions(spark: SparkSession, samples: DataFrame, out: str, checkpoint: str, trigger: dict | None = None):
    """Write closed sessions of a stream of samples to ``out``; returns the streaming query."""

    def run(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        state = _state(session, checkpoint, batch_id - 1)

        def keep(changes: DataFrame) -> DataFrame:
            changes.write.mode("overwrite").parquet(f"{checkpoint}/changes")
            return session.read.schema(changes.schema).parquet(f"{checkpoint}/changes")

        closed, after = advance(state, batch, keep=keep)
        after.write.mode("overwrite").parquet(f"{checkpoint}/state/{batch_id}")
        closed.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        _forget(session, f"{checkpoint}/state/{batch_id - 2}")

    return (
        samples.writeStream.foreachBatch(run)
        .option("checkpointLocation", f"{checkpoint}/query")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _state(spark: SparkSession, checkpoint: str, batch_id: int) -> DataFrame | None:
    """State left by a micro-batch; only the very first one has none before it."""
    return None if batch_id < 0 else spark.read.parquet(f"{checkpoint}/state/{batch_id}")


def _forget(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

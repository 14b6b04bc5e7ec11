"""Ordered (previous / next / running) columns that hold up under hot keys.

A plain window partitioned by signal puts a signal's whole history into one task. Here a history is cut
into slices of fixed length. Ordered work happens inside ``(key, slice)``; what has to cross a slice edge
is reduced to one summary row per ``(key, slice)`` before it is shuffled, put in order there, and joined
back on the partitioning the rows already have. The longest group any task sees is one slice of one key,
or one key's slice summaries, whose number is bounded by the time span and not by the number of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetsig.functions.times import SECOND, col, micros

SLICE = "_slice"
_WIDTH_CONF = "spark.fleetsig.slice.seconds"


def slice_width() -> int:
    """Slice length in microseconds; one hour unless the session says otherwise."""
    spark = SparkSession.getActiveSession()
    return int(float(spark.conf.get(_WIDTH_CONF, "3600")) * SECOND)


def slice_of(ts: str | Column) -> Column:
    # never NULL, so a join on it adds no filter that would keep Spark from reusing the shuffle below it
    return F.coalesce(F.floor(micros(ts) / F.lit(slice_width())).cast("long"), F.lit(0))


def sliced(df: DataFrame, key: Sequence[str], ts: str) -> DataFrame:
    """Rows with their slice; a row without key or time cannot be ordered and is left out."""
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*key, ts]])
    return df.where(present).withColumn(SLICE, slice_of(ts))


def slice_start(slice_id: str | Column) -> Column:
    return F.timestamp_micros(col(slice_id) * F.lit(slice_width()))


def _summed(cut: DataFrame, columns: Sequence[str], group: Sequence[str], ts: str, sums: Sequence[Column]) -> DataFrame:
    """Slice summaries from the rows as they are shuffled for their order.

    Reading every column keeps the shuffle below the same one as that of the rows, so it is made once and used twice.
    """
    whole = F.max_by(F.struct(*columns), ts).alias("_whole")
    return cut.groupBy(*group).agg(whole, *sums).where(F.col("_whole").isNotNull())


def neighbours(
    df: DataFrame,
    key: Sequence[str],
    ts: str,
    prev: Mapping[str, str] | None = None,
    next: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add columns of the previous and following row of the same key in time order.

    ``prev`` and ``next`` map new column names to existing ones.
    """
    prev, next = dict(prev or {}), dict(next or {})
    group = [*key, SLICE]
    cut = sliced(df, key, ts).repartition(*group)

    inside = Window.partitionBy(*group).orderBy(ts)
    added = {n: F.lag(c).over(inside) for n, c in prev.items()}
    added |= {n: F.lead(c).over(inside) for n, c in next.items()}
    if prev:
        added["_is_first"] = F.lag(ts).over(inside).isNull()
    if next:
        added["_is_last"] = F.lead(ts).over(inside).isNull()
    last = [F.max_by(c, ts).alias(f"_last_{n}") for n, c in prev.items()]
    first = [F.min_by(c, ts).alias(f"_first_{n}") for n, c in next.items()]
    across = Window.partitionBy(*key).orderBy(SLICE)
    edges = _summed(cut, df.columns, group, ts, [*last, *first]).select(
        *group,
        *[F.lag(f"_last_{n}").over(across).alias(f"_edge_{n}") for n in prev],
        *[F.lead(f"_first_{n}").over(across).alias(f"_edge_{n}") for n in next],
    )
    joined = cut.withColumns(added).join(edges, group)
    fixed = {n: F.when(F.col("_is_first"), F.col(f"_edge_{n}")).otherwise(F.col(n)) for n in prev}
    fixed |= {n: F.when(F.col("_is_last"), F.col(f"_edge_{n}")).otherwise(F.col(n)) for n in next}
    return joined.select(*df.columns, *[c.alias(n) for n, c in fixed.items()])


def running(
    df: DataFrame,
    key: Sequence[str],
    ts: str,
    order: Sequence[str],
    maxima: Mapping[str, str] | None = None,
    sums: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add running maxima and sums from a key's first row up to and including the current one.

    ``order`` names the columns breaking ties of ``ts``.
    """
    maxima, sums = dict(maxima or {}), dict(sums or {})
    group = [*key, SLICE]
    cut = sliced(df, key, ts).repartition(*group)
    before = Window.partitionBy(*key).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    inside = (
        Window.partitionBy(*group).orderBy(ts, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    added = {f"_in_{n}": F.max(c).over(inside) for n, c in maxima.items()}
    added |= {f"_in_{n}": F.sum(c).over(inside) for n, c in sums.items()}
    whole = [F.max(c).alias(f"_all_{n}") for n, c in maxima.items()] + [F.sum(c).alias(f"_all_{n}") for n, c in sums.items()]
    edges = _summed(cut, df.columns, group, ts, whole).select(
        *group,
        *[F.max(f"_all_{n}").over(before).alias(f"_edge_{n}") for n in maxima],
        *[F.sum(f"_all_{n}").over(before).alias(f"_edge_{n}") for n in sums],
    )
    joined = cut.withColumns(added).join(edges, group)
    return joined.select(
        *df.columns,
        *[F.greatest(f"_in_{n}", f"_edge_{n}").alias(n) for n in maxima],
        *[(F.col(f"_in_{n}") + F.coalesce(f"_edge_{n}", F.lit(0))).alias(n) for n in sums],
    )

"""Exact quantiles of groups of any size."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetsig.session import checkpoint_dir

FIT = 100_000  # distinct values that may be ordered in one task
SPLITS = 64


def counts(df: DataFrame, by: Sequence[str], value: str, *more: Column) -> DataFrame:
    """How often each value ``_v`` of a group occurs (``_c``), combined map-side: the one pass over the rows."""
    return df.groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c"), *more)


def fits(counted: DataFrame, by: Sequence[str], fit: int = FIT) -> bool:
    """Whether no group has more distinct values than one task may order."""
    return counted.groupBy(*by).count().where(F.col("count") > fit).isEmpty()


def _usable() -> Column:
    return F.col("_v").isNotNull() & ~F.isnan("_v")


def ranked(counted: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counted values with the ranks ``_from`` (included) to ``_to`` (excluded) they hold, and the group's size ``_n``.

    Orders a group's distinct values in one task. Missing values hold no rank.
    """
    c = F.when(_usable(), F.col("_c")).otherwise(0)
    group = Window.partitionBy(*by)
    upto = F.sum(c).over(group.orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    return counted.withColumns({"_to": upto, "_from": upto - c, "_n": F.sum(c).over(group)})


def quantile_of(q: float) -> Column:
    """Aggregate over ranked values: the linearly interpolated quantile."""
    rank = F.lit(q) * (F.col("_n") - 1)
    a, b = (F.max(F.when((F.col("_from") <= r) & (r < F.col("_to")), F.col("_v"))) for r in (F.floor(rank), F.ceil(rank)))
    weight = F.max(rank - F.floor(rank))
    return F.when(weight == 0, a).otherwise(a + (b - a) * weight)


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, wanted: Mapping[str, float], fit: int = FIT) -> DataFrame:
    """Linearly interpolated quantiles per group, one column per entry of ``wanted``; groups without a value are absent.

    The rows are read once, for the counts of their values, which are written. Where a group has more distinct values than a
    task may order, :func:`selected` narrows them down for all groups at once.
    """
    by = list(by)
    counted = _stored(counts(df.where(F.col(value).isNotNull() & ~F.isnan(value)), by, value))
    if not fits(counted, by, fit):
        return selected(counted, by, wanted, fit)
    return ranked(counted, by).groupBy(*by).agg(*[quantile_of(q).alias(name) for name, q in wanted.items()])


def _stored(df: DataFrame) -> DataFrame:
    path = f"{checkpoint_dir(df.sparkSession)}/ranks-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def selected(counted: DataFrame, by: Sequence[str], wanted: Mapping[str, float], fit: int = FIT) -> DataFrame:
    """The same by selection in rounds.

    A round cuts what is left for a wanted rank at ``SPLITS`` of its values, adds up the counts of the parts, and keeps the part
    the rank falls into. It is over when no part has more than ``fit`` distinct values; each round leaves about
    a ``SPLITS``th, and no task orders more than the parts of a rank or ``fit`` values.
    """
    by = list(by)
    target = [*by, "_name", "_side"]
    size = F.sum("_c").alias("_n")
    places = counted.groupBy(*by).agg(size).select(*by, F.explode(F.array(*[
        F.struct(F.lit(name).alias("_name"), F.lit(side).alias("_side"), cut(F.lit(q) * (F.col("_n") - 1)).alias("_rank"))
        for name, q in wanted.items() for side, cut in enumerate((F.floor, F.ceil))
    ])).alias("_t")).select(*by, "_t.*")
    weights = counted.groupBy(*by).agg(size)
    left = _stored(counted.join(places, by))
    while not fits(left, target, fit):
        marks = left.groupBy(*target).agg(
            F.percentile_approx("_v", [i / SPLITS for i in range(1, SPLITS)], 1000).alias("_marks")
        )
        part = F.aggregate("_marks", F.lit(0), lambda n, m: n + (m < F.col("_v")).cast("int"))
        parts = left.join(marks, target).withColumn("_part", part).drop("_marks")
        sums = parts.groupBy(*target, "_rank", "_part").agg(F.sum("_c").alias("_c"))
        upto = F.sum("_c").over(Window.partitionBy(*target).orderBy("_part"))
        chosen = sums.withColumn("_to", upto).where((F.col("_to") - F.col("_c") <= F.col("_rank")) & (F.col("_rank") < F.col("_to")))
        chosen = chosen.select(*target, "_part", (F.col("_rank") - F.col("_to") + F.col("_c")).alias("_within"))
        left = _stored(parts.join(chosen, [*target, "_part"]).drop("_part", "_rank").withColumnRenamed("_within", "_rank").select(left.columns))
    upto = F.sum("_c").over(Window.partitionBy(*target).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = left.withColumn("_to", upto).where((F.col("_to") - F.col("_c") <= F.col("_rank")) & (F.col("_rank") < F.col("_to")))
    out = found.join(weights, by).groupBy(*by)
    columns = []
    for name, q in wanted.items():
        a, b = (F.max(F.when((F.col("_name") == name) & (F.col("_side") == side), F.col("_v"))) for side in (0, 1))
        rank = F.lit(q) * (F.max("_n") - 1)
        weight = rank - F.floor(rank)
        columns.append(F.when(weight == 0, a).otherwise(a + (b - a) * weight).alias(name))
    return out.agg(*columns)

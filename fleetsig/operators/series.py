"""Series and status operators behind the dashboard panels; all take frames and return a frame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetsig.functions.times import ratio, time_bucket
from fleetsig.operators import quantiles
from fleetsig.operators.metadata import SIGNAL_KEY, any_of, with_ids_of


def share_of_total(df: DataFrame, by: Sequence[str], part: str, amount: str) -> DataFrame:
    """Amount per part and its percentage of the group's total, NULL where the total is zero."""
    total = F.sum("_amount").over(Window.partitionBy(*by))
    return (
        df.groupBy(*by, part)
        .agg(F.sum(amount).alias("_amount"))
        .withColumn("percentage", F.round(ratio(F.lit(100.0) * F.col("_amount"), total), 2))
    )


def latest(df: DataFrame, key: Sequence[str], columns: Sequence[str], ts: str = "time") -> DataFrame:
    """The newest row per key, combined map-side: no group is ever sorted or gathered."""
    return df.groupBy(*key).agg(F.max(ts).alias(ts), *[F.max_by(c, ts).alias(c) for c in columns])


def decode(df: DataFrame, enum_values: DataFrame, how: str = "inner", value: str = "value_num") -> DataFrame:
    """Attach the label of a code; needs ``enum_id``."""
    labels = enum_values.select("enum_id", F.col("value").cast("double").alias(value), "member_name")
    return df.join(labels, ["enum_id", value], how)


def latest_label(df: DataFrame, enum_values: DataFrame, key: Sequence[str]) -> DataFrame:
    """The newest label per key; codes without label are skipped before the newest is taken.

    The newest time of every code is found first, so only that many rows are decoded.
    """
    per_code = df.groupBy(*key, "enum_id", "value_num").agg(F.max("time").alias("time"))
    return latest(decode(per_code, enum_values), key, ["member_name"])


def latest_decoded(
    data: DataFrame,
    parameters: DataFrame,
    enum_values: DataFrame,
    modules: Mapping[str, Sequence[Mapping]],
    decode_first: bool = True,
) -> DataFrame:
    """Newest label of several named signals per instrument, all in one pass over the data.

    With ``decode_first`` codes without label are skipped before the newest is taken; otherwise a newest
    code without label removes the row.
    """
    name = F.lit(None).cast("string")
    for label, alternatives in reversed(list(modules.items())):
        name = F.when(any_of(alternatives), F.lit(label)).otherwise(name)
    dim = parameters.withColumn("name", name).where(F.col("name").isNotNull()).select(*SIGNAL_KEY, "enum_id", "name")
    rows = with_ids_of(data, dim).join(dim, SIGNAL_KEY).select(*SIGNAL_KEY, "name", "enum_id", "value_num", "time")
    if decode_first:
        newest = latest_label(rows, enum_values, ["instrument_id", "name"])
    else:
        newest = decode(latest(rows, [*SIGNAL_KEY, "name", "enum_id"], ["value_num"]), enum_values)
    return newest.select("instrument_id", "name", F.col("member_name").alias("value"), "time")


def bucket_avg(
    samples: DataFrame, by: Sequence[str], step: float, shift: float = 0.0, drop: float | None = None,
    value: str = "value_num", name: str = "value",
) -> DataFrame:
    """Mean per bucket and group of ``value + shift``, without readings equal to ``drop``."""
    rows = samples if drop is None else samples.where(F.col(value) != F.lit(drop))
    return rows.groupBy(time_bucket("time", step).alias("time"), *by).agg(F.avg(F.col(value) + F.lit(shift)).alias(name))


def reduce_series(samples: DataFrame, by: Sequence[str], value: str = "value_num") -> DataFrame:
    """min, max, median, sum, mean and last non-NULL value per series.

    All come from one table of how often, and when last, each value occurs; its values are ordered for the median.
    """
    by = list(by)
    counted = quantiles.counts(samples, by, value, F.max("time").alias("_at"))
    known = F.col("_v").isNotNull()
    total = F.sum(F.col("_v") * F.col("_c"))
    plain = [
        F.min("_v").alias("min"),
        F.max("_v").alias("max"),
        total.alias("sum"),
        (total / F.sum(F.when(known, F.col("_c")))).alias("mean"),
        F.max_by("_v", F.when(known, F.col("_at"))).alias("last_not_null"),
    ]
    if quantiles.fits(counted, by):
        return quantiles.ranked(counted, by).groupBy(*by).agg(*plain, quantiles.quantile_of(0.5).alias("median"))
    median = quantiles.selected(counted.where(known & ~F.isnan("_v")), by, {"median": 0.5})
    return counted.groupBy(*by).agg(*plain).join(median, by, "left")


def band(value: Column, steps: Sequence[tuple[float | None, str]]) -> Column:
    """Name of the highest step not above the value; the first step has no lower bound."""
    name = F.lit(steps[0][1])
    for lower, label in steps[1:]:
        name = F.when(value >= F.lit(lower), F.lit(label)).otherwise(name)
    return F.when(value.isNotNull(), name)


def value_text(value: Column, mapping: Mapping[float, str]) -> Column:
    """Text for listed values, the number itself otherwise."""
    text = value.cast("string")
    for number, label in mapping.items():
        text = F.when(value == F.lit(number), F.lit(label)).otherwise(text)
    return text


def rows_to_fields(df: DataFrame, by: Sequence[str], field: str, value: str, fields: Mapping[str, str]) -> DataFrame:
    """Turn rows into columns; ``fields`` maps values of ``field`` to column names."""
    return df.groupBy(*by).agg(
        *[F.first(F.when(F.col(field) == want, F.col(value)), ignorenulls=True).alias(name) for want, name in fields.items()]
    )


def component_delta(samples: DataFrame, by: Sequence[str]) -> DataFrame:
    return samples.groupBy(*by).agg((F.max("value_num") - F.min("value_num")).alias("counter_delta"))


def label_histogram(samples: DataFrame, enum_values: DataFrame, by: Sequence[str], good: Sequence[str]) -> DataFrame:
    """How often each label occurs, good states left out. Codes are counted before they are decoded."""
    counted = samples.groupBy(*by, "enum_id", "value_num").agg(F.count("*").alias("_n"))
    return (
        decode(counted, enum_values)
        .where(~F.col("member_name").isin(*good))
        .groupBy(*by, F.col("member_name").alias("error_type"))
        .agg(F.sum("_n").alias("errors"))
    )

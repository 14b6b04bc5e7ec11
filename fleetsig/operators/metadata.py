"""Instrument, parameter and enumeration metadata: selection, upsert and change history.

Dimension joins carry no broadcast hint: Spark broadcasts them by their size on disk (or, through AQE, by
their measured size) and otherwise joins by shuffle with skew handling.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIGNAL_KEY = ["instrument_id", "param_id"]


def matches(**predicates: str | Sequence[str]) -> Column:
    """Conjunction of column = value / column IN values."""
    tests = [
        F.col(name) == want if isinstance(want, (str, int)) else F.col(name).isin(*want)
        for name, want in predicates.items()
    ]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def any_of(alternatives: Sequence[Mapping[str, str | Sequence[str]]]) -> Column:
    """Disjunction of such conjunctions: a signal with different names across models."""
    return reduce(lambda a, b: a | b, [matches(**a) for a in alternatives])


def find_signals(parameters: DataFrame, *alternatives: Mapping[str, str | Sequence[str]]) -> DataFrame:
    return parameters.where(any_of(alternatives))


def resolve_signal(
    instruments: DataFrame,
    parameters: DataFrame,
    alternatives: Sequence[Mapping[str, str | Sequence[str]]],
    default: int | None = None,
) -> DataFrame:
    """Parameter id of one signal per instrument; the lowest id if several match, ``default`` if none does."""
    found = (
        find_signals(parameters, *alternatives)
        .groupBy("instrument_id")
        .agg(F.min("param_id").alias("param_id"))
    )
    ids = instruments.select(F.col("id").alias("instrument_id"))
    resolved = ids.join(found, "instrument_id", "left")
    if default is None:
        return resolved.where(F.col("param_id").isNotNull())
    return resolved.withColumn("param_id", F.coalesce("param_id", F.lit(default)))


def with_ids_of(data: DataFrame, dim: DataFrame) -> DataFrame:
    """Samples whose parameter id lies between the smallest and the largest one of ``dim``.

    The two bounds are scalar subqueries: nothing runs while the frame is built, and any number of ids is one range that
    reaches the scan. Stored events are sorted by parameter, so row groups and pages outside it are skipped. The join that
    follows still decides; this only spares reading.
    """
    bounds = dim.agg(F.min("param_id").alias("_lo"), F.max("param_id").alias("_hi"))
    return data.where(F.col("param_id").between(bounds.select("_lo").scalar(), bounds.select("_hi").scalar()))


def select_signals(
    data: DataFrame,
    parameters: DataFrame,
    *alternatives: Mapping[str, str | Sequence[str]],
    attrs: Sequence[str] = (),
) -> DataFrame:
    """Samples of the signals whose metadata match, with the wanted attributes."""
    dim = find_signals(parameters, *alternatives).select(*SIGNAL_KEY, *attrs)
    return with_ids_of(data, dim).join(dim, SIGNAL_KEY)


def enum_code(
    signals: DataFrame,
    enum_values: DataFrame,
    codes: Mapping[str, Sequence[str]],
    defaults: Mapping[str, int] | None = None,
) -> DataFrame:
    """Per signal, the code behind each group of labels: one column per entry of ``codes``.

    Signals whose enumeration has none of the labels are absent.
    """
    defaults = defaults or {}
    wanted = [label for labels in codes.values() for label in labels]
    columns = []
    for name, labels in codes.items():
        code = F.max(F.when(F.col("member_name").isin(*labels), F.col("value")))
        columns.append((F.coalesce(code, F.lit(defaults[name])) if name in defaults else code).alias(name))
    return (
        signals.select(*SIGNAL_KEY, "enum_id")
        .join(enum_values.where(F.col("member_name").isin(*wanted)), "enum_id")
        .groupBy(*SIGNAL_KEY)
        .agg(*columns)
    )


def number_rows(df: DataFrame, key: Sequence[str], id_col: str, start: Column) -> DataFrame:
    """Number rows ``start + 1, start + 2, ...`` in the order (bucket, key), where the bucket is the first
    three hex digits of the key's MD5.

    Rows are numbered bucket by bucket in parallel; only the bucket sizes, at most 4096 of them, meet in one
    task.
    """
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in key])
    rows = df.withColumn("_bucket", F.substring(F.md5(text), 1, 3))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_bucket").agg(F.count("*").alias("_size"))
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(*key))
    return (
        rows.withColumn("_rank", rank)
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(id_col, start + F.col("_offset") + F.col("_rank"))
        .drop("_bucket", "_rank", "_offset")
    )


def get_or_create(dim: DataFrame, incoming: DataFrame, natural_key: Sequence[str], id_col: str = "id") -> DataFrame:
    """Dimension with unseen natural keys added under fresh ids above the highest one in use.

    Existing rows keep all their attributes.
    """
    key = list(natural_key)
    top = dim.select(F.coalesce(F.max(id_col), F.lit(0))).scalar()
    fresh = incoming.dropDuplicates(key).join(dim.select(*key), key, "left_anti").drop(id_col)
    numbered = number_rows(fresh, key, id_col, top)
    kind = dim.schema[id_col].dataType
    named = numbered.withColumn(id_col, F.col(id_col).cast(kind))
    return dim.unionByName(named.select(*[c for c in dim.columns if c in named.columns]), allowMissingColumns=True)


def upsert(current: DataFrame, incoming: DataFrame, key: Sequence[str], attrs: Sequence[str]) -> DataFrame:
    """Incoming rows replace current rows of the same key; the rest of both sides is kept."""
    kept = current.join(incoming.select(*key), list(key), "left_anti")
    return kept.select(*key, *attrs).unionByName(incoming.select(*key, *attrs))


def changed_rows(
    current: DataFrame, incoming: DataFrame, key: Sequence[str], attrs: Sequence[str], inserted
) -> DataFrame:
    """Old versions of the rows an upsert really changes (NULL-safe), stamped with the time of the change."""
    old = F.struct(*[F.col(f"o.{a}") for a in attrs])
    new = F.struct(*[F.col(f"n.{a}") for a in attrs])
    same_key = reduce(lambda a, b: a & b, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key])
    return (
        current.alias("o")
        .join(incoming.alias("n"), same_key)
        .where(~old.eqNullSafe(new))
        .select(
            *[F.col(f"o.{c}") for c in [*key, *attrs]],
            F.lit(inserted).cast("timestamp").alias("inserted"),
        )
    )


def upsert_with_history(
    current: DataFrame, incoming: DataFrame, key: Sequence[str], attrs: Sequence[str], inserted
) -> tuple[DataFrame, DataFrame]:
    return upsert(current, incoming, key, attrs), changed_rows(current, incoming, key, attrs, inserted)


def resolve_enums(parameters: DataFrame, enum_types: DataFrame) -> DataFrame:
    """Replace ``enum_name`` by the id of the instrument's enumeration; NULL where it has none."""
    ids = enum_types.select("instrument_id", F.col("name").alias("enum_name"), F.col("id").alias("enum_id"))
    return parameters.join(ids, ["instrument_id", "enum_name"], "left").drop("enum_name")

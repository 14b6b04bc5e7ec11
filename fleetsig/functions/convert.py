"""Turning exported text into typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Type names of the export and the value types they stand for; others are text.
KNOWN_TYPES = {"Int": "int", "Float": "float", "String": "str", "Boolean": "bool"}


def value_type(exported: Column) -> Column:
    kind = F.lit("str")
    for name, target in KNOWN_TYPES.items():
        kind = F.when(exported == name, F.lit(target)).otherwise(kind)
    return kind


def numeric_value(text: Column, kind: Column) -> Column:
    """Number of a float, int or boolean signal; NULL where the text does not convert."""
    return (
        F.when(kind == "float", text.try_cast("double"))
        .when(kind == "int", text.try_cast("bigint").cast("double"))
        .when((kind == "bool") & (text != ""), (F.trim(text) == "true").cast("int").cast("double"))
    )


def text_value(text: Column, kind: Column) -> Column:
    """Text of a string signal; an empty element counts as missing."""
    return F.when(kind == "str", F.nullif(text, F.lit("")))


def utc_instant(text: Column) -> Column:
    """ISO-8601 text with offset or Z as an instant; NULL where it does not parse."""
    return text.try_cast("timestamp")

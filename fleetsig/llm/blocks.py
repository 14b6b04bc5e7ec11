"""Documents dealt into blocks of bounded size, so that several passes share one shuffle of the text."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

BLOCK_BYTES = 24_000_000


def count_blocks(docs: DataFrame, text: str, block_bytes: int = BLOCK_BYTES, least: int = 1) -> int:
    """Blocks of about ``block_bytes`` of text, ``least`` at least."""
    total = docs.agg(F.sum(F.octet_length(text)).alias("n")).first().n or 0
    return max(least, math.ceil(total / block_bytes))


def compressed(docs: DataFrame, text: str, into: str) -> DataFrame:
    """``docs`` with the text as compressed bytes, which a shuffle moves at two thirds of its own compression; null is empty."""
    kept = [c for c in docs.columns if c != text]
    schema = StructType([*[docs.schema[c] for c in kept], StructField(into, BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for part in batches:
            data = pa.array([pack((t.as_py() or "").encode()) for t in part.column(len(kept))], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], data], [*kept, into])

    return docs.select(*kept, text).mapInArrow(run, schema)


def unpacked(column) -> Iterator[np.ndarray]:
    """The bytes of each compressed text."""
    unpack = zstandard.ZstdDecompressor().decompress
    for value in column:
        yield np.frombuffer(unpack(value.as_py()), np.uint8) if value.is_valid else np.zeros(0, np.uint8)


def block_of(key: Column, text: Column, n: int) -> Column:
    """Block of a row; rows with a null id are spread by their text."""
    return F.pmod(F.when(key.isNull(), F.xxhash64(text)).otherwise(F.xxhash64(key)), F.lit(n)).cast("int")


def as_bytes(column) -> list[np.ndarray]:
    """UTF-8 bytes of each text of an Arrow column, without copies; nulls are empty."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    parts = column.chunks if hasattr(column, "chunks") else [column]
    found = []
    for part in parts:
        _, offsets, data = part.buffers()
        wide = np.int64 if str(part.type).startswith("large") else np.int32
        spots = np.frombuffer(offsets, wide)[part.offset : part.offset + len(part) + 1] if len(part) else np.zeros(1, wide)
        flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        found.extend(flat[a:b] for a, b in zip(spots, spots[1:]))
    return found

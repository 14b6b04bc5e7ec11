"""Text files read in blocks by many tasks, and what has to be carried from one block to the next.

Spark cuts a plain file at any byte and gives every record to the block it starts in. Where the meaning of a record
depends on earlier ones (the element it lies in, whether a quotation is open), the dependence is worked out inside each
block, reduced to one row per block, put in order there, and joined back. The longest ordered group is one block
(``spark.sql.files.maxPartitionBytes``) or one file's blocks. A compressed file is one block.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetsig.session import checkpoint_dir

FILE, BLOCK, AT, TEXT = "source_file", "_block", "_at", "_text"
_GROUP = [FILE, BLOCK]


def read_pieces(spark: SparkSession, paths: Sequence[str] | str, separator: str) -> DataFrame:
    """The text between separators with its file, block and order inside the block.

    How files fall into blocks may change from one run to the next, so write the result before using it more than once.
    """
    rows = spark.read.option("lineSep", separator).text(paths)
    return rows.select(
        F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK),
        F.monotonically_increasing_id().alias(AT), F.col("value").alias(TEXT),
    )


def written(df: DataFrame) -> DataFrame:
    """The frame as a table of its own in the shared folder."""
    path = f"{checkpoint_dir(df.sparkSession)}/pieces-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _so_far():
    return Window.partitionBy(*_GROUP).orderBy(AT).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _earlier_blocks():
    return Window.partitionBy(FILE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)


def carry_last(pieces: DataFrame, column: str) -> DataFrame:
    """Fill ``column`` with its last value at or before each piece of the file."""
    value = F.col(column)
    edges = pieces.groupBy(*_GROUP).agg(F.max_by(value, F.when(value.isNotNull(), F.col(AT))).alias("_last"))
    edges = edges.select(*_GROUP, F.last("_last", ignorenulls=True).over(_earlier_blocks()).alias("_edge"))
    filled = pieces.withColumn(column, F.last(column, ignorenulls=True).over(_so_far()))
    return filled.join(edges, _GROUP).withColumn(column, F.coalesce(column, "_edge")).drop("_edge")


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def quoted_records(lines: DataFrame, quote: str = '"') -> DataFrame:
    """Records of quoted text that may span lines: source_file, record.

    A line begins a record if the quotes before it in its file are even in number. Within a block that is known up to the
    parity at the block's beginning, so both cases are kept and the sum of quotes over earlier blocks decides. A quotation that
    is never closed makes one record of the rest of its file. Empty records are left out, a carriage return at a
    record's end is dropped.
    """
    counted = lines.withColumn("_quotes", _count(F.coalesce(TEXT, F.lit("")), quote))
    before = F.sum("_quotes").over(_so_far()) - F.col("_quotes")
    marked = counted.withColumn("_even", F.pmod(before, F.lit(2)) == 0)
    begins = {"_if_even": F.when(F.col("_even"), F.col(AT)), "_if_odd": F.when(~F.col("_even"), F.col(AT))}
    marked = marked.withColumns(begins)
    edges = marked.groupBy(*_GROUP).agg(
        F.sum("_quotes").alias("_all"), F.max("_if_even").alias("_last_even"), F.max("_if_odd").alias("_last_odd")
    )
    closed = F.pmod(F.coalesce(F.sum("_all").over(_earlier_blocks()), F.lit(0)), F.lit(2)) == 0
    edges = edges.withColumn("_closed", closed)
    last = F.when(F.col("_closed"), F.col("_last_even")).otherwise(F.col("_last_odd"))
    edges = edges.withColumn("_last", F.when(last.isNotNull(), F.struct(F.col(BLOCK).alias("block"), last.alias("at"))))
    edges = edges.select(*_GROUP, "_closed", F.last("_last", ignorenulls=True).over(_earlier_blocks()).alias("_edge"))

    known = marked.withColumns({c: F.max(c).over(_so_far()) for c in begins}).join(edges, _GROUP)
    own = F.when(F.col("_closed"), F.col("_if_even")).otherwise(F.col("_if_odd"))
    start = F.when(own.isNotNull(), F.struct(F.col(BLOCK).alias("block"), own.alias("at"))).otherwise(F.col("_edge"))
    whole = known.withColumn("_start", start).groupBy(FILE, "_start").agg(
        F.array_sort(F.collect_list(F.struct(BLOCK, AT, TEXT))).alias("_lines")
    )
    record = F.regexp_replace(F.array_join(F.col(f"_lines.{TEXT}"), "\n"), r"\r$", "")
    return whole.select(FILE, record.alias("record")).where("record <> ''")

"""Removal of lines that many documents share, keeping the last holder's copy.

Line hashes are range-partitioned and sorted by (hash, document descending, row): the first document of a hash is the one
that keeps its lines, and a stream over the partition sees the others behind it. A hash with very many documents spans
partitions; what crosses an edge is settled from one summary per edge. The outcome is a compressed bitmap per document
that loses lines, not text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetsig.llm.shared import materialise, width

MIN_CHARS = 20
MIN_DOCS = 3
_BLANK = " \t\n\v\f\r"
_NO_ID = -(1 << 63)  # a null id, smaller than any other
_LINE = pa.schema(
    [("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("n", pa.int32()), ("at", pa.list_(pa.int32()))]
)
_FOUND = pa.schema([("kind", pa.int32()), *_LINE, ("docs", pa.int64()), ("lo", pa.int64())])
_DROP, _OPEN, _EDGE = 0, 1, 2


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Documents named by ``(doc, row)``: the id and a hash of the text, so rows that share an id stay apart."""
    return docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID)).alias("doc"), F.xxhash64(F.col(text)).alias("row"), F.col(text).alias("text")
    )


def _split(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            halves, doc, row, n, at = bytearray(), [], [], [], []
            for d, r, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                lines = (text.as_py() or "").split("\n")
                held: dict[bytes, list[int]] = {}
                for i, line in enumerate(lines):
                    line = line.strip(_BLANK)
                    if len(line) >= min_chars:
                        held.setdefault(xxhash.xxh3_128_digest(line.encode().lower()), []).append(i)
                for digest, places in held.items():
                    halves += digest
                    at.append(places)
                doc.extend([d] * len(held))
                row.extend([r] * len(held))
                n.extend([len(lines)] * len(held))
            pair = np.frombuffer(bytes(halves), np.int64).reshape(-1, 2)
            columns = (pair[:, 0], pair[:, 1], doc, row, n, at)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LINE)], schema=_LINE)

    return run


class _Sweep:
    """State over one sorted partition: the hash at hand, its documents so far and the rows not yet settled."""

    def __init__(self, min_docs: int):
        self.min_docs, self.hash, self.out = min_docs, None, []

    def emit(self, rows: pa.RecordBatch, kind: int) -> None:
        if rows.num_rows:
            none = pa.nulls(rows.num_rows, pa.int64())
            kinds = pa.array(np.full(rows.num_rows, kind, np.int32))
            self.out.append(pa.RecordBatch.from_arrays([kinds, *rows.columns, none, none], schema=_FOUND))

    def begin(self, h: tuple[int, int], first: bool) -> None:
        self.hash, self.open, self.docs, self.hi, self.lo, self.held = h, first, 0, None, None, []

    def feed(self, rows: pa.RecordBatch) -> None:
        doc = rows.column("doc").to_numpy()
        self.hi = int(doc[0]) if self.hi is None else self.hi
        self.docs += int((doc[1:] != doc[:-1]).sum()) + int(self.lo is None or self.lo != doc[0])
        self.lo = int(doc[-1])
        if self.open:
            self.emit(rows, _OPEN)
        elif self.docs < self.min_docs:
            self.held.append(rows)
        else:
            for x in [*self.held, rows]:
                self.emit(x.filter(pa.array(x.column("doc").to_numpy() != self.hi)), _DROP)
            self.held = []

    def finish(self, last: bool) -> None:
        if self.hash is None or not (self.open or last):
            return
        for rows in self.held:
            self.emit(rows, _OPEN)
        edge = [_EDGE, *self.hash, self.hi, 0, 0, [], self.docs, self.lo]
        self.out.append(pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(edge, _FOUND)], schema=_FOUND))

    def batch(self, rows: pa.RecordBatch) -> None:
        h1, h2, doc = (rows.column(i).to_numpy() for i in range(3))
        new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        starts = np.flatnonzero(new)
        ends = np.r_[starts[1:], len(h1)]
        at, upto = 0, len(starts) - 1  # the last hash may go on
        while at < len(starts):
            h = int(h1[starts[at]]), int(h2[starts[at]])
            if h != self.hash:
                first = self.hash is None
                if not first:
                    self.finish(last=False)
                if not first and at < upto:  # whole hashes inside the partition, all at once
                    a, b = starts[at], starts[upto]
                    group = np.cumsum(new[a:b]) - 1
                    step = new[a:b] | np.r_[True, doc[a + 1 : b] != doc[a : b - 1]]
                    many = np.bincount(group, step) >= self.min_docs
                    keeper = doc[starts[at:upto]]
                    self.emit(rows.slice(a, b - a).filter(pa.array(many[group] & (doc[a:b] != keeper[group]))), _DROP)
                    at = upto
                    h = int(h1[starts[at]]), int(h2[starts[at]])
                self.begin(h, first)
            self.feed(rows.slice(starts[at], ends[at] - starts[at]))
            at += 1


def _sweep(min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Sweep(min_docs)
        for rows in batches:
            if rows.num_rows:
                state.batch(rows)
                yield from state.out
                state.out = []
        state.finish(last=True)
        yield from state.out

    return run


def _settle(edges: list, min_docs: int) -> list[tuple[int, int, int]]:
    """(hash, keeper) of the hashes at partition edges that enough documents hold; a document cut in two counts once."""
    kept, order = {}, sorted(edges, key=lambda e: (e.h1, e.h2, -e.doc, -e.lo))
    for e in order:
        n, keeper, lo = kept.get((e.h1, e.h2), (0, e.doc, None))
        kept[e.h1, e.h2] = n + e.docs - (lo == e.doc), keeper, e.lo
    return [(*h, keeper) for h, (n, keeper, _) in kept.items() if n >= min_docs]


@F.pandas_udf(T.BinaryType())
def _bitmap(n: pd.Series, at: pd.Series) -> pd.Series:
    def one(n, places):
        keep = np.ones(n, bool)
        keep[places] = False
        return zlib.compress(np.packbits(keep).tobytes())

    return n.combine(at, one)


def keep_bitmaps(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc, row, n, dropped, keep)`` for each document that loses lines: lines before, lines lost, zlib bitmap.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased. Keys of at least ``min_chars`` code points
    found in at least ``min_docs`` documents are kept only in the largest ``key`` that has them (every copy there).
    Rows with the same id are one document for counting but have their own bitmaps; null ids are one document, smaller
    than any other. A null or empty text is one empty line. Hashes have 128 bits.
    """
    spark = docs.sparkSession
    lines = _rows(docs, key, text).mapInArrow(_split(min_chars), "h1 long, h2 long, doc long, row long, n int, at array<int>")
    dealt = lines.repartitionByRange(width(spark), "h1", "h2", F.desc("doc"), "row").sortWithinPartitions(
        "h1", "h2", F.desc("doc"), "row"
    )
    swept = dealt.mapInArrow(
        _sweep(min_docs), "kind int, h1 long, h2 long, doc long, row long, n int, at array<int>, docs long, lo long"
    )
    swept = materialise(swept, "swept")
    # two edges a partition at most
    edges = swept.where(F.col("kind") == _EDGE).select("h1", "h2", "doc", "docs", "lo").collect()
    settled = spark.createDataFrame(_settle(edges, min_docs), "h1 long, h2 long, keeper long")
    crossing = swept.where(F.col("kind") == _OPEN).join(F.broadcast(settled), ["h1", "h2"]).where("doc <> keeper")
    lost = swept.where(F.col("kind") == _DROP).select("doc", "row", "n", "at").unionAll(crossing.select("doc", "row", "n", "at"))
    lost = lost.groupBy("doc", "row").agg(
        F.max("n").alias("n"), F.array_distinct(F.flatten(F.collect_list("at"))).alias("at")
    )
    return lost.select("doc", "row", "n", F.size("at").alias("dropped"), _bitmap("n", "at").alias("keep"))


def without(text: str | None, keep: bytes | None) -> str:
    """The kept lines of a text."""
    if keep is None:
        return text or ""
    lines = (text or "").split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return "\n".join([line for line, bit in zip(lines, bits) if bit])


@F.pandas_udf(T.StringType())
def _without(text: pd.Series, keep: pd.Series) -> pd.Series:
    return text.combine(keep, without)


def dedup_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, key: str = "doc_id", text: str = "text",
    into: str = "kept", counts: bool = False,
) -> DataFrame:
    """``docs`` with all their columns and the kept text in ``into``, which may name ``text`` itself.

    Null texts become empty. Every row is returned; a document whose lines all go has an empty text. With ``counts`` the
    lines before and the lines dropped follow as ``n_lines`` and ``n_dropped``.
    """
    if into != text and into in docs.columns:
        raise ValueError(f"column {into} exists")
    found = keep_bitmaps(docs, min_chars, min_docs, key, text).select(
        F.col("doc").alias("__doc"), F.col("row").alias("__row"), F.col("keep").alias("__keep"), F.col("dropped").alias("__dropped")
    )
    named = docs.withColumns(
        {"__id": F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID)), "__text": F.xxhash64(F.col(text))}
    )
    met = named.join(found, (F.col("__id") == F.col("__doc")) & (F.col("__text") == F.col("__row")), "left")
    kept = F.when(F.col("__keep").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(_without(F.col(text), F.col("__keep")))
    columns = [c for c in docs.columns if c != into]
    order = docs.columns if into in docs.columns else [*docs.columns, into]
    told = []
    if counts:
        told = ["n_lines", "n_dropped"]
        breaks = F.length(F.col(text)) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit("")))
        met = met.withColumns(
            {"n_lines": F.coalesce(breaks, F.lit(0)).cast("long") + 1, "n_dropped": F.coalesce("__dropped", F.lit(0)).cast("long")}
        )
    return met.select(*columns, kept.alias(into), *told).select(*order, *told)

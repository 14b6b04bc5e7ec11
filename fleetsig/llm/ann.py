"""Nearest neighbours by inner product, candidates from cross-polytope hashing.

A unit vector is turned by three rounds of random signs and a fast Hadamard transform; its bucket in a table is the signed
axis it is nearest to. A vector lies in one bucket per table, a query looks into the axes it is nearest to in turn. Inside
a bucket queries meet candidates as one matrix product, of which only the best few per query leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetsig.llm.shared import materialise, width

TABLES, PROBES = 8, 16
BLOCK = 8192
_QUERIES = 1024
_SEED = 7
_FOUND = "query long, rep long, score double"


def _usable(vec: Column) -> Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & finite & F.exists(vec, lambda x: x != 0)


def _vectors(df: DataFrame, key: str, vec: str) -> DataFrame:
    picked = df.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    return picked.where(F.col("id").isNotNull() & _usable(F.col("vec")))


def _hadamard(x: np.ndarray) -> np.ndarray:
    rows, n = x.shape
    half = 1
    while half < n:
        x = x.reshape(rows, -1, 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(rows, n)
        half *= 2
    return x


def rotate(x: np.ndarray, number: int) -> np.ndarray:
    """Pseudo-rotation of table ``number``: rows of ``x`` on signed axes (the axes, then their opposites)."""
    dim = x.shape[1]
    full = 1 << max(0, dim - 1).bit_length()
    y = np.zeros((len(x), full))
    y[:, :dim] = x / np.linalg.norm(x, axis=1, keepdims=True)
    rng = np.random.default_rng([_SEED, number, full])
    for _ in range(3):
        y = _hadamard(y * rng.choice((-1.0, 1.0), full)) / np.sqrt(full)
    return np.concatenate([y, -y], axis=1)


def _matrix(column: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, rows) for each length of vector in a batch."""
    sizes = column.value_lengths().to_numpy()
    flat, starts = column.flatten().to_numpy(), np.r_[0, np.cumsum(sizes)]
    return [(at, flat[starts[at][:, None] + np.arange(n)]) for n in np.unique(sizes) for at in [np.flatnonzero(sizes == n)]]


def _hash(tables: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for at, x in _matrix(part.column(1)):
                own = part.take(pa.array(at))
                for t in range(tables):
                    axes = rotate(x, t)
                    count = min(probes, axes.shape[1])
                    near = axes.argmax(axis=1)[:, None] if count == 1 else np.argpartition(-axes, count - 1, axis=1)[:, :count]
                    bucket = (x.shape[1] << 32) + (t << 24) + near
                    rows = own.take(pa.array(np.repeat(np.arange(len(x)), count)))
                    yield pa.RecordBatch.from_arrays([pa.array(bucket.ravel().astype(np.int64)), *rows.columns], ["bucket", "id", "vec"])

    return run


def _best(q_ids, q, c_ids, c, k: int) -> pa.RecordBatch:
    """The k best candidates of each query; the score is summed in the same order whatever the batch."""
    rough = q @ c.T
    if len(c_ids) > k:
        keep = np.argpartition(-rough, k, axis=1)[:, : k + 1]
        # whatever ties with the last one kept, up to rounding, stays too
        edge = np.take_along_axis(rough, keep, axis=1).min(axis=1, keepdims=True)
        rows, cols = np.nonzero(rough >= edge - 1e-9 * np.maximum(1, np.abs(edge)))
    else:
        rows, cols = (x.ravel() for x in np.indices(rough.shape))
    score = (q[rows] * c[cols]).sum(axis=1)
    order = np.lexsort((c_ids[cols], -score, rows))
    rows, cols, score = rows[order], cols[order], score[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    top = place < k
    columns = (q_ids[rows[top]], c_ids[cols[top]], score[top])
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["query", "rep", "score"])


def _meet(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (bucket, cut, kind): candidates of a cell first, then its queries, a few at a time."""
        cell, c_ids, c = None, None, None
        for part in batches:
            keys = np.stack([part.column(i).to_numpy() for i in range(2)], axis=1)
            kind, ids = part.column(2).to_numpy(), part.column(3).to_numpy()
            edges = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1) | (kind[1:] != kind[:-1])])
            for a, b in zip(edges, np.r_[edges[1:], len(ids)]):
                rows = _matrix(part.column(4).slice(a, b - a))[0][1]  # a cell has one length of vector
                here = tuple(keys[a])
                if kind[a] == 0:
                    new = cell != here
                    cell, c_ids, c = here, ids[a:b] if new else np.r_[c_ids, ids[a:b]], rows if new else np.r_[c, rows]
                elif cell == here:
                    for at in range(0, b - a, _QUERIES):
                        yield _best(ids[a:b][at : at + _QUERIES], rows[at : at + _QUERIES], c_ids, c, k)

    return run


def _top(found: DataFrame, k: int, by: str, what: str) -> DataFrame:
    """The k best of each ``by``; the same find made twice counts once."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), what)
    return found.withColumn("place", F.dense_rank().over(order)).where(F.col("place") <= k).drop("place").distinct()


def _scan(classes: DataFrame, asked: list, k: int) -> DataFrame:
    """Exact answers of a bounded block of queries."""
    asked = [(r.query, np.array(r.vec)) for r in asked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for at, c in _matrix(part.column(1)):
                same = [x for x in asked if len(x[1]) == c.shape[1]]
                if same:
                    yield _best(np.array([x[0] for x in same]), np.stack([x[1] for x in same]), part.column(0).to_numpy()[at], c, k)

    return _top(classes.select("rep", "vec").mapInArrow(run, _FOUND), k, "query", "rep")


def nearest(
    queries: DataFrame, base: DataFrame, k: int = 20, tables: int = TABLES, probes: int = PROBES, block: int = BLOCK,
    key: str = "vec_id", vec: str = "embedding",
) -> DataFrame:
    """``(query, rank, neighbour, score)``: the ``k`` rows of ``base`` with the largest inner product, ties to smaller ids.

    A row never finds its own id. Vectors that are null, empty, zero or hold null or non-finite components, and rows with
    a null id, take no part; vectors of another length are no candidates. Repeated rows count once; an id with several
    vectors is searched with each and found by its best. Equal vectors are hashed once and stand for their
    ``k + 1`` smallest ids, which is all that a result can show of them. A bucket of more than ``block`` candidates is cut
    up. Queries that found fewer than ``k`` are answered by an exact scan, in blocks, so small tables are complete.
    """
    spark = base.sparkSession
    order = Window.partitionBy("vec").orderBy("id")
    ranked = _vectors(base, key, vec).withColumn("n", F.dense_rank().over(order)).where(F.col("n") <= k + 1)
    classes = ranked.groupBy("vec").agg(F.min("id").alias("first"), F.sort_array(F.collect_set("id")).alias("ids"))
    # the vector is part of the name, as one id may come with several vectors
    classes = materialise(classes.select(F.xxhash64("first", "vec").alias("rep"), "vec", "ids"), "classes")
    wanted = _vectors(queries, key, vec).distinct()
    asked = wanted.groupBy("vec").agg(F.min("id").alias("first")).select(F.xxhash64("first", "vec").alias("query"), "vec")
    asked = materialise(asked, "asked")

    kind = "bucket long, id long, vec array<double>"
    stored = classes.select("rep", "vec").mapInArrow(_hash(tables, 1), kind)
    large = stored.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > block)
    large = materialise(large.select("bucket", F.ceil(F.col("n") / block).cast("int").alias("cuts")), "large")
    cuts = F.coalesce("cuts", F.lit(1))
    cand = stored.join(large, "bucket", "left").select(
        "bucket", F.pmod(F.xxhash64("id"), cuts).cast("int").alias("cut"), F.lit(0).alias("kind"), "id", "vec"
    )
    probe = asked.mapInArrow(_hash(tables, probes), kind).join(large, "bucket", "left").select(
        "bucket", F.explode(F.sequence(F.lit(0), cuts - 1)).alias("cut"), F.lit(1).alias("kind"), "id", "vec"
    )
    cells = cand.unionAll(probe).repartition(width(spark), "bucket", "cut").sortWithinPartitions("bucket", "cut", "kind")
    found = materialise(_top(cells.mapInArrow(_meet(k + 1), _FOUND), k + 1, "query", "rep"), "found")

    named = classes.select("rep", F.explode("ids").alias("id"))
    members = materialise(_top(found.join(named, "rep").select("query", "id", "score"), k + 1, "query", "id"), "members")
    total = _vectors(base, key, vec).select("id").distinct().limit(k + 1).count()
    short = asked.join(members.groupBy("query").agg(F.countDistinct("id").alias("n")), "query", "left")
    short = materialise(short.where(F.coalesce("n", F.lit(0)) < total).select("query", "vec"), "short")
    rows = short.toLocalIterator()
    while some := list(islice(rows, _QUERIES)):
        done = spark.createDataFrame([(r.query,) for r in some], "query long")
        exact = _scan(classes, some, k + 1).join(named, "rep").select("query", "id", "score")
        exact = _top(exact, k + 1, "query", "id")
        members = materialise(members.join(F.broadcast(done), "query", "left_anti").unionAll(exact), "members")

    # the same vector gives one list; every row that asks with it drops its own id
    asking = wanted.join(asked, "vec").select("query", F.col("id").alias("asker"))
    pairs = asking.join(members, "query").where("asker <> id").groupBy("asker", "query", "id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("asker", "query").orderBy(F.desc("score"), "id"))
    return pairs.withColumn("rank", place).where(F.col("rank") <= k).select(
        F.col("asker").alias("query"), "rank", F.col("id").alias("neighbour"), "score"
    )

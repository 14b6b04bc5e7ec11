"""Largest-Triangle-Three-Buckets down-sampling (Steinarsson 2013) of series of any length."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetsig.functions.times import micros
from fleetsig.operators.timeline import running
from fleetsig.session import checkpoint_dir

CHUNK = 20_000  # corners of a chunk, which a task holds together with those of the bucket before it
_CELLS = 1 << 22


def _corners(group_cols):
    """Function on batches keeping, of each group in a batch, the corners of its convex hull.

    A corner of a group is a corner of every part of the group it lies in, so batches may cut groups anywhere.
    """

    def keep(batches):
        for pdf in batches:
            group = pdf.groupby(group_cols, sort=False).ngroup().to_numpy()
            order = np.lexsort((pdf["_x"].to_numpy(), group))
            group = group[order]
            x, y = pdf["_x"].to_numpy()[order], pdf["_y"].to_numpy(np.float64)[order]
            x = (x - x.min()).astype(np.float64) if len(x) else x.astype(np.float64)
            chosen = np.zeros(len(x), dtype=bool)
            for sign in (1.0, -1.0):
                idx = np.arange(len(x))
                while len(idx) > 2:
                    a, b, c = idx[:-2], idx[1:-1], idx[2:]
                    # not above the chord of its two neighbours in the group: no corner
                    flat = sign * ((x[b] - x[a]) * (y[c] - y[a]) - (x[c] - x[a]) * (y[b] - y[a])) >= 0
                    inner = flat & (group[a] == group[c])
                    if not inner.any():
                        break
                    idx = np.concatenate([idx[:1], b[~inner], idx[-1:]])
                chosen[idx] = True
            yield pdf.iloc[np.sort(order[chosen])]

    return keep


def _best(x, y, base_x, base_y, next_x, next_y) -> np.ndarray:
    """For each base point the row of a bucket with the largest triangle to it and the mean of the next bucket."""
    found = []
    for at in range(0, len(base_x), max(1, _CELLS // len(x))):
        some = slice(at, at + max(1, _CELLS // len(x)))
        bx, by = base_x[some, None], base_y[some, None]
        found.append(np.abs((bx - next_x) * (y - by) - (bx - x) * (next_y - by)).argmax(axis=1))
    return np.concatenate(found)


def _steps(pdf: pd.DataFrame):
    """Buckets of a chunk in order: their x, y and the mean of the bucket after each (NaN for the very last)."""
    pdf = pdf.sort_values("_x", kind="stable")
    bucket = pdf["_bucket"].to_numpy()
    edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    columns = [pdf[c].to_numpy(np.float64) for c in ("_x", "_y", "_next_x", "_next_y")]
    for a, b in zip(edges, edges[1:]):
        x, y, next_x, next_y = (c[a:b] for c in columns)
        yield x, y, next_x[0], next_y[0]


def _choose(steps, base_x, base_y):
    """Choices of each bucket for some points chosen before; points that led to the same choice go on as one.

    Yields (x, y) chosen per point. The last bucket of a series has one row; the first has no point before it.
    """
    lead = np.arange(len(base_x))
    for x, y, next_x, next_y in steps:
        picked = np.zeros(max(1, len(base_x)), np.int64) if len(x) == 1 else _best(x, y, base_x, base_y, next_x, next_y)
        kept, back = np.unique(picked, return_inverse=True)
        lead = back[lead] if len(lead) else np.zeros(1, np.int64)
        base_x, base_y = x[kept], y[kept]
        yield base_x[lead], base_y[lead]


def _mapped(key):
    """Pandas function giving for each point that may come before a chunk the one that leaves it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        before = pdf[pdf["_role"] == 0].sort_values("_x")
        entry = before["_x"].to_numpy(np.int64)
        for left, _ in _choose(_steps(pdf[pdf["_role"] == 1]), before["_x"].to_numpy(np.float64), before["_y"].to_numpy(np.float64)):
            pass
        out = pd.DataFrame({"_entry": entry if len(entry) else [-1], "_exit": left.astype(np.int64)})
        for c in [*key, "_segment"]:
            out[c] = pdf[c].iloc[0]
        return out[[*key, "_segment", "_entry", "_exit"]]

    return run


def _walk(key):
    """Pandas function choosing one point per bucket of a chunk, from the point chosen before it."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        before, own = pdf[pdf["_role"] == 0], pdf[pdf["_role"] == 1]
        picks = list(_choose(_steps(own), before["_x"].to_numpy(np.float64), before["_y"].to_numpy(np.float64)))
        out = pd.DataFrame({"_x": np.concatenate([x for x, _ in picks]).astype(np.int64), "_y": np.concatenate([y for _, y in picks])})
        for c in key:
            out[c] = pdf[c].iloc[0]
        return out[[*key, "_x", "_y"]]

    return choose


def _entries(maps: DataFrame, key: Sequence[str], segments: int) -> DataFrame:
    """``(key, _segment, _entry)``: the point chosen before each chunk, from the maps of the chunks.

    Maps of neighbouring segments are composed pairwise until one segment is left (up), then each segment's entry gives
    those of its halves (down): twice log2(chunks) joins on the point, and no task sees a series.
    """
    levels = [maps]
    while segments > 1:
        below = levels[-1].withColumn("_half", F.col("_segment") % 2).withColumn("_segment", F.floor(F.col("_segment") / 2))
        first, second = below.where("_half = 0").drop("_half"), below.where("_half = 1")
        second = second.select(*key, "_segment", F.col("_entry").alias("_exit"), F.col("_exit").alias("_further"))
        # a segment without a second half ends with its first
        halves = second.select(*key, "_segment").distinct().withColumn("_two", F.lit(True))
        met = first.join(second, [*key, "_segment", "_exit"], "left").join(halves, [*key, "_segment"], "left")
        joined = met.select(*key, "_segment", "_entry", F.when(F.col("_two"), F.col("_further")).otherwise(F.col("_exit")).alias("_exit"))
        levels.append(_written(joined, f"level{len(levels)}"))
        segments = -(-segments // 2)
    entries = levels[-1].select(*key, "_segment", "_entry").distinct()
    for below in reversed(levels[:-1]):
        left = entries.withColumn("_segment", F.col("_segment") * 2)
        right = left.join(below, [*key, "_segment", "_entry"]).select(
            *key, (F.col("_segment") + 1).alias("_segment"), F.col("_exit").alias("_entry")
        )
        entries = left.unionByName(right).join(below.select(*key, "_segment").distinct(), [*key, "_segment"], "left_semi")
    return entries


def _written(df: DataFrame, name: str) -> DataFrame:
    path = f"{checkpoint_dir(df.sparkSession)}/lttb-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lttb(df: DataFrame, key: Sequence[str], ts: str, value: str, points: int, chunk: int = CHUNK) -> DataFrame:
    """Thin each series to ``points`` of its own rows; shorter series come back unchanged.

    First and last row stay, the rest is cut into ``points - 2`` buckets of equal row count, and each bucket
    gives the row with the largest triangle to the row chosen before and the mean of the next bucket. For a
    fixed base that area is linear in the row, so only corners of the bucket's convex hull can win: rows are
    reduced to such corners before and after the shuffle by bucket.

    The choices follow each other, but a bucket is a map from the corner chosen before it to its own choice. Buckets are
    gathered into chunks of about ``chunk`` corners; a chunk maps all corners it may be entered by, the maps are composed
    in log rounds, and once each chunk's entry is known the chunks are walked side by side.
    """
    key = list(key)
    rows = df.where(F.col(value).isNotNull() & F.col(ts).isNotNull()).select(*key, ts, value)
    if points < 3:
        return rows
    numbered = running(rows.withColumn("_one", F.lit(1)), key, ts, [], sums={"_rank": "_one"}).drop("_one")
    sizes = rows.groupBy(*key).agg(F.count("*").alias("_n"), F.min(micros(ts)).alias("_start"))
    placed = numbered.join(sizes, key)
    short = placed.where(F.col("_n") <= points).select(*key, ts, value)

    # bucket b in 1..points-2 holds the 0-based ranks floor((b-1)*every)+1 .. floor(b*every)
    i = F.col("_rank") - 1
    every = (F.col("_n") - 2) / F.lit(float(points - 2))
    guess = F.ceil(i / every)
    inner = F.when(i > F.floor(guess * every), guess + 1).when(i <= F.floor((guess - 1) * every), guess - 1).otherwise(guess)
    bucket = F.when(i == 0, 0).when(i == F.col("_n") - 1, points - 1).otherwise(inner)
    # times count from the series' start, so that they are exact as doubles
    long = placed.where(F.col("_n") > points).select(
        *key,
        (micros(ts) - F.col("_start")).alias("_x"),
        F.col(value).alias("_y"),
        bucket.cast("int").alias("_bucket"),
    )
    means = long.groupBy(*key, "_bucket").agg((F.sum("_x") / F.count("*")).alias("_next_x"), F.avg("_y").alias("_next_y"))
    following = means.withColumn("_bucket", F.col("_bucket") - 1)
    group, long = [*key, "_bucket"], long.select(*key, "_x", "_y", "_bucket")
    # once where the rows lie, once more with the survivors of a bucket side by side
    corners = (
        long.mapInPandas(_corners(group), long.schema)
        .repartition(*group)
        .sortWithinPartitions(*group)
        .mapInPandas(_corners(group), long.schema)
    )
    corners = _written(corners.join(following, group, "left"), "corners")
    counted = corners.groupBy(*group).agg(F.count("*").alias("_corners"))
    order = Window.partitionBy(*key).orderBy("_bucket")
    before = F.coalesce(F.sum("_corners").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = counted.withColumn("_cut", F.floor(before / F.lit(chunk))).withColumn("_segment", F.dense_rank().over(
        Window.partitionBy(*key).orderBy("_cut")
    ).cast("long") - 1)
    dealt = dealt.withColumn("_feeds", F.lead("_segment").over(order)).select(*group, "_segment", "_feeds")
    tagged = corners.join(dealt, group)
    own = tagged.withColumn("_role", F.lit(1)).drop("_feeds")
    entering = tagged.where(F.col("_feeds") != F.col("_segment")).withColumn("_segment", F.col("_feeds")).withColumn("_role", F.lit(0))
    entering = entering.drop("_feeds")
    segments = (dealt.agg(F.max("_segment").alias("n")).first().n or 0) + 1
    if segments > 1:
        kind = own.select(*key, "_segment", F.col("_x").alias("_entry"), F.col("_x").alias("_exit")).schema
        maps = _written(own.unionByName(entering).groupBy(*key, "_segment").applyInPandas(_mapped(key), kind), "maps")
        entries = _entries(maps, key, segments).select(*key, "_segment", F.col("_entry").alias("_x"))
        own = own.unionByName(entering.join(entries, [*key, "_segment", "_x"], "left_semi"))
    chosen = own.groupBy(*key, "_segment").applyInPandas(_walk(key), long.select(*key, "_x", "_y").schema)
    chosen = chosen.join(sizes, key).select(
        *key, F.timestamp_micros(F.col("_start") + F.col("_x")).alias(ts), F.col("_y").alias(value)
    )
    return chosen.unionByName(short)

"""Near duplicates by SimHash fingerprints, searched with pigeonring chains.

A fingerprint is cut into ``max_distance + 1`` segments on a ring. By the pigeonring principle two fingerprints within
the distance have a start from which the differences of the first ``l`` segments never exceed ``l * d / m``: none in the
first segment, at most one in the first two, and so on. The first segment is therefore a key, and of the second one at
least one half is intact, which makes ten keys of about 20 bits per fingerprint for distance 4. Members of a key are
compared along the whole chain; its last step is the full Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsig.llm.components import connected_components
from fleetsig.llm.shared import batch, materialise, width

SEED = 42
BLOCK = 4096
_PIECE = 1 << 16


def fingerprint(text: str | None, shingle: int) -> int:
    """64-bit SimHash of the word shingles of a text, 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _PIECE):
        upto = min(n, at + _PIECE)
        starts, stops = ends[at:upto], ends[at + min(shingle, len(words)) : upto + min(shingle, len(words))]
        hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, stops)], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row ``(key, fp)`` per row of ``docs``; null and empty texts have fingerprint 0, other columns are ignored."""
    picked = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = picked.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in part.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], ["key", "fp"])

    return picked.mapInArrow(run, f"key {kind}, fp long")


def _segments(distance: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    parts = distance + 1
    edges = [round(i * 64 / parts) for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _bits(low: int, size: int) -> Column:
    return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << size) - 1))


def _keys(distance: int) -> Column:
    keys, ring = [], _segments(distance)
    for i, (low, size) in enumerate(ring):
        at, span = ring[(i + 1) % len(ring)]
        half = span // 2
        for side, (a, b) in enumerate(((at, half), (at + half, span - half))):
            mixed = F.xxhash64(F.lit(side), _bits(low, size), _bits(a, b)).bitwiseAND(F.lit((1 << 57) - 1))
            keys.append(F.lit(i << 57).bitwiseOR(mixed))  # the start stays readable; a clash only adds a comparison
    return F.array(*keys)


def _masks(distance: int, start: int) -> np.ndarray:
    ring = _segments(distance)
    turned = ring[start:] + ring[:start]
    return np.array([((1 << size) - 1) << low for low, size in turned], np.uint64)


def _within(diff: np.ndarray, masks: np.ndarray, distance: int) -> np.ndarray:
    """Positions whose chain of segment differences stays within budget to the end."""
    kept, spent = np.arange(len(diff)), np.zeros(len(diff), np.int64)
    for length, mask in enumerate(masks, 1):
        spent = spent + np.bitwise_count(diff[kept] & mask)
        ok = spent * len(masks) <= length * distance
        kept, spent = kept[ok], spent[ok]
        if not len(kept):
            break
    return kept


def _forest(members: np.ndarray, masks: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among the members; each member is left as soon as it is reached."""
    left, edges = members, []
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            pivot = frontier.pop()
            near = _within(left ^ pivot, masks, distance)
            if len(near):
                found = left[near]
                edges.extend((int(pivot), int(x)) for x in found)
                frontier.extend(found)
                left = np.delete(left, near)
    return edges


_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _edges(pairs: list) -> pa.RecordBatch:
    both = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
    return batch(_EDGE, both[:, 0], both[:, 1])


def _sweep(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (key, a, b); the members of a key follow each other."""
        held = None
        masks = [_masks(distance, i) for i in range(distance + 1)]

        def solve(rows: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)])
            size = np.diff(np.r_[new, len(rows)])
            start = (rows[new, 0] >> 57).astype(int)
            pairs = []
            for i in range(distance + 1):
                first = new[(size == 2) & (start == i)]
                hit = first[_within(fps[first] ^ fps[first + 1], masks[i], distance)]
                pairs.extend(zip(fps[hit], fps[hit + 1]))
            for at, n, i in zip(new[size > 2], size[size > 2], start[size > 2]):
                pairs.extend(_forest(fps[at : at + n], masks[i], distance))
            if pairs:
                yield _edges(pairs)

        for part in batches:
            rows = np.stack([part.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
            fps = part.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
            if held:
                rows, fps = np.concatenate([held[0], rows]), np.concatenate([held[1], fps])
            if not len(rows):
                continue
            last = len(rows) - np.argmax((rows != rows[-1]).any(axis=1)[::-1]) if (rows != rows[-1]).any() else 0
            held = rows[last:].copy(), fps[last:].copy()
            if last:
                yield from solve(rows[:last], fps[:last])
        if held:
            yield from solve(*held)

    return run


def links(distinct: DataFrame, max_distance: int = 4, block: int = BLOCK) -> DataFrame:
    """Edges ``(u, v)`` that connect every two fingerprints within the distance, directly or through others.

    ``distinct`` has one row per fingerprint ``fp``. A key with more than ``block`` members is cut into blocks, and each
    pair of blocks is a group of its own, so no task holds more than two blocks and no member of a key is left out.
    A group gives a spanning forest of its links, not all its pairs.
    """
    keyed = distinct.select(F.explode(_keys(max_distance)).alias("bucket"), "fp")
    large = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > block)
    large = materialise(large.select("bucket", F.ceil(F.col("n") / block).cast("int").alias("cuts")), "large")
    own = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    dealt = (
        keyed.join(large, "bucket", "left")
        .withColumn("cuts", F.coalesce("cuts", F.lit(1)))
        .select("bucket", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other"))
        .select("bucket", F.least("own", "other").cast("long").alias("a"), F.greatest("own", "other").cast("long").alias("b"), "fp")
        .repartition(width(distinct.sparkSession), "bucket", "a", "b")
        .sortWithinPartitions("bucket", "a", "b", "fp")
    )
    return dealt.mapInArrow(_sweep(max_distance), "u long, v long")


def near_duplicates(
    docs: DataFrame, shingle: int = 4, max_distance: int = 4, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(key, fp, component)`` per row of ``docs``: its fingerprint and the smallest key linked to it, itself included.

    Two rows are linked if their fingerprints differ in at most ``max_distance`` (1 to 15) bits; links chain. Equal
    fingerprints are one class from the start, so copies never meet each other. Null and empty texts share fingerprint
    0 and are linked like any others; rows with a null key get the smallest other key, or null if there is none;
    repeated rows are kept; an empty table gives no rows.
    """
    if not 1 <= max_distance <= 15:
        raise ValueError("max_distance must be 1 to 15")
    fps = materialise(fingerprints(docs, shingle, key, text), "fingerprints")
    classes = materialise(fps.groupBy("fp").agg(F.min("key").alias("first")), "classes")
    found = connected_components(links(classes.select("fp"), max_distance))
    rooted = classes.join(found, classes.fp == found.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    return fps.join(rooted.join(least, "root").select("fp", "component"), "fp").select("key", "fp", "component")

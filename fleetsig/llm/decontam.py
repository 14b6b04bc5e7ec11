"""Benchmark passages in training text: rare n-gram seeds, then Smith-Waterman alignment.

Test items come in blocks of bounded size, so their seeds fit in every task and the training text is never shuffled. Of an
item's word n-grams those that fewer documents hold are its seeds, ranked within the item: an item that was copied a
million times still has them. Around seed hits the item is aligned with the text, which finds edited copies too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NGRAM = 3
RARE = 0.5
MIN_SCORE = 0.5
BLOCK_CHARS = 4_000_000
_MATCH, _MISMATCH, _GAP = 2, -1, -1
_WORD = re.compile(r"\w+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


@dataclass
class Block:
    """A bounded part of the benchmark: item ids, their words as numbers, and the seeds with where they occur."""

    ids: list
    words: list[np.ndarray]
    vocabulary: dict[str, int]
    seeds: np.ndarray
    places: list[list[tuple[int, int]]]


def _numbers(text: str, vocabulary: dict[str, int]) -> np.ndarray:
    """Words of a text as numbers of the vocabulary, 0 for others."""
    return np.array([vocabulary.get(w, 0) for w in _WORD.findall(text.lower())], np.int64)


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words; 0 where one is unknown."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    span = len(words) - n + 1
    mixed, known = np.zeros(span, np.uint64), np.ones(span, bool)
    for j in range(n):
        part = words[j : j + span]
        mixed = (mixed ^ (part.astype(np.uint64) + np.uint64(j + 1))) * _MIX[j % len(_MIX)]
        mixed ^= mixed >> np.uint64(29)
        known &= part > 0
    return np.where(known, mixed | np.uint64(1), np.uint64(0))


def _prepare(items: list[tuple], n: int) -> tuple[Block, dict[int, list]]:
    """A block without seeds chosen yet: every n-gram of its items (whole items, if shorter), by length."""
    vocabulary, words = {}, []
    for _, text in items:
        found = _WORD.findall(text.lower())
        for w in found:
            vocabulary.setdefault(w, len(vocabulary) + 1)
        words.append(np.array([vocabulary[w] for w in found], np.int64))
    places: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, w in enumerate(words):
        size = min(n, len(w))
        for at, gram in enumerate(_grams(w, size) if size else ()):
            places.setdefault((size, int(gram)), []).append((i, at))
    return Block([k for k, _ in items], words, vocabulary, np.zeros(0), []), places


def _hits(words: np.ndarray, seeds: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, position in the text, number of the seed)"""
    for size, known in seeds.items():
        grams = _grams(words, size)
        if len(grams) and len(known):
            spot = np.searchsorted(known, grams)
            spot[spot == len(known)] = 0
            at = np.flatnonzero((known[spot] == grams) & (grams > 0))
            yield size, at, spot[at]


def _frequencies(docs: DataFrame, text: str, block: Block, seeds: dict[int, np.ndarray]) -> dict[tuple[int, int], int]:
    """Documents that hold each n-gram of the block; counts leave a task as one row per n-gram."""
    first = dict(zip(seeds, np.cumsum([0, *map(len, seeds.values())])))
    total = sum(map(len, seeds.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(total, np.int64)
        for part in batches:
            for t in part.column(0):
                if t.as_py():
                    for size, _, which in _hits(_numbers(t.as_py(), block.vocabulary), seeds):
                        counts[first[size] + np.unique(which)] += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["gram", "n"])

    rows = docs.select(text).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    names = [(size, int(g)) for size, known in seeds.items() for g in known]
    return {names[r.gram]: r.n for r in rows}


def _choose(docs: DataFrame, text: str, items: list[tuple], n: int, rare: float) -> Block:
    block, places = _prepare(items, n)
    sizes = sorted({size for size, _ in places})
    every = {s: np.array(sorted(g for size, g in places if size == s), np.uint64) for s in sizes}
    df = _frequencies(docs, text, block, every)
    own: list[list] = [[] for _ in items]
    for gram, where in places.items():
        for i in {i for i, _ in where}:
            own[i].append((df.get(gram, 0), gram))
    chosen = set()
    for grams in own:
        grams.sort()
        if grams:
            limit = grams[int(np.ceil(rare * len(grams))) - 1][0]  # ties stay in
            chosen.update(g for count, g in grams if count <= limit)
    block.seeds = {s: np.array(sorted(g for size, g in chosen if size == s), np.uint64) for s in sizes}
    block.places = {s: [places[s, int(g)] for g in known] for s, known in block.seeds.items()}
    return block


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score of two word sequences and the first end of such an alignment in ``words``."""
    row, best, end = np.zeros(len(words) + 1, np.int64), 0, 0
    slope = np.arange(len(words) + 1) * _GAP
    for w in item:
        step = np.where(words == w, _MATCH, _MISMATCH)
        new = np.zeros_like(row)
        new[1:] = np.maximum(np.maximum(row[:-1] + step, row[1:] + _GAP), 0)
        row = np.maximum.accumulate(new - slope) + slope  # gaps in the item
        top = int(row.argmax())
        if (row[top], -top) > (best, -end):
            best, end = int(row[top]), top
    return best, end


def matches(text: str | None, block: Block, min_score: float) -> list[tuple[int, float, int, int]]:
    """(item, score, first word, word after the last) of the best alignment of each item that reaches the score."""
    if not text:
        return []
    words = _numbers(text, block.vocabulary)
    near: dict[int, list[int]] = {}
    for size, at, which in _hits(words, block.seeds):
        for p, s in zip(at.tolist(), which.tolist()):
            for item, q in block.places[size][s]:
                near.setdefault(item, []).append(p - q)
    found = []
    for item, diagonals in near.items():
        own = block.words[item]
        size, perfect = len(own), _MATCH * len(own)
        best = (0, 0, 0)
        diagonals = sorted(set(diagonals))
        cuts = np.flatnonzero(np.diff(diagonals) > size) + 1
        for group in np.split(np.array(diagonals), cuts):
            low, high = max(0, int(group[0]) - size), min(len(words), int(group[-1]) + 2 * size)
            for at in range(low, high, 6 * size):  # long runs in pieces that overlap by more than an alignment
                piece = words[at : min(high, at + 9 * size)]
                score, end = align(own, piece)
                if score > best[0]:
                    best = score, at, end
        if best[0] >= min_score * perfect:
            score, at, end = best
            back = words[at : at + end][::-1]
            length = align(own[::-1], back)[1]
            found.append((item, score / perfect, at + end - length, at + end))
    return found


def blocks(
    docs: DataFrame, items: DataFrame, ngram: int = NGRAM, rare: float = RARE, key: str = "item_id", item_text: str = "text",
    text: str = "text", block_chars: int = BLOCK_CHARS,
) -> Iterator[Block]:
    """The benchmark in blocks of at most ``block_chars`` characters (or one item), read one after the other."""
    held, size = [], 0
    for row in items.select(F.col(key).alias("key"), F.col(item_text).alias("text")).toLocalIterator():
        if row.text and _WORD.search(row.text):
            if held and size + len(row.text) > block_chars:
                yield _choose(docs, text, held, ngram, rare)
                held, size = [], 0
            held.append((row.key, row.text))
            size += len(row.text)
    if held:
        yield _choose(docs, text, held, ngram, rare)


def find_leaks(
    docs: DataFrame, items: DataFrame, min_score: float = MIN_SCORE, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text", **seeding,
) -> DataFrame:
    """``(doc, item, score, start, end)``: documents that hold a copy of a test item, whole or edited.

    The score is the best local alignment of the item's words (match 2, mismatch and gap -1; case and punctuation are
    ignored) over that of an exact copy; pairs below ``min_score`` are left out. ``start`` and ``end`` count words of the
    document. Null or wordless texts and items match nothing; repeated rows on either side give repeated pairs; null ids
    are carried along; empty tables give no rows. Items shorter than an n-gram are seeded as a whole.
    """
    picked = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    kind = "doc long, item long, score double, start long, end long"
    out = docs.sparkSession.createDataFrame([], kind)
    for block in blocks(docs, items, key=item_key, item_text=item_text, text=text, **seeding):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for part in batches:
                rows = [
                    (d, block.ids[i], score, a, b)
                    for d, t in zip(part.column(0).to_pylist(), part.column(1))
                    for i, score, a, b in matches(t.as_py(), block, min_score)
                ]
                columns = zip(*rows) if rows else [[]] * 5
                types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                names = ["doc", "item", "score", "start", "end"]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

        out = out.unionAll(picked.mapInArrow(run, kind))
    return out


def leaked(block: Block, min_score: float = MIN_SCORE):
    """Pandas function: does a text hold an item of the block?"""

    @F.pandas_udf("boolean")
    def hit(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: bool(matches(t, block, min_score))).astype(bool)

    return hit


def without_leaks(docs: DataFrame, items: DataFrame, min_score: float = MIN_SCORE, text: str = "text", **seeding) -> DataFrame:
    """Rows of ``docs`` that hold no item, with all their columns."""
    clean: DataFrame = docs
    for block in blocks(docs, items, text=text, **seeding):
        said: Column = leaked(block, min_score)(F.col(text))
        clean = clean.where(~said)
    return clean

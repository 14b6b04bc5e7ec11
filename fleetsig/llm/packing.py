"""Packing token streams into windows by Karmarkar-Karp multiway differencing.

A text longer than a window fills whole ones; what is left of each text is a piece. Pieces are dealt at random into groups of
about ``WINDOWS`` windows, and each group is split by differencing: every piece is a partition with one window filled, and the
two partitions with the largest difference between their fullest and emptiest window are merged, the fullest window of one
with the emptiest of the other, until one is left. Its windows are nearly equal. Where one exceeds the capacity, the count of
windows rises.

Differencing is only as even as its smallest pieces allow, so about a twentieth of the tokens is cut into short pieces
(``GRAINS``) beforehand; with whole texts alone a twentieth of the windows would be padding.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import cycle, islice
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsig.llm.shared import materialise, spread

WINDOWS = 128
GRAINS = (32, 128, 16, 32, 64, 8, 32, 16, 64, 32, 8)  # 432 tokens for four windows
GRAIN_SHARE = 108 / 2048
BUNDLE = 32  # shorter texts are bundled up to this, which bounds the partitions of a group
_BYTES = 1 << 20
_KNOWN = 600_000  # words whose ids a Python worker remembers
# runs of marks between letters, digits and spaces; neither apostrophes nor the marks of special tokens (what stands before is
# looked at after the first mark, as a pattern that begins with a set of characters is searched faster)
_MARK = r"[.,;:!?\"()\[\]{}*&$%#@~^=+/-]"
_MARKS = re.compile(rf"{_MARK}(?<![^\w\s].)(?<!_.){_MARK}*(?![^\w\s]|_)", re.DOTALL)
_NO_SPACE = re.compile("[\x1c-\x1f]")  # str.split cuts at these, the tokenizer does not


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _ids(found) -> bytes:
    return np.array(found.ids, "<u4").tobytes()


def _grown(store: np.ndarray, n: int, more: np.ndarray) -> np.ndarray:
    """``store``, of which ``n`` are in use, with ``more`` after them."""
    if n + len(more) > len(store):
        store = np.concatenate([store[:n], np.zeros(n + 2 * len(more), store.dtype)])
    store[n : n + len(more)] = more
    return store


class Encoder:
    """Ids of texts as little-endian bytes; with ``by_word`` each word between white space is encoded once."""

    def __init__(self, path: str, by_word: bool):
        self.tokenizer, self.by_word = _tokenizer(path), by_word
        vocabulary = self.tokenizer.get_vocab() if by_word else {}
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: defaultdict[str, int] = defaultdict()  # numbers of the words, in order of appearance
        self.known.default_factory = self.known.__len__
        self.ids, self.stops, self.learned = np.zeros(0, "<u4"), np.zeros(1, np.int64), 0

    def direct(self, texts: list[str]) -> list[bytes]:
        return [_ids(x) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words_of_letters(self, words: list[str]) -> list[bytes]:
        """Words of letters only, encoded as lines of many; the last id of each word is marked as its end."""
        lines, out = [words[at : at + 500] for at in range(0, len(words), 500)], []
        for some, found in zip(lines, self.direct([" ".join(x) for x in lines])):
            stops = np.flatnonzero(self.ends[np.frombuffer(found, "<u4")]) + 1
            if len(stops) == len(some) and 4 * stops[-1] == len(found):
                edges = [0, *(4 * stops).tolist()]
                out += [found[a:b] for a, b in zip(edges, edges[1:])]
            else:
                out += self.direct(some)
        return out

    def _learn(self) -> None:
        """Ids of the words that have a number but no ids yet."""
        new = list(islice(reversed(self.known), len(self.known) - self.learned))[::-1]
        if not new:
            return
        letters = [w.isalpha() for w in new]
        plain = iter(self._words_of_letters([w for w, ok in zip(new, letters) if ok]))
        rest = iter(self.direct([w for w, ok in zip(new, letters) if not ok]))
        found = [next(plain if ok else rest) for ok in letters]
        used, sizes = self.stops[self.learned], np.array([len(x) // 4 for x in found], np.int64)
        self.ids = _grown(self.ids, used, np.frombuffer(b"".join(found), "<u4"))
        self.stops = _grown(self.stops, self.learned + 1, used + np.cumsum(sizes))
        self.learned += len(new)

    def _words(self, text: str) -> list[str] | None:
        """Parts whose ids make up those of the text: words, and runs of marks that stand alone beside them."""
        if _NO_SPACE.search(text):
            return None
        # special tokens are matched before case is folded, a final sigma is folded letter by letter, and folding or
        # composing may turn a letter into more than one sign
        folded = text.lower()
        if "<|" in text or "Σ" in text or not is_normalized("NFC", text) or not is_normalized("NFC", folded):
            return text.split()
        return _MARKS.sub(r" \g<0> ", folded).split()

    def _numbers(self, text: str) -> np.ndarray | None:
        """Numbers of the parts of a text; new ones are given out."""
        parts = self._words(text)
        return None if parts is None else np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        if not self.by_word:
            yield from self.direct(texts)
            return
        if len(self.known) > _KNOWN or len(self.known) != self.learned:  # the latter after a failure
            self._forget()
        numbers = [self._numbers(t) for t in texts]
        self._learn()
        word = np.concatenate([np.zeros(0, np.int64), *(x for x in numbers if x is not None)])
        start = self.stops[word]
        size = self.stops[word + 1] - start
        ids = self.ids[spread(start, size)].tobytes()
        ends = 4 * np.append(0, np.cumsum(size))[np.cumsum([0, *(0 if x is None else len(x) for x in numbers)])]
        for text, own, a, b in zip(texts, numbers, ends[:-1].tolist(), ends[1:].tolist()):
            yield ids[a:b] if own is not None else self.direct([text])[0]


@lru_cache(maxsize=2)
def _encoder(path: str, by_word: bool) -> Encoder:
    """One for all tasks of a Python worker, as most words of a task were met in those before."""
    return Encoder(path, by_word)


def _token_ids(texts: pa.Array, encoder: Encoder) -> Iterator[np.ndarray]:
    """Token ids of each text, about a megabyte of text at a time; nulls are empty."""
    held, size = [], 0
    for i, text in enumerate(texts):
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size > _BYTES or i == len(texts) - 1:
            for found in encoder.encode(held):
                yield np.frombuffer(found, "<u4")
            held, size = [], 0


def _cut(start: int, stop: int, sizes: Iterator[int]) -> Iterator[tuple[int, int]]:
    while start < stop:
        end = min(stop, start + next(sizes))
        yield start, end
        start = end


def pieces_of(lengths: Iterator[int], capacity: int) -> Iterator[list[tuple[int, int]]]:
    """Cuts of each stream: whole windows, then the rest, which is cut fine whenever grains lag behind their share."""
    rest = fine = 0
    for n in lengths:
        whole = n - n % capacity
        cuts = list(_cut(0, whole, cycle([capacity])))
        rest += n - whole
        if fine < GRAIN_SHARE * rest and n > whole:
            fine += n - whole
            cuts += _cut(whole, n, cycle([min(g, capacity) for g in GRAINS]))
        elif n > whole:
            cuts.append((whole, n))
        yield cuts


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """Window (of ``k``) of each size, by Karmarkar-Karp differencing."""
    heap, children = [], []
    for at, i in enumerate(np.argsort(-sizes, kind="stable")):
        sums, nodes = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        sums[0], nodes[0] = sizes[i], i
        heap.append((-int(sizes[i]), at, sums, nodes))
    nodes_used = ticks = len(sizes)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        a, y = a + b[::-1], y[::-1]
        merged, both = np.where(x >= 0, x, y), (x >= 0) & (y >= 0)
        children.append(np.stack([x[both], y[both]], axis=1))
        merged[both] = nodes_used + np.arange(len(children[-1]))
        nodes_used += len(children[-1])
        order = np.argsort(-a, kind="stable")
        a = a[order] - a[order[-1]]
        heapq.heappush(heap, (-int(a[0]), ticks, a, merged[order]))
        ticks += 1
    window = np.zeros(nodes_used, np.int64)
    if heap:
        last = heap[0][3]
        window[last[last >= 0]] = np.flatnonzero(last >= 0)
    below = np.concatenate(children) if children else np.zeros((0, 2), np.int64)
    for node in range(len(below) - 1, -1, -1):
        window[below[node]] = window[len(sizes) + node]
    return window[: len(sizes)]


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each size; the count of windows starts at the least possible and rises until none exceeds the capacity.

    It rises by 1, 2, 4, ... and then halves the last step, so that sizes that fit badly take few trials. With a window
    for each size all fit.
    """
    least = max(1, -(-int(sizes.sum()) // capacity))

    def fitted(k: int) -> np.ndarray | None:
        found = difference(sizes, k)
        return found if np.bincount(found, sizes).max(initial=0) <= capacity else None

    low, step, best = least - 1, 0, None
    while best is None:
        k = min(least + step, max(least, len(sizes)))
        best = fitted(k)
        low, high, step = (low, k, step) if best is not None else (k, k, 2 * step + 1)
    while high - low > 1:
        middle = (low + high) // 2
        found = fitted(middle)
        low, high, best = (low, middle, found) if found is not None else (middle, high, best)
    return best


def _bundles(sizes: np.ndarray) -> np.ndarray:
    """Number of the bundle of each size: short ones together until they reach ``BUNDLE``, others alone."""
    bundle, out, open_, filled, last = np.zeros(len(sizes), np.int64), 0, -1, 0, 0
    for i, n in enumerate(sizes):
        if n >= BUNDLE:
            bundle[i], last = last, last + 1
            continue
        if open_ < 0 or filled + n > BUNDLE:
            open_, filled, last = last, 0, last + 1
        bundle[i], filled = open_, filled + n
    return bundle


def placed(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of each size."""
    if not len(sizes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bundle = _bundles(sizes) if capacity >= BUNDLE else np.arange(len(sizes))
    window = windows(np.bincount(bundle, sizes).astype(np.int64), capacity)[bundle]
    order = np.argsort(window, kind="stable")
    ends = np.cumsum(sizes[order])
    first = np.searchsorted(window[order], window[order])
    offset = np.empty(len(sizes), np.int64)
    offset[order] = ends - sizes[order] - (ends[first] - sizes[order][first])
    return window, offset


def pack(
    docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, by_word: bool = True, end_id: int = 1,
    with_ids: bool = False, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``(key, start, length, ids_crc32, doc_tokens, sequence, offset)`` of every piece of every text.

    A text's tokens are its ids under ``tokenizer`` (a file of the tokenizers library; the public word-piece file by
    default) and ``end_id``. Each token lies in exactly one piece, each piece in one sequence of at most ``capacity``
    tokens, whose pieces follow each other without a gap from offset 0. The CRC-32 is over the piece's ids as little-endian
    unsigned 32-bit numbers; ``with_ids`` adds the ids themselves. ``by_word`` encodes each word between white space once and
    remembers its ids, which is right for tokenizers that drop white space, fold ASCII case, part letters from marks and end
    words by ``</w>``, as the default one does; pass False for others. Null and empty texts are one token; rows with a null or
    repeated key are packed as rows of their own; an empty table gives no rows; other columns are ignored. Which
    pieces share a sequence depends on how the table is split into tasks.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    picked = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = f"key {picked.schema['key'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long"
    names = ["key", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, by_word)
        for part in batches:
            # lengths and ids go side by side: a text's cuts depend on the lengths before it only
            ahead: list[np.ndarray] = []

            def lengths(part=part, ahead=ahead):
                for ids in _token_ids(part.column(1), encoder):
                    ahead.append(np.append(ids, np.uint32(end_id)))
                    yield len(ahead[-1])

            rows, own, held = [], [], 0
            for i, cuts in enumerate(pieces_of(lengths(), capacity)):
                ids = ahead.pop()
                rows += [(a, b - a, zlib.crc32(ids[a:b].tobytes()), len(ids), *([ids[a:b]] if with_ids else [])) for a, b in cuts]
                own += [i] * len(cuts)
                held += len(ids)
                if held > _BYTES or i == len(part) - 1:
                    columns = [pa.array(c) for c in zip(*rows)]
                    columns[4:] = [pa.array([x[4] for x in rows], pa.list_(pa.int64()))] if with_ids else []
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own)), *columns], names)
                    rows, own, held = [], [], 0

    kind += ", ids array<long>" if with_ids else ""
    pieces = picked.mapInArrow(tokenise, kind).withColumn("row", F.monotonically_increasing_id())
    pieces = materialise(pieces, "pieces")
    rest = pieces.where(F.col("length") < capacity)
    total = rest.agg(F.sum("length").alias("n")).first().n or 0
    groups = max(1, -(-total // (WINDOWS * capacity)))

    def place(group: pa.Table) -> pa.Table:
        window, offset = placed(group.column("length").to_numpy(), capacity)
        sequence = 2 * ((group.column("group")[0].as_py() << 20) + window)
        return group.select(names).append_column("sequence", pa.array(sequence)).append_column("offset", pa.array(offset))

    dealt = rest.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    packed = dealt.groupBy("group").applyInArrow(place, f"{kind}, sequence long, offset long")
    whole = pieces.where(F.col("length") == capacity).select(
        *names, (2 * F.col("row") + 1).alias("sequence"), F.lit(0).cast("long").alias("offset")
    )
    return packed.unionAll(whole)

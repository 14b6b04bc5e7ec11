"""Removal of repeated passages: longest previous factors in suffix order, within buckets of suffixes.

A passage counts if a string of ``length`` bytes also starts in a document with a smaller id. Sorting all suffixes of a corpus
in one order would move every byte many times, so suffixes are first sorted apart by what they begin with: each window of
``length`` bytes belongs to the smallest hash among its K-byte pieces, which equal windows share. A run of windows with one
such hash is a strand of text. Three passes over documents in blocks, all from one shuffle of the text:

1. hashes that only one document has are dropped: nothing there repeats;
2. the strands of the others meet by hash. Equal strands repeat as a whole after the first document. Where strands differ,
   their windows are put into suffix order; a window's longest previous factor reaches ``length`` exactly if, among its
   equals next to it in that order, one comes from a smaller id (the previous or next smaller position of the array);
3. each block learns which windows of its strands are repeats and joins them into removed spans.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsig.llm.blocks import as_bytes, block_of, count_blocks
from fleetsig.llm.shared import materialise, spread, width

LENGTH = 50
_PIECE = 24
_STRAND = 32  # windows of a strand at most, one bit each
_NO_ID = -(1 << 63)
_rng = np.random.default_rng(11)
_ODD = _rng.integers(0, 1 << 63, 40, np.uint64) * np.uint64(2) + np.uint64(1)
_MOST = 1 << 15  # windows at a time, so that their arrays stay in the processor's cache


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position of a text on."""
    return np.ndarray(len(data) - 7, "<u8", data, strides=(1,))


def _piece_hashes(data: np.ndarray) -> np.ndarray:
    """48-bit hash of every K-byte piece, from the eight-byte words it consists of."""
    w = _words(data) * _ODD[0]
    w ^= w >> np.uint64(32)
    n = len(data) - _PIECE + 1
    h = w[:n] * _ODD[1]
    for i in range(8, _PIECE, 8):
        h += w[i : i + n] * _ODD[1 + i // 8]
    h ^= h >> np.uint64(29)
    h *= _ODD[7]
    h ^= h >> np.uint64(32)
    h >>= np.uint64(16)
    return h


def _smallest(h: np.ndarray, span: int) -> np.ndarray:
    """Minimum over every ``span`` neighbours."""
    size = 1
    while 2 * size <= span:
        h = np.minimum(h[: len(h) - size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (span - size)], h[span - size :]) if span > size else h


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, and their edges."""
    edges = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], dtype=np.int64, out=edges[1:])
    return np.concatenate([np.zeros(0, np.uint8), *texts]), edges


def strands(flat: np.ndarray, edges: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, first window, number of windows) of each strand of joined texts; windows count through all of them."""
    n = len(flat) - length + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    # a text's windows begin at its first byte and stop before those that would reach over its end
    borders = np.unique(np.minimum(np.r_[edges[:-1], np.maximum(edges[1:] - length + 1, edges[:-1])], n))
    hashes, starts, last = [], [], None
    for at in range(0, n, _MOST):
        upto = min(n, at + _MOST)
        low = _smallest(_piece_hashes(flat[at : upto + length - 1]), length - _PIECE + 1)
        new = np.empty(len(low), bool)
        new[0] = low[0] != last
        np.not_equal(low[1:], low[:-1], out=new[1:])
        a, b = np.searchsorted(borders, [at, upto])
        new[borders[a:b] - at] = True
        place = np.flatnonzero(new)
        hashes.append(low[place])
        starts.append(at + place)
        last = low[-1]
    low, new = np.concatenate(hashes), np.concatenate(starts)
    size = np.diff(new, append=n)
    which = np.searchsorted(edges, new, side="right") - 1
    inside = new + length <= edges[which + 1]
    low, new, size, which = low[inside], new[inside], size[inside], which[inside]
    cuts = -(-size // _STRAND)
    part = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    first = np.repeat(new, cuts) + part * _STRAND
    return np.repeat(which, cuts), np.repeat(low, cuts), first, np.minimum(np.repeat(size, cuts) - part * _STRAND, _STRAND)


def _word_at(words: np.ndarray, start: np.ndarray, size: np.ndarray, at: int) -> np.ndarray:
    """Eight bytes of each strand from ``at`` on, or its last eight."""
    return words[start + np.minimum(at, size - 8)]


def _prints(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit fingerprint of each strand's text; its last word counts again until the longest strand ends."""
    words, out, most = _words(flat), np.empty(len(start), np.uint64), int(size.max())
    for a in range(0, len(start), _MOST):
        s, n = start[a : a + _MOST], size[a : a + _MOST]
        h = n.astype(np.uint64)
        for i, at in enumerate(range(0, most, 8)):
            w = _word_at(words, s, n, at)
            w ^= w >> np.uint64(32)
            h += w * _ODD[8 + i]
        h ^= h >> np.uint64(32)
        out[a : a + _MOST] = h * _ODD[7]
    return out


def _alike(flat: np.ndarray, start: np.ndarray, size: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strands in the order of (hash, fingerprint), and where in it the text differs from the one before.

    Equal texts are neighbours, as texts are compared byte by byte and those with one fingerprint are ordered by themselves.
    """
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    prints = _prints(flat, start, size)
    key = (hashes << np.uint64(16)) | (prints >> np.uint64(48))
    order = np.argsort(key)
    key, prints = key[order], prints[order]
    new = np.r_[True, key[1:] != key[:-1]]

    def resort(torn: np.ndarray, by) -> None:
        """Runs that hold a torn place are sorted again."""
        run = np.cumsum(new) - 1
        rows = np.flatnonzero(np.isin(run, run[torn]))
        order[rows] = order[rows][by(rows, run[rows])]

    torn = np.flatnonzero(~new[1:] & (prints[1:] != prints[:-1])) + 1
    if len(torn):
        resort(torn, lambda rows, run: np.lexsort((prints[rows], run)))
        prints = _prints(flat, start[order], size[order])
        new[1:] |= prints[1:] != prints[:-1]
    torn = _differ(flat, start, size, order, np.flatnonzero(~new))
    if len(torn):
        text = lambda i: flat[start[i] : start[i] + size[i]].tobytes()
        resort(torn, lambda rows, run: sorted(range(len(rows)), key=lambda j: (run[j], text(order[rows[j]]))))
        new[_differ(flat, start, size, order, np.flatnonzero(~new))] = True
    return order, new


def _differ(flat: np.ndarray, start: np.ndarray, size: np.ndarray, order: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which of the places of an order have another text than the place before."""
    words, found = _words(flat), []
    for a in range(0, len(places), _MOST):
        spot = places[a : a + _MOST]
        one, two = order[spot - 1], order[spot]
        n = size[two]
        other = size[one] != n
        n = np.minimum(size[one], n)
        for at in range(0, int(n.max()), 8):
            other |= _word_at(words, start[one], n, at) != _word_at(words, start[two], n, at)
        found.append(spot[other])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length, byte planes apart, compressed."""
    n = len(arrays[0])
    planes = [np.ascontiguousarray(a.reshape(n, -1).view(np.uint8).T).tobytes() if n else b"" for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(data: bytes, *kinds) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(sizes), 0, []
    for k, size in zip(kinds, sizes):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(k).reshape(n))
        at += n * size
    return out


_BLOB = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("data", pa.binary())])
_BLOB_SQL = "bucket int, block int, data binary"


def _blobs(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 3, _BLOB)], schema=_BLOB)


def _deal(hashes: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """Positions of each bucket; hashes are ascending and stay so."""
    bucket = (hashes % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    return [(int(bucket[p[0]]), p) for p in np.split(order, cuts) if len(p)]


def _seen(length: int, buckets: int):
    """Pass 1: the hashes of a block, each with whether several of its documents have it."""

    def run(docs: pa.Table) -> pa.Table:
        block, ids = docs.column("block")[0].as_py(), docs.column("doc").to_numpy()
        which, m, _, _ = strands(*_joined(as_bytes(docs.column("text"))), length)
        if not len(m):
            return _blobs([])
        order = np.argsort(m)
        m, who = m[order], ids[which[order]]
        first = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])
        several = np.minimum.reduceat(who, first) != np.maximum.reduceat(who, first)
        m = m[first]
        return _blobs([(b, block, _pack(np.diff(m[p], prepend=np.uint64(0)), several[p].astype(np.uint8))) for b, p in _deal(m, buckets)])

    return run


def _shared(blobs: pa.Table) -> pa.Table:
    """Of one bucket: for each block, which of its hashes occur in more than one document."""
    bucket, blocks = blobs.column("bucket")[0].as_py(), blobs.column("block").to_pylist()
    parts = [_unpack(d, np.uint64, np.uint8) for d in blobs.column("data").to_pylist()]
    held = [np.cumsum(delta, dtype=np.uint64) for delta, _ in parts]
    every = np.concatenate(held)
    order = np.argsort(every)
    same = every[order[1:]] == every[order[:-1]]
    twice = np.zeros(len(every), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    rows, cut = [], 0
    for block, m, (_, several) in zip(blocks, held, parts):
        cut, found = cut + len(m), m[(several > 0) | twice[cut : cut + len(m)]]
        if len(found):
            rows.append((bucket, block, _pack(np.diff(found, prepend=np.uint64(0)))))
    return _blobs(rows)


class _Strands:
    """The strands of a block under shared hashes: where they are, and the different ones in order of their hash.

    That order depends on the strands only, not on how the block's documents arrive.
    """

    def __init__(self, docs: pa.Table, shared: np.ndarray, length: int):
        self.ids = docs.column("doc").to_numpy()
        self.flat, self.edges = _joined(as_bytes(docs.column("text")))
        which, m, start, count = strands(self.flat, self.edges, length)
        order = np.argsort(m)  # sorted questions find their place faster
        shared = np.append(np.sort(shared), np.uint64(1 << 63))
        hit = np.zeros(len(m), bool)
        hit[order] = shared[np.searchsorted(shared, m[order])] == m[order]
        self.which, self.start, self.count, m = which[hit], start[hit], count[hit], m[hit]
        order, new = _alike(self.flat, self.start, self.count + length - 1, m)
        self.at = np.empty(len(m), np.int64)
        self.at[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        one = order[first]
        self.hash, self.begin, self.size = m[one], self.start[one], self.count[one] + length - 1
        self.least = np.minimum.reduceat(self.ids[self.which[order]], first) if len(first) else np.zeros(0, np.int64)


def _of_block(replies: pa.Table, kind: int) -> list[tuple[int, bytes]]:
    picked = [k == kind for k in replies.column("kind").to_pylist()]
    pairs = zip(replies.column("bucket").to_pylist(), replies.column("data").to_pylist(), picked)
    return sorted((b, d) for b, d, ok in pairs if ok)


def _hashes(replies: pa.Table) -> np.ndarray:
    found = [np.cumsum(_unpack(d, np.uint64)[0], dtype=np.uint64) for _, d in _of_block(replies, 1)]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _send(length: int, buckets: int):
    """Pass 2: the different strands of a block under shared hashes, with the smallest id that has them."""

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _blobs([])
        block, own = docs.column("block")[0].as_py(), _Strands(docs, _hashes(replies), length)
        rows = []
        for bucket, p in _deal(own.hash, buckets):
            head = _pack(np.diff(own.hash[p], prepend=np.uint64(0)), own.least[p], own.size[p].astype(np.uint8))
            body = zstandard.ZstdCompressor(level=1).compress(own.flat[spread(own.begin[p], own.size[p])].tobytes())
            rows.append((bucket, block, len(head).to_bytes(4, "big") + head + body))
        return _blobs(rows)

    return run


def _previous(flat: np.ndarray, start: np.ndarray, counts: np.ndarray, least: np.ndarray, length: int) -> np.ndarray:
    """Bits of the windows of each strand that have an equal window in a strand of a smaller id.

    The windows are put into suffix order eight bytes at a time, where only those still equal to a neighbour are sorted on. A
    window's previous smaller position with a common prefix of ``length`` is the one of the smallest id in its run, if that is
    smaller than its own.
    """
    begin, owner, words = spread(start, counts), np.repeat(np.arange(len(start)), counts), _words(flat)
    order, new = np.arange(len(begin)), np.arange(len(begin)) == 0
    for a in range(0, length, 8):
        rows = np.flatnonzero(~new | ~np.append(new[1:], True))
        word = words[begin[order[rows]] + min(a, length - 8)].byteswap()
        run = np.cumsum(new)[rows]
        by = np.lexsort((word, run)) if a else np.argsort(word)
        order[rows], word = order[rows][by], word[by]
        new[rows[1:]] |= word[1:] != word[:-1]
    first = np.flatnonzero(new)
    smallest = np.repeat(np.minimum.reduceat(least[owner[order]], first), np.diff(first, append=len(order)))
    hit = order[smallest < least[owner[order]]]
    bits = np.zeros(len(start), np.uint64)
    np.bitwise_or.at(bits, owner[hit], np.uint64(1) << (begin[hit] - start[owner[hit]]).astype(np.uint64))
    return bits


def _answer(length: int):
    """One bucket: for every strand of every block the smallest id that has it, and its repeated windows there."""

    def run(blobs: pa.Table) -> pa.Table:
        bucket, blocks = blobs.column("bucket")[0].as_py(), blobs.column("block").to_pylist()
        hashes, least, texts, sizes = [], [], [], []
        for data in blobs.column("data").to_pylist():
            cut = 4 + int.from_bytes(data[:4], "big")
            delta, doc, size = _unpack(data[4:cut], np.uint64, np.int64, np.uint8)
            texts.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(data[cut:]), np.uint8))
            hashes.append(np.cumsum(delta, dtype=np.uint64))
            least.append(doc)
            sizes.append(size.astype(np.int64))
        m, doc, size, flat = (np.concatenate(x) for x in (hashes, least, sizes, texts))
        start = np.cumsum(size) - size
        order, new = _alike(flat, start, size, m)
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        first, one = np.minimum.reduceat(doc[order], heads), order[heads]
        hash_of, bits = m[one], np.zeros(len(one), np.uint64)
        same = hash_of[1:] == hash_of[:-1]
        mixed = np.flatnonzero(np.append(False, same) | np.append(same, False))  # hashes with different strands
        if len(mixed):
            bits[mixed] = _previous(flat, start[one[mixed]], size[one[mixed]] - length + 1, first[mixed], length)
        rows, cut = [], 0
        for block, n in zip(blocks, map(len, sizes)):
            own = at[cut : cut + n]
            rows.append((bucket, block, _pack(first[own], bits[own])))
            cut += n
        return _blobs(rows)

    return run


def _runs(own: _Strands, first: np.ndarray, bits: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, stop) of the bytes under repeated windows; runs that touch within a text are one."""
    whole = own.ids[own.which] > first[own.at]
    some = np.flatnonzero(~whole & (bits[own.at] > 0))
    flags = np.unpackbits(bits[own.at[some]].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : _STRAND // 8], axis=1, bitorder="little")
    row, place = np.nonzero(flags)
    row = some[row]
    begin = np.r_[own.start[whole], own.start[row] + place]
    end = np.r_[(own.start + own.count)[whole], own.start[row] + place + 1] + length - 1
    which = np.r_[own.which[whole], own.which[row]]
    order = np.argsort(begin)
    begin, end, which = begin[order], end[order], which[order]
    new = np.flatnonzero(np.append(True, (begin[1:] > end[:-1]) | (which[1:] != which[:-1]))[: len(begin)])
    return which[new], begin[new], end[np.append(new[1:], len(end))[: len(new)] - 1]


def _spans(length: int, buckets: int):
    """Pass 3: removed spans of every document of a block."""

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        kind = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
        schema = pa.schema([("doc", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(kind)), ("kept", pa.binary())])
        if not docs.num_rows:
            return schema.empty_table()
        own = _Strands(docs, _hashes(replies), length)
        first, bits = np.zeros(len(own.hash), np.int64), np.zeros(len(own.hash), np.uint64)
        answers = dict(_of_block(replies, 2))
        for bucket, p in _deal(own.hash, buckets):
            first[p], bits[p] = _unpack(answers[bucket], np.int64, np.uint64)
        which, begin, end = _runs(own, first, bits, length)
        turn = np.zeros(len(own.flat) + 1, np.int8)
        turn[begin] = 1
        turn[end] -= 1  # a run may begin where the text before ends with one
        stays = np.cumsum(turn[:-1], dtype=np.int8) == 0
        text = np.arange(len(own.ids) + 1)
        lost = np.append(0, np.cumsum(end - begin))[np.searchsorted(which, text)]
        parts = [pa.array(x - own.edges[which], pa.int64()) for x in (begin, end)]
        spans = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(which, text), pa.int32()), pa.StructArray.from_arrays(parts, fields=list(kind))
        )
        offsets = pa.array(own.edges - lost, pa.int32())
        kept = pa.Array.from_buffers(pa.binary(), len(own.ids), [None, offsets.buffers()[1], pa.py_buffer(own.flat[stays])])
        return pa.table([docs.column("doc"), pa.array(np.diff(own.edges)), spans, kept], schema=schema)

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, n_bytes, spans, kept)`` per row of ``docs``: removed byte spans (start, stop) and the bytes that stay.

    A byte goes if a string of ``length`` bytes that covers it also starts in a row with a smaller id, judged on the input.
    Texts are UTF-8 bytes; null and empty texts have none. Repeats inside one document or between rows of one id stay; null
    ids count as one id smaller than any other, and come back null. Repeated rows and very long texts need nothing special.
    """
    if length < _PIECE + 1 or length + _STRAND > 256:
        raise ValueError(f"length must be {_PIECE + 1} to {256 - _STRAND}")
    n = count_blocks(docs, text, least=width(docs.sparkSession))
    named = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID)).alias("doc"), F.col(text).alias("text"))
    null = F.when(F.col("doc") != _NO_ID, F.col("doc"))
    dealt = named.select(block_of(null, F.col("text"), n).alias("block"), "doc", "text").repartition(n, "block")
    seen = dealt.groupBy("block").applyInArrow(_seen(length, n), _BLOB_SQL)
    shared = seen.groupBy("bucket").applyInArrow(_shared, _BLOB_SQL)
    shared = materialise(shared.withColumn("kind", F.lit(1)), "shared")
    sent = dealt.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_send(length, n), _BLOB_SQL)
    answers = sent.groupBy("bucket").applyInArrow(_answer(length), _BLOB_SQL).withColumn("kind", F.lit(2))
    answers = materialise(answers, "answers")
    found = dealt.groupBy("block").cogroup(shared.unionByName(answers).groupBy("block")).applyInArrow(
        _spans(length, n), "doc long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary"
    )
    return found.withColumn("doc", F.when(F.col("doc") != _NO_ID, F.col("doc")))

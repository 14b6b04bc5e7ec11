"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

One edit changes the letter counts of a word by an L1 distance of at most two: a replaced letter is one more here and one
fewer there, an inserted one only one more. For each pair of lengths a word searches the tree of the other length for the
boxes it can reach that way; the letters of what lies in them are then compared in order.

The words of a length are dealt into cells by a tree fitted on a bounded sample (``SAMPLE`` words); every word is routed
through it, and each cell builds a tree of its own over all its words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsig.llm.shared import materialise, width

RUN = re.compile("[A-Za-zÀ-ÿ]+")
SAMPLE = 65_536  # words the cells are fitted on
CELL_WORDS = 8192
CELL_LETTERS = 1 << 20  # letters of a cell, the most that a task holds of it
LEAF_WORDS = 64
_LETTERS = 90  # a-z, then U+00C0 to U+00FF
_HELD = 200_000
_VALUES = 1 << 22


def words_of(text: str | None, doc_id, spoil: int | None) -> Counter:
    """Occurrences of each run of letters with A-Z lower-cased.

    With ``spoil``, a run loses one letter where it divides the CRC-32 of ``<doc_id>:<run>``: that at the CRC modulo the
    length. A null id is the empty string there.
    """
    found = Counter(RUN.findall((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
    if not spoil:
        return found
    start, out = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), Counter()
    for run, n in found.items():
        h = zlib.crc32(run.encode(), start)
        if h % spoil == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def vocabulary(
    docs: DataFrame, least_letters: int = 5, least: int = 3, spoil: int | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(word, n)`` of the words with enough letters and occurrences in all texts; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for part in batches:
            for k, t in zip(part.column(0), part.column(1)):
                held.update(words_of(t.as_py(), k.as_py(), spoil))
                if len(held) > _HELD:
                    yield from _counted(held, least_letters)
                    held.clear()
        yield from _counted(held, least_letters)

    counted = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _counted(held: Counter, least_letters: int) -> Iterator[pa.RecordBatch]:
    kept = [(w, n) for w, n in held.items() if len(w) >= least_letters]
    for at in range(0, len(kept), 50_000):
        words, n = zip(*kept[at : at + 50_000])
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(n, pa.int64())], ["word", "n"])


def letters(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def counts(codes: np.ndarray) -> np.ndarray:
    """Letter-count vectors."""
    place = np.where(codes < 0xC0, codes - ord("a"), codes - (0xC0 - 26)).astype(np.int64)
    flat = np.arange(len(codes))[:, None] * _LETTERS + place
    return np.bincount(flat.ravel(), minlength=len(codes) * _LETTERS).reshape(-1, _LETTERS).astype(np.int32)


@dataclass
class KdTree:
    """Nodes ``(letter, threshold)``; at most the threshold goes left. Children are nodes, or leaves as ``-1 - leaf``."""

    nodes: list[tuple[int, int]] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)  # rows of the fitted vectors


def grow(x: np.ndarray, leaf: int) -> KdTree:
    """A tree whose leaves have at most ``leaf`` rows of ``x`` or rows that are all equal."""
    tree = KdTree()
    todo = [(np.arange(len(x)), -1, 0)]
    while todo:
        rows, parent, side = todo.pop()
        some, cut = x[rows], None
        if len(rows) > leaf:
            letter = int(some.var(axis=0).argmax())
            values, n = np.unique(some[:, letter], return_counts=True)
            if len(values) > 1:
                cut = letter, int(values[np.abs(2 * np.cumsum(n)[:-1] - len(rows)).argmin()])
        if cut is None:
            number = -1 - len(tree.leaves)
            tree.leaves.append(rows)
        else:
            number = len(tree.nodes)
            tree.nodes.append(cut)
            tree.children.append([0, 0])
            left = some[:, cut[0]] <= cut[1]
            todo += [(rows[left], number, 0), (rows[~left], number, 1)]
        if parent >= 0:
            tree.children[parent][side] = number
    return tree


def route(tree: KdTree, x: np.ndarray) -> np.ndarray:
    """Leaf of each vector."""
    leaf = np.zeros(len(x), np.int64)
    todo = [(0, np.arange(len(x)))] if tree.nodes else []
    while todo:
        node, rows = todo.pop()
        letter, threshold = tree.nodes[node]
        left = x[rows, letter] <= threshold
        for child, mine in zip(tree.children[node], (rows[left], rows[~left])):
            if child < 0:
                leaf[mine] = -1 - child
            elif len(mine):
                todo.append((child, mine))
    return leaf


def visit(tree: KdTree, q: np.ndarray, more: int, fewer: int) -> Iterator[tuple[np.ndarray, int]]:
    """(queries, leaf): the leaves whose box is reached by dropping ``more`` letters of a query and adding ``fewer``.

    Only the bounds of the letter that a node cuts change on the way down, so the distance to a box is kept up to date.
    """
    if not tree.nodes:
        yield np.arange(len(q)), 0
        return
    none = np.zeros(len(q), np.int32)
    todo = [(0, np.arange(len(q)), none, none, {})]
    while todo:
        node, rows, above, below, box = todo.pop()
        letter, threshold = tree.nodes[node]
        have = q[rows, letter]
        low, high = box.get(letter, (0, np.iinfo(np.int32).max))
        for side, child in enumerate(tree.children[node]):
            new = (low, min(high, threshold)) if side == 0 else (max(low, threshold + 1), high)
            over = above + np.maximum(have - new[1], 0) - np.maximum(have - high, 0)
            under = below + np.maximum(new[0] - have, 0) - np.maximum(low - have, 0)
            near = (over <= more) & (under <= fewer)
            if not near.any():
                continue
            if child < 0:
                yield rows[near], -1 - child
            else:
                todo.append((child, rows[near], over[near], under[near], {**box, letter: new}))


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of ``a`` and ``b`` differ by exactly one replaced, or one inserted or deleted, letter."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    if a.shape[1] > b.shape[1]:
        a, b = b, a
    head = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= a.shape[1]


def _steps(query: int, size: int) -> tuple[int, int]:
    """Letters a word may have too many and too few of, against one of ``size`` letters."""
    return int(query >= size), int(query <= size)


class Cell:
    """Words of one length, searched through their own tree."""

    def __init__(self, words: list[str], n: np.ndarray):
        self.words, self.n, self.codes = words, n, letters(words)
        x = counts(self.codes)
        self.tree = grow(x, LEAF_WORDS)
        # a letter counted c times is c ones, so that a product of rows counts common letters
        self.steps = np.repeat(np.arange(_LETTERS), x.max(axis=0))
        self.rank = np.concatenate([np.arange(c) for c in x.max(axis=0)])
        self.ones = self._unary(x)
        order = np.argsort(np.array(words, dtype=object), kind="stable")
        self.order = np.empty(len(words), np.int64)
        self.order[order] = np.arange(len(words))

    def _unary(self, x: np.ndarray) -> np.ndarray:
        return (x[:, self.steps] > self.rank).astype(np.float32)

    def near(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) positions of pairs one edit apart."""
        size = max(codes.shape[1], self.codes.shape[1])
        pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for at in range(0, len(codes), max(1, _VALUES // max(len(self.steps), _LETTERS))):
            some = codes[at : at + max(1, _VALUES // max(len(self.steps), _LETTERS))]
            x = counts(some)
            ones = self._unary(x)
            for rows, leaf in visit(self.tree, x, *_steps(codes.shape[1], self.codes.shape[1])):
                mine = self.tree.leaves[leaf]
                # pieces that bound the product where many equal vectors make a leaf large
                for part in range(0, len(rows), max(1, _VALUES // len(mine))):
                    part = rows[part : part + max(1, _VALUES // len(mine))]
                    i, j = np.nonzero(ones[part] @ self.ones[mine].T >= size - 1)
                    i, j = part[i], mine[j]
                    for a in range(0, len(i), max(1, _VALUES // size)):
                        p, w = i[a : a + max(1, _VALUES // size)], j[a : a + max(1, _VALUES // size)]
                        hit = one_edit(some[p], self.codes[w])
                        pairs.append((p[hit] + at, w[hit]))
        return np.concatenate([p for p, _ in pairs]), np.concatenate([w for _, w in pairs])

    def best(self, queries: list[str]) -> pa.RecordBatch | None:
        """Of each query with a near word here: how many, and the one with the most occurrences."""
        who, which = self.near(letters(queries))
        if not len(who):
            return None
        order = np.lexsort((self.order[which], -self.n[which], who))
        who, which = who[order], which[order]
        first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        found = which[first]
        columns = [
            pa.array([queries[i] for i in who[first]]), pa.array(np.diff(np.r_[first, len(who)])),
            pa.array(-self.n[found]), pa.array([self.words[i] for i in found]),
        ]
        return pa.RecordBatch.from_arrays(columns, ["word", "n_near", "minus_n", "near"])


def _runs(*keys: np.ndarray) -> Iterator[tuple[int, int]]:
    if len(keys[0]):
        new = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        edges = np.r_[0, np.flatnonzero(new) + 1, len(keys[0])]
        yield from zip(edges, edges[1:])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell, kind and length: the words of a cell first, then those that search it."""
    here, words, n, cell = None, [], [], None
    for part in batches:
        size, leaf, cut, kind, letters_of = (part.column(i).to_numpy() for i in range(5))
        for a, b in _runs(size, leaf, cut, kind, letters_of):
            own, some = (size[a], leaf[a], cut[a]), part.column(5).slice(a, b - a).to_pylist()
            if kind[a] == 0:
                if own != here:
                    here, words, n, cell = own, [], [], None
                words += some
                n.append(part.column(6).slice(a, b - a).to_numpy())
            elif own == here:
                cell = cell or Cell(words, np.concatenate(n))
                found = cell.best(some)
                if found is not None:
                    yield found


def _by_size(size: np.ndarray, words: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, positions, letter counts) of a batch's words, long ones in pieces."""
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        for a in range(0, len(at), max(1, _VALUES // max(int(n), _LETTERS))):
            some = at[a : a + max(1, _VALUES // max(int(n), _LETTERS))]
            yield int(n), some, counts(letters(words.take(pa.array(some)).to_pylist()))


def _fit(words: DataFrame) -> dict[int, KdTree]:
    """A tree for each length in the sample; other lengths have one leaf."""
    drawn: dict[int, list[str]] = {}
    for r in words.select("size", "word").orderBy(F.xxhash64("word")).limit(SAMPLE).collect():
        drawn.setdefault(r["size"], []).append(r["word"])
    sizes = words.sparkSession.createDataFrame([(n,) for n in drawn], "size int")
    totals = words.join(F.broadcast(sizes), "size").groupBy("size").agg(F.count("*").alias("n")).collect()
    return {
        r["size"]: grow(counts(letters(drawn[r["size"]])), max(8, len(drawn[r["size"]]) * CELL_WORDS // r["n"])) for r in totals
    }


def _near(words: DataFrame) -> DataFrame:
    """``(word, n_near, minus_n, near)``: each word's near words by cell, reduced to their number and the first of them."""
    spark = words.sparkSession
    trees = spark.sparkContext.broadcast(_fit(words))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            leaf = np.zeros(len(part), np.int64)
            for size, at, x in _by_size(part.column(2).to_numpy(), part.column(0)):
                if size in trees.value:
                    leaf[at] = route(trees.value[size], x)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaf)], ["word", "n", "letters", "leaf"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for size, at, x in _by_size(part.column(1).to_numpy(), part.column(0)):
                for other in (size - 1, size, size + 1):
                    for rows, leaf in visit(trees.value.get(other, KdTree()), x, *_steps(size, other)):
                        own = part.take(pa.array(at[rows]))
                        columns = [*own.columns, pa.array(np.full(len(rows), other, np.int32)), pa.array(np.full(len(rows), leaf))]
                        yield pa.RecordBatch.from_arrays(columns, ["word", "letters", "size", "leaf"])

    routed = words.select("word", "n", F.col("size").alias("letters")).mapInArrow(place, "word string, n long, letters int, leaf long")
    routed = materialise(routed, "routed")
    most = F.greatest(F.lit(1), F.least(F.lit(CELL_WORDS), F.floor(F.lit(CELL_LETTERS) / F.col("letters"))))
    cuts = routed.groupBy("letters", "leaf").agg(F.count("*").alias("n"))
    cuts = materialise(cuts.select(F.col("letters").alias("size"), "leaf", F.ceil(F.col("n") / most).cast("int").alias("cuts")), "cuts")
    stored = routed.withColumn("size", F.col("letters")).join(cuts, ["size", "leaf"]).select(
        "size", "leaf", F.pmod(F.xxhash64("word"), "cuts").cast("int").alias("cut"), F.lit(0).alias("kind"), "letters", "word", "n"
    )
    asked = routed.select("word", "letters").mapInArrow(search, "word string, letters int, size int, leaf long")
    asked = asked.join(cuts, ["size", "leaf"]).select(
        "size", "leaf", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), F.lit(1).alias("kind"), "letters", "word",
        F.lit(0).cast("long").alias("n"),
    )
    cells = stored.unionAll(asked).repartition(width(spark), "size", "leaf", "cut")
    cells = cells.sortWithinPartitions("size", "leaf", "cut", "kind", "letters")
    return cells.mapInArrow(_meet, "word string, n_near long, minus_n long, near string")


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of the words with a form: paths are doubled until none grows.

    Each step at least doubles a word's occurrences, so a path has at most as many steps as a count has bits.
    """
    paths = materialise(forms.select("word", F.col("form").alias("root")), "paths")
    while True:
        ahead = paths.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = paths.join(ahead, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("grew")
        )
        longer = materialise(longer, "paths")
        paths = longer.drop("grew")
        if not longer.where("grew").limit(1).count():
            return paths


def variants(
    docs: DataFrame, least_letters: int = 5, least: int = 3, ratio: int = 2, spoil: int | None = None,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of the whole texts.

    Words are runs of ``[A-Za-zÀ-ÿ]`` with A-Z lower-cased, of at least ``least_letters`` letters and ``least``
    occurrences ``n`` in all rows; ``spoil`` plants misspellings (see :func:`words_of`). Two words are near if they differ by
    exactly one inserted, deleted or replaced letter. A word's form is its near word with the most occurrences, ties to the
    smaller in code-point order, if that has at least ``ratio`` (2 or more) times its own; otherwise null. The root follows forms to the
    last one. Null and empty texts have no words; repeated rows and ids are counted like others; an empty table gives no
    rows; other columns are ignored.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    words = vocabulary(docs, least_letters, least, spoil, key, text).withColumn("size", F.length("word"))
    words = materialise(words, "words")
    near = _near(words).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("minus_n", "near")).alias("first"))
    form = F.col("first.minus_n") <= -ratio * F.col("n")
    judged = words.join(near, "word", "left").select(
        "word", F.when(form, F.col("first.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(form, -F.col("first.minus_n")).alias("form_n"),
    )
    judged = materialise(judged, "judged")
    return judged.join(_roots(judged.where("form IS NOT NULL")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )

"""Quality filter: perplexity under an interpolated modified Kneser-Ney model of byte n-grams trained on trusted text.

A gram of up to five bytes fits in a long with its length, so contexts and suffixes are shifts and masks. Counts, back-off
weights and probabilities are tables sharded by gram; documents lie in blocks, each block asks once for every gram it holds,
and a join brings back what the model has. Nothing of the model or the text passes through one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsig.llm.blocks import block_of, compressed, count_blocks, unpacked
from fleetsig.llm.shared import materialise

ORDER = 5
QUANTILE = 0.99
MARGIN = 1.1
MIN_CALIBRATION = 30
FOLDS = 5
_BEGIN = 0xFF  # no byte of UTF-8
_LENGTH = 40  # a gram's length stands above its bytes
_HELD = 1 << 22
_NEED, _TRAIN = 0, 1
_BLOCK_BYTES = 40_000_000


def grams(data: np.ndarray) -> np.ndarray:
    """The ORDER-gram that ends at each byte, beginnings padded."""
    padded = np.concatenate([np.full(ORDER - 1, _BEGIN, np.uint8), data]).astype(np.int64)
    code = np.zeros(len(data), np.int64)
    for j in range(ORDER):
        code = (code << 8) | padded[j : j + len(data)]
    return code


def _tagged(code: np.ndarray, length: int) -> np.ndarray:
    return code | (length << _LENGTH)


def _shorter(code: np.ndarray, length: int) -> np.ndarray:
    """The last ``length`` bytes."""
    return code & ((1 << (8 * length)) - 1)


class _Counts:
    """Distinct grams with their counts, merged now and then."""

    def __init__(self):
        self.keys, self.counts, self.held, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, code: np.ndarray) -> None:
        self.held.append(code)
        self.size += len(code)
        if self.size >= _HELD:
            self.merge()

    def merge(self) -> None:
        if self.held:
            keys, counts = np.unique(np.concatenate(self.held), return_counts=True)
            self.held, self.size = [], 0
            both, where = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
            self.counts = np.bincount(where, np.concatenate([self.counts, counts]), len(both)).astype(np.int64)
            self.keys = both


_GRAM = "kind int, block int, gram long, n long"


def _rows(kind: int, block: int, gram: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    columns = np.full(len(gram), kind, np.int32), np.full(len(gram), block, np.int32), gram, n
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "block", "gram", "n"])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (block, kind): trusted ids first. Gives the grams a block needs and counts of its training text."""
    train, trusted, need, at = _Counts(), set(), None, None

    def close() -> Iterator[pa.RecordBatch]:
        if need is not None:
            need.merge()
            for k in range(ORDER, 0, -1):
                code = np.unique(_shorter(need.keys, k))
                code = _tagged(np.append(code, (1 << (8 * k)) - 1), k)  # and the beginning, which is a context only
                yield _rows(_NEED, at, code, np.ones(len(code), np.int64))

    for part in batches:
        blocks, kinds, keys = (part.column(i).to_pylist() for i in range(3))
        folds = part.column(3).to_pylist()
        for block, kind, key, fold, data in zip(blocks, kinds, keys, folds, unpacked(part.column(5))):
            if block != at:
                yield from close()
                at, need, trusted = block, _Counts(), set()
            if kind == 0:
                trusted.add(key)
                continue
            code = grams(data)
            need.add(code)
            if key in trusted and fold:
                train.add(code)
    yield from close()
    train.merge()
    yield _rows(_TRAIN, 0, _tagged(train.keys, ORDER), train.counts)


def _discount(n: Column, by: dict[int, tuple[float, float, float]]) -> Column:
    """Modified Kneser-Ney discount of a count, by the gram's length."""
    length = F.shiftright("gram", _LENGTH)
    found = F.lit(0.0)
    for k, (one, two, more) in by.items():
        found = F.when(length == k, F.when(n == 1, one).when(n == 2, two).otherwise(more)).otherwise(found)
    return found


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and more from the numbers of grams counted 1 to 4 times."""
    if not n1 or not n2:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    two = 2 - 3 * y * n3 / n2
    more = 3 - 4 * y * n4 / n3 if n3 else two
    return min(max(1 - 2 * y * n2 / n1, 0.05), 1.0), min(max(two, 0.05), 2.0), min(max(more, 0.05), 3.0)


def _suffix(length: int) -> Column:
    return F.col("gram").bitwiseAND(F.lit((1 << (8 * length)) - 1)).bitwiseOR(F.lit(length << _LENGTH))


def _context(length: int) -> Column:
    bytes_ = F.col("gram").bitwiseAND(F.lit((1 << (8 * (length + 1))) - 1))
    return F.shiftright(bytes_, 8).bitwiseOR(F.lit(length << _LENGTH))


def train_model(counted: DataFrame) -> DataFrame:
    """``(gram, p, back)`` from counts ``(gram, n)`` of the longest grams: probability after its context, and the weight left
    to shorter grams where it is itself the context. The empty gram's ``p`` is that of an unseen byte. Shorter grams count
    the different bytes before them."""
    levels = {ORDER: materialise(counted.groupBy("gram").agg(F.sum("n").alias("n")), "counts")}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = materialise(levels[k + 1].groupBy(_suffix(k).alias("gram")).agg(F.count("*").alias("n")), "counts")
    by = {}
    for k, level in levels.items():
        got = level.agg(*[F.sum(F.when(F.col("n") == i, 1).otherwise(0)).alias(f"n{i}") for i in range(1, 5)]).first()
        by[k] = discounts(*(v or 0 for v in got))
    lost = _discount(F.col("n"), by)
    backs = {
        k: levels[k].groupBy(_context(k - 1).alias("context")).agg(F.sum("n").alias("total"), F.sum(lost).alias("mass"))
        for k in range(2, ORDER + 1)
    }
    root = levels[1].agg(F.sum("n").alias("total"), F.sum(lost).alias("mass")).first()
    total, mass = float(root.total or 1), float(root.mass or 1)
    unseen = mass / total / 256
    known = levels[1].select("gram", ((F.col("n") - lost) / total + unseen).alias("p"))
    model = known.sparkSession.createDataFrame([(0, unseen, 1.0)], "gram long, p double, back double")
    for k in range(1, ORDER + 1):
        if k > 1:
            shorter = known.select(F.col("gram").alias("suffix"), F.col("p").alias("q"))
            grown = levels[k].withColumns({"context": _context(k - 1), "suffix": _suffix(k - 1), "lost": lost})
            grown = grown.join(backs[k], "context").join(shorter, "suffix")
            share = (F.col("n") - F.col("lost")) / F.col("total") + F.col("mass") / F.col("total") * F.col("q")
            known = grown.select("gram", share.alias("p"))
        known = materialise(known, "level")
        if k < ORDER:
            left = backs[k + 1].select(F.col("context").alias("gram"), (F.col("mass") / F.col("total")).alias("back"))
            # a beginning is a context but no gram
            level = known.join(left, "gram", "full").select(
                "gram", F.coalesce("p", F.lit(1.0)).alias("p"), F.coalesce("back", F.lit(1.0)).alias("back")
            )
        else:
            level = known.select("gram", "p", F.lit(1.0).alias("back"))
        model = model.unionAll(level)
    return model


class _Model:
    """The part of the model that one block needs."""

    def __init__(self, gram: np.ndarray, p: np.ndarray, back: np.ndarray, unseen: float):
        self.levels, self.unseen = {}, np.log(unseen)
        order = np.argsort(gram)
        gram, p, back = gram[order], np.log(p[order]), np.log(back[order])
        for k in range(1, ORDER + 1):
            a, b = np.searchsorted(gram, [k << _LENGTH, (k + 1) << _LENGTH])
            self.levels[k] = gram[a:b] & ((1 << _LENGTH) - 1), p[a:b], back[a:b]

    def _find(self, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        known = self.levels[k][0]
        spot = np.searchsorted(known, code)
        spot[spot == len(known)] = 0
        return spot, (known[spot] == code) if len(known) else np.zeros(len(code), bool)

    def log_probability(self, code: np.ndarray) -> np.ndarray:
        """Of each ORDER-gram's last byte: the longest known gram, reached through back-off weights."""
        out, left = np.zeros(len(code)), np.arange(len(code))
        for k in range(ORDER, 0, -1):
            spot, hit = self._find(_shorter(code[left], k), k)
            out[left[hit]] += self.levels[k][1][spot[hit]]
            left = left[~hit]
            if not len(left):
                return out
            if k > 1:
                spot, hit = self._find(_shorter(code[left], k) >> 8, k - 1)
                out[left[hit]] += self.levels[k - 1][2][spot[hit]]
        out[left] += self.unseen
        return out


def _score(unseen: float):
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        model = _Model(*(found.column(c).to_numpy() for c in ("gram", "p", "back")), unseen)
        kinds, keys, folds, langs = (docs.column(c).to_pylist() for c in ("kind", "key", "fold", "lang"))
        trusted = {key for kind, key in zip(kinds, keys) if kind == 0}
        rows = []
        for kind, key, fold, lang, data in zip(kinds, keys, folds, langs, unpacked(docs.column("data"))):
            if kind:
                code = grams(data)
                total = sum(float(model.log_probability(code[at : at + _HELD]).sum()) for at in range(0, len(data), _HELD))
                ppl = float(np.exp(min(700.0, -total / len(data)))) if len(data) else None
                rows.append((key, lang, len(data), ppl, key in trusted and not fold))
        names = ["key", "lang", "n_bytes", "perplexity", "calibrates"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.bool_()]
        columns = zip(*rows) if rows else [[]] * 5
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    return run


def judge(
    docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, key: str = "doc_id",
    text: str = "text", lang: str = "lang", quality: str = "quality",
) -> DataFrame:
    """``(key, lang, n_bytes, perplexity, threshold, keep)`` per row of ``docs``.

    Trusted are documents that ``labels`` (same id column) gives quality 1 at least once. Four fifths of them, by a hash of
    the id, train the model; the perplexities of the others set the threshold: their ``quantile`` within the language times
    ``margin``, or over all languages where a language (or a null one) has fewer than MIN_CALIBRATION of them. Without
    trusted text everything with a letter of text is kept. Null and empty texts have no perplexity and are not kept; null
    ids are scored but never trusted; repeated rows are kept. All text is scored, whole, and no count is cut off.
    """
    spark = docs.sparkSession
    n = count_blocks(docs, text, _BLOCK_BYTES)
    fold = F.pmod(F.xxhash64("key", F.lit("fold")), F.lit(FOLDS)) != 0
    own = docs.select(F.col(key).cast("long").alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    own = own.select(block_of(F.col("key"), F.col("text"), n).alias("block"), F.lit(1).alias("kind"), "key", "lang", "text")
    good = labels.where((F.col(quality) == 1) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key")).distinct()
    good = good.select(
        block_of(F.col("key"), F.lit(""), n).alias("block"), F.lit(0).alias("kind"), "key", F.lit(None).cast("string").alias("lang"),
        F.lit(None).cast("binary").alias("data"),
    )
    both = compressed(own, "text", "data").unionAll(good)
    dealt = both.select("block", "kind", "key", F.coalesce(fold, F.lit(True)).alias("fold"), "lang", "data").repartition(n, "block")
    gathered = materialise(dealt.sortWithinPartitions("block", "kind").mapInArrow(_gather, _GRAM), "grams")
    model = materialise(train_model(gathered.where(F.col("kind") == _TRAIN).select("gram", "n")), "model")
    unseen = model.where("gram = 0").first().p
    asked = gathered.where(F.col("kind") == _NEED).select("block", "gram")
    found = asked.join(model, "gram").select("block", "gram", "p", "back")
    scored = dealt.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(
        _score(unseen), "key long, lang string, n_bytes long, perplexity double, calibrates boolean"
    )
    scored = materialise(scored, "scored")
    trial = scored.where("calibrates and perplexity is not null")
    at = F.percentile_approx("perplexity", quantile, 10000)
    every = trial.agg(at.alias("at")).first().at
    limits = trial.groupBy("lang").agg(at.alias("at"), F.count("*").alias("n")).where(F.col("n") >= MIN_CALIBRATION)
    limits = limits.select(F.col("lang").alias("of"), (F.col("at") * margin).alias("own_threshold"))
    threshold = F.coalesce("own_threshold", F.lit(every * margin if every is not None else None).cast("double"))
    met = scored.join(limits, scored.lang.eqNullSafe(limits.of), "left").withColumn("threshold", threshold)
    keep = F.when(F.col("perplexity").isNull(), False).otherwise(F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold")))
    return met.select("key", "lang", "n_bytes", "perplexity", "threshold", keep.alias("keep"))

"""Language of a text by a byte convolutional network, trained in numpy.

A text is read as windows of ``WINDOW`` bytes. Filters of several widths over one-hot bytes (a table of weights per place
and byte) are max-pooled over the window and feed a softmax; a text's score is the mean over all its windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
SAMPLE_PER_LANGUAGE = 1500  # training windows, one a document: the bound of what the driver gathers per language
UNKNOWN = "und"
_BATCH = 64
_ASCII_LETTER = re.compile("[A-Za-z]")
_TOGETHER = 4096  # windows of several texts that meet the network in one go


@dataclass
class ByteNet:
    """Languages, filter tables ``conv[w][place]`` of 256 x FILTERS, biases and the output layer."""

    languages: list[str]
    conv: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def pooled(self, x: np.ndarray, places: bool = False):
        """Largest activation of each filter in each window (rows of ``x``), and where it is."""
        tops, spots = [], []
        for w, table, bias in zip(WIDTHS, self.conv, self.bias):
            span = x.shape[1] - w + 1
            act = table[0][x[:, :span]]
            for j in range(1, w):
                act += table[j][x[:, j : j + span]]
            if places:
                spots.append(act.argmax(axis=1))
            tops.append(np.maximum(act.max(axis=1) + bias, 0))
        return np.concatenate(tops, axis=1), spots

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        parts = []
        for at in range(0, len(x), _BATCH):
            z = self.pooled(x[at : at + _BATCH])[0] @ self.out + self.out_bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            parts.append(z / z.sum(axis=1, keepdims=True))
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)), np.float32)


def windows(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text, the last padded with zeros, and their lengths."""
    n = max(1, -(-len(data) // WINDOW))
    x = np.zeros(n * WINDOW, np.uint8)
    x[: len(data)] = np.frombuffer(data, np.uint8)
    size = np.full(n, WINDOW)
    size[-1] = len(data) - (n - 1) * WINDOW
    return x.reshape(n, WINDOW), size


def train(texts: list[str], labels: list[str], epochs: int = 6, rate: float = 0.01, seed: int = 3) -> ByteNet:
    """Fit by Adam on the windows of the texts; the gradient reaches each filter at its largest activation only."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    cut = [windows(t.encode("utf-8", "replace"))[0] for t in texts]
    x = np.concatenate(cut)
    y = np.repeat([languages.index(v) for v in labels], [len(c) for c in cut])
    f32 = np.float32
    conv = [rng.normal(0, 0.3 / np.sqrt(w), (w, 256, FILTERS)).astype(f32) for w in WIDTHS]
    net = ByteNet(
        languages, conv, [np.zeros(FILTERS, f32) for _ in WIDTHS],
        rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(languages))).astype(f32), np.zeros(len(languages), f32),
    )
    weights = [*net.conv, *net.bias, net.out, net.out_bias]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), _BATCH):
            rows = order[at : at + _BATCH]
            xb, step = x[rows], step + 1
            h, spots = net.pooled(xb, places=True)
            z = h @ net.out + net.out_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            back = (p @ net.out.T) * (h > 0)
            grads, biases = [], []
            for i, w in enumerate(WIDTHS):
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                grad = np.zeros_like(net.conv[i])
                for j in range(w):
                    byte = np.take_along_axis(xb, spots[i] + j, axis=1)
                    np.add.at(grad[j], (byte, np.arange(FILTERS)[None, :]), g)
                grads.append(grad)
                biases.append(g.sum(axis=0))
            for n, (w, g) in enumerate(zip(weights, [*grads, *biases, h.T @ p, p.sum(axis=0)])):
                first[n] += 0.1 * (g - first[n])
                second[n] += 0.001 * (g * g - second[n])
                w -= (rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)).astype(f32)
    return net


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def fit(
    docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, key: str = "doc_id", text: str = "text", lang: str = "lang"
) -> ByteNet | None:
    """Train on one window each of about ``per_language`` documents per language, drawn by a hash of id and text; None if there are
    none. A row that is repeated is learned from once.

    Rows that ``held_out`` names, null ids, null or letterless texts and null labels are not learned from. The driver gathers
    ``per_language`` windows for each language, however large the table. The counts that are broadcast have one row per
    language, as the network's output layer has; texts are never shuffled.
    """
    usable = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(
        F.col("key").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out("key")
    )
    counts = usable.groupBy("lang").agg(F.count("*").alias("of"))
    draw = F.pmod(F.xxhash64("key", "text", F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    at = F.pmod(F.xxhash64("key", "text", F.lit("place")), F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1).cast("int")
    piece = F.substring("text", at + 1, F.lit(WINDOW)).alias("piece")
    some = usable.select("lang", "key", piece, draw.alias("draw")).join(F.broadcast(counts), "lang")
    some = some.where(F.col("draw") < F.lit(float(per_language)) / F.col("of")).select("key", "piece", "lang").distinct()
    rows = sorted(some.collect(), key=lambda r: (r.key, r.piece, r.lang))
    return train([r.piece for r in rows], [r.lang for r in rows]) if rows else None


def has_letter(text: str) -> bool:
    r"""Whether a text has a character of ``\p{L}``; numbers such as ``½`` are none."""
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


def scores(net: ByteNet, texts: list[bytes]) -> np.ndarray:
    """Mean softmax of each text over its windows, weighted by their lengths; the windows of all texts are put together."""
    sums, held, count = np.zeros((len(texts), len(net.languages))), [], 0

    def flush():
        x, size, owner = (np.concatenate(part) for part in zip(*held))
        for at in range(0, len(x), _TOGETHER):
            some = slice(at, at + _TOGETHER)
            np.add.at(sums, owner[some], size[some, None] * net.probabilities(x[some]).astype(np.float64))
        held.clear()

    for i, data in enumerate(texts):
        x, size = windows(data)
        held.append((x, size, np.full(len(x), i)))
        count += len(x)
        if count >= _TOGETHER or i == len(texts) - 1:
            flush()
            count = 0
    return sums / np.maximum([[len(t)] for t in texts], 1)


def predictor(net: ByteNet | None):
    """Pandas function: text -> (lang_pred, score)."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names = np.full(len(texts), UNKNOWN, object)
            best = np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if net is not None and t is not None and has_letter(t)]
            if known:
                mean = scores(net, [texts.iloc[i].encode("utf-8", "replace") for i in known])
                names[known] = np.array(net.languages, object)[mean.argmax(axis=1)]
                best[known] = np.minimum(1.0, mean.max(axis=1))
            yield pd.DataFrame({"lang_pred": names, "score": best})

    return predict


def identify(docs: DataFrame, net: ByteNet | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, held_out, lang_pred, score)`` per row: the mean softmax over all windows of the whole text.

    ``und`` with score 0 for texts that are null or have no letter, and for all if there is no model. Null ids are not
    held out. The language, source and id columns take no part in a prediction.
    """
    guess = predictor(net)(F.col(text))
    return docs.select(F.col(key).alias("key"), held_out(key).alias("held_out"), guess.alias("guess")).select(
        "key", "held_out", "guess.lang_pred", "guess.score"
    )

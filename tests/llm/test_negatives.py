import math

import numpy as np
import pytest

from fleetsig.llm import negatives

KIND = "vec_id long, embedding array<float>, label int, query string, leaf int, ids string, score double"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, lab, "x", 1, "y", 2.0) for k, v, lab in rows], KIND)


def plain(rows, anchor, positives=5, hard=3, low=50, high=95):
    """Every anchor against every row."""
    usable = set()
    for k, v, lab in rows:
        if k is not None and v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v):
            whole = tuple(math.floor(256 * float(np.float32(x))) for x in v)
            if sum(x * x for x in whole) < 2**53:
                usable.add((k, lab, whole))
    out = []
    for k, lab, v in usable:
        if not anchor(k):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), i, other) for i, other, w in usable if len(w) == len(v)]
        liked = sorted(x for x in scored if x[2] == lab and x[1] != k)[:positives]
        for minus, i, _ in liked:
            inside = sorted(x for x in scored if x[2] != lab and low * -minus <= 100 * -x[0] <= high * -minus)[:hard]
            out += [(k, i, rank, j, -minus, -s) for rank, (s, j, _) in enumerate(inside, 1)]
    return sorted(out)


def mined(rows, anchors):
    found = negatives.mine(anchors, rows)
    return sorted(tuple(r) for r in found.select("anchor", "positive", "rank", "negative", "positive_score", "negative_score").collect())


def test_rows_of_every_kind(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.9, 0.4], 1), (3, [0.8, 0.3], 2), (4, [0.7, 0.5], 3), (5, [0.6, 0.1], 2),
        (6, None, 1), (7, [1.0, None], 1), (8, [nan, 1.0], 2), (9, [1.0, inf], 2), (10, [1.0, 0.5], None), (None, [1.0, 1.0], 2),
        (11, [0.5, 0.5, 0.5], 2), (12, [], 1), (13, [], 2), (14, [0.0, 0.0], 1), (50, [0.0, 0.0], 1), (100, [], 1), (15, [0.0, 0.0], 4),
        (150, [-1.0, 0.2], 3), (150, [-1.0, 0.3], 3), (150, [1.0, 0.3], 2), (16, [-0.9, 0.1], 3), (17, [-0.5, 0.1], 1), (0, [1.0, 0.5], 1),
        (200, [3e38, 1.0], 1), (18, [1e6, 1.0], 1), (18, [1e4, 1.0], 2), (250, [0.3, 0.2], 9),
    ]
    base = frame(spark, rows)
    got = mined(base, base.where("vec_id % 50 = 0"))
    want = plain(rows, lambda k: k % 50 == 0)
    assert got == want and any(r[0] == 100 for r in got) and any(r[0] == 150 for r in got)
    assert mined(base.limit(0), base.limit(0)) == []
    assert mined(base, base.limit(0)) == []


@pytest.mark.parametrize("leaf, cell, sample", [(2048, 4096, 32768), (20, 4096, 32768), (60, 16, 300)])
def test_any_tree_gives_the_plain_answer(spark, monkeypatch, leaf, cell, sample):
    """Clusters, a third of equal vectors, ties, lengths that differ; leaves of any size and cells smaller than leaves."""
    monkeypatch.setattr(negatives, "LEAF_ROWS", leaf)
    monkeypatch.setattr(negatives, "CELL_VALUES", cell * 6)
    monkeypatch.setattr(negatives, "SAMPLE", sample)
    rng = np.random.default_rng(leaf)
    middle = rng.normal(size=(12, 6))
    x = middle[rng.integers(0, 12, 900)] + 0.15 * rng.normal(size=(900, 6))
    x[300:600] = x[3]
    x[600:650] = np.round(x[600:650])
    rows = [(i, np.float32(v).tolist(), int(rng.integers(0, 4))) for i, v in enumerate(x)]
    rows += [(1000 + i, np.float32(rng.normal(size=3)).tolist(), i % 2) for i in range(60)]
    base = frame(spark, rows)
    assert mined(base, base.where("vec_id % 25 = 0")) == plain(rows, lambda k: k % 25 == 0)


def test_siblings_are_eliminated():
    """In clustered data most leaves cannot meet the annulus, and none that holds a row in it is lost."""
    rng = np.random.default_rng(1)
    middle = 100 * rng.normal(size=(60, 8))
    x = np.floor(middle[rng.integers(0, 60, 6000)] + 3 * rng.normal(size=(6000, 8)))
    tree = negatives.grow(x[::2], 25, float((x * x).sum(axis=1).max()))
    leaf, ranges = negatives.route(tree, x), {}
    negatives.measure(tree, x, leaf, ranges)
    tree.low, tree.high = zip(*[ranges[i] for i in range(len(tree.points))])
    q, score = x[::100], x[::100] @ x.T
    best = np.sort(score, axis=1)
    low, high = best[:, -40], best[:, -10]
    who, seen = negatives.visit(tree, q, low, high)
    pairs = set(zip(who.tolist(), seen.tolist()))
    for i, row in zip(*np.nonzero((score >= low[:, None]) & (score <= high[:, None]))):
        assert (i, leaf[row]) in pairs
    assert len(pairs) < 0.35 * len(q) * len(tree.paths)

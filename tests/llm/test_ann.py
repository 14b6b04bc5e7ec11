import numpy as np
import pytest

from fleetsig.llm import ann

KIND = "vec_id long, embedding array<float>, label int, rep string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, 1, "x", "y") for k, v in rows], KIND)


def plain(queries, base, k):
    ok = lambda v: v and None not in v and np.isfinite(v).all() and any(v)
    out = {}
    for q, v in queries:
        if q is None or not ok(v):
            continue
        best = {}
        for c, w in base:
            if c is not None and c != q and ok(w) and len(w) == len(v):
                s = float(np.dot(np.float32(v).astype(float), np.float32(w).astype(float)))
                best[c] = max(s, best.get(c, s))
        out[q] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query"], r["rank"])):
        out.setdefault(r["query"], []).append((r["neighbour"], r["score"]))
    return out


def test_rows_of_every_kind(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (20, [-1.0, 0.5]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]),
        (7, [nan, 1.0]), (8, [inf, 1.0]), (None, [3.0, 1.0]), (9, [1.0, 2.0, 3.0]), (40, [0.0, 0.0]), (10, [2.0, 4.0]), (0, [1.0, 2.0]), (60, [5.0]),
    ]
    base = frame(spark, rows)
    asked = base.where("vec_id % 20 = 0")
    got = collected(ann.nearest(asked, base, k=3))
    want = plain([r for r in rows if r[0] is not None and r[0] % 20 == 0], rows, 3)
    assert got == {q: v for q, v in want.items() if v}
    assert ann.nearest(asked.limit(0), base.limit(0)).collect() == []
    assert collected(ann.nearest(asked, base, k=100)) == {q: v for q, v in plain([(0, [1.0, 2.0]), (20, [-1.0, 0.5])], rows, 100).items()}


@pytest.mark.parametrize("block", [8192, 7])
def test_recall_and_copies(spark, block):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 48)).astype(np.float32)
    x[500:900] = x[0]
    x[900:1200] = x[1] + 0.1 * rng.normal(size=(300, 48))
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    base = frame(spark, rows)
    got = collected(ann.nearest(base.where("vec_id % 50 = 0"), base, k=20, block=block))
    want = plain(rows[::50], rows, 20)
    assert all(len(got[q]) == 20 for q in want)
    found = sum(len({c for c, _ in got[q]} & {c for c, _ in v}) for q, v in want.items())
    assert found >= 0.9 * 20 * len(want)
    for q in want:
        if x[q].tolist() == x[0].tolist():
            assert [c for c, _ in got[q]] == [c for c, _ in want[q]]
        for c, s in got[q]:
            assert abs(s - float(x[q].astype(float) @ x[c].astype(float))) < 1e-9

import cProfile
import pstats

import numpy as np
import pyarrow as pa
import pytest
from cases import ROWS, documents

from fleetsig.llm import suffixes


def plain(rows, length=50):
    """(id, bytes, kept, spans) per row: windows that also start in a smaller id go."""
    named = [(-(1 << 63) if k is None else k, (t or "").encode()) for k, t, *_ in rows]
    least = {}
    for k, b in named:
        for a in range(len(b) - length + 1):
            w = b[a : a + length]
            least[w] = min(k, least.get(w, k))
    out = []
    for (k, b), (own, *_) in zip(named, rows):
        lost = np.zeros(len(b), bool)
        for a in range(len(b) - length + 1):
            if least[b[a : a + length]] < k:
                lost[a : a + length] = True
        turn = np.flatnonzero(np.diff(np.r_[False, lost, False].astype(np.int8))).reshape(-1, 2)
        out.append((own, len(b), bytes(np.frombuffer(b, np.uint8)[~lost]), [tuple(x) for x in turn.tolist()]))
    return out


def got(df):
    return [(r.doc, r.n_bytes, bytes(r.kept), [(s.start, s.stop) for s in r.spans]) for r in df.collect()]


def test_rows_of_every_kind(spark):
    docs = documents(spark)
    assert sorted(got(suffixes.repeated_spans(docs)), key=repr) == sorted(plain(ROWS), key=repr)
    assert suffixes.repeated_spans(docs.limit(0)).collect() == []


@pytest.mark.parametrize("seed,length,alphabet", [(1, 50, 2), (2, 50, 26), (3, 30, 3), (4, 64, 20)])
def test_pasted_passages(spark, seed, length, alphabet):
    rng = np.random.default_rng(seed)
    word = lambda n: "".join(chr(97 + x) for x in rng.integers(0, alphabet, n))
    base = [word(400) for _ in range(4)] + ["ab" * 200, "a" * 300]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.integers(0, 5)):
            source, a, n = base[rng.integers(0, len(base))], rng.integers(0, 300), rng.integers(10, 150)
            parts += [word(rng.integers(0, 30)), source[a : a + n]]
        rows.append((int(rng.integers(0, 50)), "".join(parts), "en"))
    df = documents(spark, rows)
    assert sorted(got(suffixes.repeated_spans(df, length)), key=repr) == sorted(plain(rows, length), key=repr)


def test_strands_cover_the_windows_of_each_text_alone(monkeypatch):
    rng = np.random.default_rng(5)
    texts = [rng.integers(97, 100, n).astype(np.uint8) for n in (0, 49, 300, 50, 3, 51, 1000, 0)]
    texts += [texts[6], np.full(200, 97, np.uint8), texts[6][100:700], np.zeros(0, np.uint8)]
    for most in (1 << 15, 7):
        monkeypatch.setattr(suffixes, "_MOST", most)
        flat, edges = suffixes._joined(texts)
        rows = list(zip(*(x.tolist() for x in suffixes.strands(flat, edges, 50))))
        windows = [(i, a) for i, _, start, n in rows for a in range(start, start + n)]
        assert windows == [(i, a) for i, t in enumerate(texts) for a in range(edges[i], edges[i] + len(t) - 49)]
        own = {k: [(h, a - edges[k], n) for i, h, a, n in rows if i == k] for k in (6, 8)}
        assert own[6] == own[8]  # the cuts follow the text, not the place


@pytest.mark.parametrize("zeros", [slice(0, 0), slice(8, 40), slice(7, 8), slice(0, 40)])
def test_texts_of_one_fingerprint_stay_apart(monkeypatch, zeros):
    """Fingerprints only order: with worthless ones the result is the same, in whatever order a block's rows come."""
    odd = suffixes._ODD.copy()
    odd[zeros] = 0
    monkeypatch.setattr(suffixes, "_ODD", odd)
    rng = np.random.default_rng(6)
    base = rng.integers(97, 99, 600).astype(np.uint8)
    texts = [base[a : a + n] for a, n in zip(rng.integers(0, 400, 80), rng.integers(0, 200, 80))]
    rows = [(int(i), t.tobytes().decode(), None) for i, t in zip(rng.integers(0, 40, 80), texts)]

    def table(rows):
        return pa.table({"block": pa.array([0] * len(rows), pa.int32()), "doc": [k for k, *_ in rows], "text": [t for _, t, _ in rows]})

    def kind(blobs, k):
        return blobs.append_column("kind", pa.array([k] * len(blobs), pa.int32()))

    shared = kind(suffixes._shared(suffixes._seen(50, 1)(table(rows))), 1)
    answers = kind(suffixes._answer(50)(suffixes._send(50, 1)(table(rows), shared)), 2)
    found = suffixes._spans(50, 1)(table(rows[::-1]), pa.concat_tables([shared, answers])).to_pylist()
    found = [(r["doc"], r["n_bytes"], r["kept"], [(s["start"], s["stop"]) for s in r["spans"]]) for r in found]
    assert sorted(found) == sorted(plain(rows))


def test_strands_are_not_walked_one_by_one():
    """Work on a strand is array work: a pass takes fewer Python calls than there are strands."""
    rng = np.random.default_rng(7)
    texts = ["".join(map(chr, rng.integers(97, 123, 2000))) for _ in range(100)] * 2
    docs = pa.table({"block": pa.array([0] * 200, pa.int32()), "doc": list(range(200)), "text": texts})
    shared = suffixes._shared(suffixes._seen(50, 4)(docs).slice(0, 1)).append_column("kind", pa.array([1], pa.int32()))
    profile = cProfile.Profile()
    sent = profile.runcall(suffixes._send(50, 1), docs, shared)
    n = 2 * len(suffixes._hashes(shared))
    assert sent.num_rows == 1 and n > 5000 and pstats.Stats(profile).total_calls < n

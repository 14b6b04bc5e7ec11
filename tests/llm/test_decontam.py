import random

import numpy as np
from cases import ROWS, documents

from fleetsig.llm import decontam

RNG = random.Random(1)
VOCABULARY = [f"w{i}" for i in range(3000)] + ["the", "of", "and"] * 300


def text(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


def plain_align(item, words):
    best, h = 0, np.zeros((len(item) + 1, len(words) + 1), int)
    for i in range(1, len(item) + 1):
        for j in range(1, len(words) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if item[i - 1] == words[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    best = h.max()
    return best, int(h.max(axis=0).argmax())


def test_align():
    rng = np.random.default_rng(0)
    for _ in range(40):
        a, b = rng.integers(0, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(0, 25))
        score, end = decontam.align(a, b)
        assert (score, end) == (plain_align(a.tolist(), b.tolist()) if len(b) else (0, 0))


def test_copies_edits_and_clean_documents(spark):
    items = [(i, text(30)) for i in range(12)] + [(50, "two words"), (51, None), (52, "..."), (None, text(25)), (3, text(20))]
    edited = items[1][1].split()
    edited[4:6] = ["other", "more", "new"]
    edited[15], edited[22:24] = "changed", []
    rows = [(100 + i, text(400), "en") for i in range(30)]
    rows += [(200, f"{text(50)} {items[0][1].upper()}! {text(20)}", "en"), (201, f"{text(30)} {' '.join(edited)} {text(9)}", "en")]
    rows += [(202, " ".join(items[2][1].split()[:8]), "en"), (203, f"{text(9)} Two, words. {text(5)}", "en"), (None, items[5][1], "en"), (200, items[7][1], "en")]
    rows += [(300 + i, f"{text(5)} {items[6][1]} {text(3)}", "en") for i in range(40)]
    rows += [(400, text(60000) + " " + items[8][1], "en"), (401, (items[9][1] + " ") * 50, "en")]
    docs = documents(spark, rows + ROWS)
    bench = spark.createDataFrame([(k, t, 1, "x") for k, t in items], "item_id long, text string, doc int, score string")
    want = {(200, 0), (201, 1), (203, 50), (None, 5), (200, 7), (400, 8), (401, 9)} | {(300 + i, 6) for i in range(40)}
    for chars in (decontam.BLOCK_CHARS, 300):
        found = decontam.find_leaks(docs, bench, block_chars=chars).collect()
        assert {(r.doc, r["item"]) for r in found} == want
        by = {(r.doc, r["item"]): r for r in found}
        assert by[200, 0].score == 1 and (by[200, 0].start, by[200, 0].end) == (50, 80)
        assert 0.5 <= by[201, 1].score < 1
    clean = decontam.without_leaks(docs, bench)
    assert clean.columns == docs.columns
    left = sorted(((r.doc_id, r.text) for r in clean.collect()), key=repr)
    gone = {(k, t) for k, t, _ in rows if k is None or k in (200, 201, 203, 400, 401) or 300 <= k < 340}
    assert left == sorted(((k, t) for k, t, _ in rows + ROWS if (k, t) not in gone), key=repr)
    assert decontam.find_leaks(docs.limit(0), bench).collect() == []
    assert decontam.find_leaks(docs, bench.limit(0)).collect() == []
    assert decontam.without_leaks(docs, bench.limit(0)).count() == docs.count()

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import ROWS, documents

from fleetsig.llm import spelling


def edited(a, b):
    """One inserted, deleted or replaced letter, tried one by one."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, least_letters=5, least=3, ratio=2, spoil=None):
    """Every word against every word."""
    seen = Counter()
    for doc_id, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if spoil and h % spoil == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    words = {w: n for w, n in seen.items() if len(w) >= least_letters and n >= least}
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and edited(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def found(df, **how):
    got = spelling.variants(df, **how).select("word", "form", "root", "n", "n_near", "form_n").collect()
    return sorted(tuple(r) for r in got)


def misspelt(seed, n):
    rng = np.random.default_rng(seed)
    syllables = ["an", "be", "cor", "dé", "en", "fu", "Gar", "ÿo", "ta", "ri", "o"]
    base = ["".join(rng.choice(syllables, rng.integers(2, 5))) for _ in range(n)]
    rows = []
    for i in range(150):
        words = []
        for w in rng.choice(base, 60):
            if rng.random() < 0.3:
                at, letter = rng.integers(0, len(w)), "aeiouÉé"[rng.integers(0, 7)]
                w = [w[:at] + w[at + 1 :], w[:at] + letter + w[at:], w[:at] + letter + w[at + 1 :]][rng.integers(0, 3)]
            words.append(str(w))
        rows.append((i % 140, " ".join(words), "en"))
    return rows


def test_documents_of_every_kind(spark):
    rows = ROWS + [(50 + i, "colour color colours Colour colouur x1color" + " color" * i, None) for i in range(4)]
    rows += [(60, ("b" * 70_000 + " ") * 3 + ("b" * 70_001 + " ") * 9, None)]
    assert found(documents(spark, rows)) == plain(rows)
    assert found(documents(spark, rows), least_letters=1, least=1, spoil=3) == plain(rows, 1, 1, spoil=3)
    assert found(documents(spark, rows[:0])) == []
    with pytest.raises(ValueError):
        spelling.variants(documents(spark, rows), ratio=1)


@pytest.mark.parametrize("cell, sample", [(8192, 65536), (40, 65536), (7, 100)])
def test_any_cells_give_the_plain_answer(spark, monkeypatch, cell, sample):
    monkeypatch.setattr(spelling, "CELL_WORDS", cell)
    monkeypatch.setattr(spelling, "SAMPLE", sample)
    chain = " ".join(["zzzzzw"] * 90 + ["zzzzww"] * 40 + ["zzzwww"] * 15 + ["zzwwww"] * 6 + ["zwwwww"] * 3)
    rows = [*misspelt(cell, 120), (1000, chain, None)]
    want = plain(rows, spoil=5)
    assert found(documents(spark, rows), spoil=5) == want
    assert sum(r[1] is not None for r in want) > 50 and any(r[1] != r[2] and r[1] for r in want)


@pytest.mark.parametrize("leaf", [1, 5, 64])
def test_cell_finds_every_near_word_and_prunes(monkeypatch, leaf):
    monkeypatch.setattr(spelling, "LEAF_WORDS", leaf)
    rng = np.random.default_rng(leaf)
    words = sorted({"".join(rng.choice(list("abcdeé"), 6)) for _ in range(700)})
    cell = spelling.Cell(words, np.arange(len(words)))
    for size in (5, 6, 7):
        asked = sorted({"".join(rng.choice(list("abcdeé"), size)) for _ in range(200)})
        who, which = cell.near(spelling.letters(asked))
        want = {(a, w) for a in asked for w in words if edited(a, w)}
        assert {(asked[i], words[j]) for i, j in zip(who, which)} == want and len(who) == len(want)
        seen = sum(
            len(rows) * len(cell.tree.leaves[leaf])
            for rows, leaf in spelling.visit(cell.tree, spelling.counts(spelling.letters(asked)), *spelling._steps(size, 6))
        )
        assert leaf > 5 or seen < 0.25 * len(asked) * len(words)

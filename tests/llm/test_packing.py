import heapq
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from cases import ROWS, documents
from tokenizers import Tokenizer

from fleetsig.llm import packing


def plain_difference(sizes, k):
    """Karmarkar-Karp over lists of lists."""
    heap = [(-n, at, [[n, [i]]] + [[0, []] for _ in range(k - 1)]) for at, (n, i) in enumerate(sorted((n, i) for i, n in enumerate(sizes))[::-1])]
    heapq.heapify(heap)
    tick = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        both = sorted(([x + y, i + j] for (x, i), (y, j) in zip(a, b[::-1])), key=lambda s: -s[0])
        both = [[n - both[-1][0], i] for n, i in both]
        heapq.heappush(heap, (-both[0][0], tick, both))
        tick += 1
    return sorted(sum(sizes[i] for i in part) for _, part in heap[0][2])


@pytest.mark.parametrize("n, k", [(1, 1), (1, 4), (7, 3), (60, 8), (300, 16)])
def test_differencing(n, k):
    rng = np.random.default_rng(n)
    sizes = np.array(sorted(rng.choice(5000, n, replace=False) + 1))
    window = packing.difference(sizes, k)
    sums = sorted(np.bincount(window, sizes, minlength=k).astype(int).tolist())
    assert sums == plain_difference(sizes.tolist(), k)
    assert n < 60 or sums[-1] - sums[0] < 0.02 * sums[-1]


def test_the_windows_rise_until_they_fit():
    assert sorted(np.bincount(packing.windows(np.array([6, 6, 6, 6, 6]), 10))) == [1] * 5
    assert packing.windows(np.array([10, 10, 10]), 10).max() == 2
    assert packing.windows(np.array([5, 5, 5, 5]), 10).max() == 1
    rng = np.random.default_rng(0)
    for _ in range(20):
        sizes = rng.integers(1, 100, rng.integers(1, 60))
        window, offset = packing.placed(sizes, 100)
        for w in np.unique(window):
            at = np.flatnonzero(window == w)[np.argsort(offset[window == w])]
            assert (offset[at] == np.cumsum(sizes[at]) - sizes[at]).all() and sizes[at].sum() <= 100


def check(rows, got, capacity):
    """Every token of every row lies in one piece, sequences have no gap and are not too long; returns the padded share."""
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for key, text, *_ in rows:
        want[key, tuple([*encode.encode(text or "", add_special_tokens=False).ids, 1])] += 1
    tokens = Counter()
    for (key, ids), n in want.items():
        tokens.update({(key, len(ids), at, t): n for at, t in enumerate(ids)})
    found, sequences = Counter(), {}
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        found.update((r.key, r.doc_tokens, r.start + i, t) for i, t in enumerate(r.ids))
        sequences.setdefault(r.sequence, []).append((r.offset, r.length))
    assert found == tokens
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [at for at, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= capacity
    return 1 - sum(tokens.values()) / (len(sequences) * capacity)


def test_documents_of_every_kind(spark):
    rows = [*ROWS, (70, "<|endoftext|> a <|startoftext|>", "en"), (71, "İSTANBUL ΣΑΣ ﬁ é", None)]
    for capacity in (2048, 20, 7):
        got = packing.pack(documents(spark, rows), capacity, with_ids=True).collect()
        check(rows, got, capacity)
    assert packing.pack(documents(spark, rows[:0])).collect() == []
    assert "ids" not in packing.pack(documents(spark, rows)).columns


def test_little_padding(spark):
    rng = np.random.default_rng(3)
    sizes = np.minimum(rng.lognormal(5, 1, 1600), 9000).astype(int)
    rows = [(i, " ".join(["river"] * n), "en") for i, n in enumerate(sizes)] + [(5000, "", "en")] * 400
    got = packing.pack(documents(spark, rows), 1000, with_ids=True).collect()
    assert check(rows, got, 1000) < 0.02


def test_words_give_the_ids_of_whole_texts():
    """Any mix of letters, marks, digits, spaces and special tokens, composed or not."""
    path = public_tokenizers.path("word_bpe_49k.json")
    by_word, whole = packing.Encoder(path, True), packing.Encoder(path, False)
    rng = np.random.default_rng(4)
    letters = list("aAsStT'’.,_-<|>eé́ΣσİǰΐK1²½Ⅳ \t\n\x1c\x85€…()\"dक़​汉한👍") + ["<|endoftext|>", "<|ENDOFTEXT|>", "'re", "..."]
    texts = ["".join(rng.choice(letters, rng.integers(0, 20))) for _ in range(6000)]
    assert list(by_word.encode(texts)) == list(whole.encode(texts)) == list(by_word.encode(texts))


def test_a_word_is_encoded_once_for_all_tasks_of_a_worker(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    packing._encoder.cache_clear()
    whole, asked = packing.Encoder(path, False), []
    direct = packing.Encoder.direct
    texts = ["river, hill; (stone) ab12", "Stone river... ab12", None, "", "ΣΑΣ river"]
    for task in range(3):
        encoder = packing._encoder(path, True)
        monkeypatch.setattr(encoder, "direct", lambda some: asked.extend(some) or direct(encoder, some))
        found = list(packing._token_ids(pa.array(texts), encoder))
        assert [x.tobytes() for x in found] == list(whole.encode([t or "" for t in texts]))
        assert "river" in " ".join(asked) if task == 0 else not asked
        asked.clear()
    packing._encoder.cache_clear()


def test_forgetting_words_and_failing_change_no_ids(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, encoder = packing.Encoder(path, False), packing.Encoder(path, True)
    monkeypatch.setattr(packing, "_KNOWN", 7)
    for i in range(12):
        texts = [f"one w{i} two.{i} " + "abc" * (i % 4), f"{chr(97 + i)}x one, <|endoftext|>"]
        if i % 4 == 2:
            with monkeypatch.context() as broken, pytest.raises(OSError):
                broken.setattr(encoder, "direct", lambda some: (_ for _ in ()).throw(OSError()))
                list(encoder.encode(["unseen words " + texts[0]]))
        assert list(encoder.encode(texts)) == list(whole.encode(texts))

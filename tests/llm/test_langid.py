import zlib

import numpy as np
from cases import ROWS, documents

from fleetsig.llm import langid

WORDS = {
    "en": "the of and to in is that it was for with as his they at be this from have".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au".split(),
}


def text(rng, lang):
    return " ".join(rng.choice(WORDS[lang], rng.integers(5, 200)))


def test_held_out_accuracy_and_fixed_columns(spark):
    rng = np.random.default_rng(4)
    rows = [(i, text(rng, lang), lang) for i in range(400) for lang in [list(WORDS)[i % 3]]]
    docs = documents(spark, rows)
    net = langid.fit(docs, per_language=100)
    got = {r.key: r for r in langid.identify(docs, net).collect()}
    assert net.languages == sorted(WORDS)
    for k, _, lang in rows:
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= got[k].score <= 1
    held = [got[k].lang_pred == lang for k, _, lang in rows if got[k].held_out]
    assert len(held) > 50 and np.mean(held) > 0.97
    odd = {(r.key, r.lang_pred == "und") for r in langid.identify(documents(spark), net).collect()}
    letterless = {k for k, t, _ in ROWS if not any(c.isalpha() for c in t or "")}
    assert odd == {(k, k in letterless) for k, *_ in ROWS}
    assert langid.identify(docs.limit(0), net).collect() == []


def test_nothing_to_learn(spark):
    docs = documents(spark, [(1, "some text", None), (2, None, "en"), (3, "123", "en")])
    assert langid.fit(docs) is None
    assert {(r.lang_pred, r.score) for r in langid.identify(docs, None).collect()} == {("und", 0.0)}


def test_windows_cover_the_whole_text():
    x, size = langid.windows(bytes(range(256)) * 3 + b"end")
    assert x.shape == (4, 256) and size.tolist() == [256, 256, 256, 3] and bytes(x.ravel()[:771]).endswith(b"end")
    assert langid.windows(b"")[0].shape == (1, 256)


def test_gradient_lowers_the_loss():
    rng = np.random.default_rng(0)
    texts, labels = zip(*[(text(rng, lang), lang) for _ in range(60) for lang in WORDS])
    p = langid.train(list(texts), list(labels), epochs=4)
    right = [p.languages[p.probabilities(langid.windows(t.encode())[0]).mean(0).argmax()] == v for t, v in zip(texts, labels)]
    assert np.mean(right) > 0.98


def plain_scores(net, data):
    """One text, one window and one filter at a time."""
    x, size = langid.windows(data)
    total = np.zeros(len(net.languages))
    for row, n in zip(x, size):
        h = []
        for w, table, bias in zip(langid.WIDTHS, net.conv, net.bias):
            for f in range(langid.FILTERS):
                acts = [sum(table[j][row[at + j], f] for j in range(w)) for at in range(len(row) - w + 1)]
                h.append(max(max(acts) + bias[f], 0))
        z = np.array(h) @ net.out + net.out_bias
        p = np.exp(z - z.max())
        total += n * p / p.sum()
    return total / max(1, len(data))


def test_texts_put_together_score_as_alone(monkeypatch):
    rng = np.random.default_rng(2)
    net = langid.train([text(rng, v) for v in WORDS for _ in range(10)], [v for v in WORDS for _ in range(10)], epochs=1)
    some = [b"", b"a", "é".encode() * 300, text(rng, "de").encode(), b"x" * 256, text(rng, "fr").encode() * 3]
    for together in (4096, 3):
        monkeypatch.setattr(langid, "_TOGETHER", together)
        assert np.allclose(langid.scores(net, some), [plain_scores(net, t) for t in some], atol=1e-5)


def test_letters_are_what_fit_takes_for_letters(spark):
    rows = [(i, t, "en") for i, t in enumerate(["½", "²", "Ⅳ", "①", "1_2", "汉", "é", "ª", "x", "٣", "👍", "", "_"])]
    frame = documents(spark, rows)
    by_spark = {r.doc_id: r.has for r in frame.selectExpr("doc_id", r"text RLIKE '\\p{L}' AS has").collect()}
    assert by_spark == {k: langid.has_letter(t) for k, t, _ in rows} and sum(by_spark.values()) == 4
    rng = np.random.default_rng(1)
    net = langid.train([text(rng, v) for v in WORDS], list(WORDS), epochs=1)
    got = {r.key: (r.lang_pred, r.score) for r in langid.identify(frame, net).collect()}
    assert all((got[k] == ("und", 0.0)) == (not langid.has_letter(t)) for k, t, _ in rows)


def test_a_repeated_id_does_not_fill_the_sample(spark, monkeypatch):
    rows = [(7, f"text number {i} of one id", "en") for i in range(3000)] + [(8, "the very same row", "en")] * 3000
    taken = []
    monkeypatch.setattr(langid, "train", lambda texts, labels: taken.extend(texts))
    langid.fit(documents(spark, rows), per_language=200)
    assert 50 < len(taken) < 200 and sum("very same" in t for t in taken) <= 1

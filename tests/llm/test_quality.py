import math
from collections import Counter, defaultdict

import pytest
from cases import ROWS, documents

from fleetsig.llm import quality

WORDS = {"en": "the of and river hill stone quiet water morning light".split(), "de": "der die und fluss hügel stein ruhig wasser morgen licht".split()}


def prose(lang, i, n=60):
    return " ".join(WORDS[lang][(i * 7 + j * j + j * i) % 10] for j in range(n)) + "."


def plain_model(texts, order):
    """Interpolated modified Kneser-Ney over bytes: a function (context, byte) -> probability."""
    counts = {order: Counter()}
    for t in texts:
        padded = (None,) * (order - 1) + tuple(t.encode())
        for i in range(len(padded) - order + 1):
            counts[order][padded[i : i + order]] += 1
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cut, after = {}, {}
    for k, c in counts.items():
        cut[k] = quality.discounts(*(sum(v == i for v in c.values()) for i in (1, 2, 3, 4)))
        after[k] = defaultdict(list)
        for g, v in c.items():
            after[k][g[:-1]].append(v)

    def lost(k, v):
        return cut[k][min(v, 3) - 1]

    def p(context, byte):
        if not context:
            total, mass = sum(counts[1].values()), sum(lost(1, v) for v in counts[1].values())
            v = counts[1][(byte,)]
            return (v - lost(1, v) if v else 0) / total + mass / total / 256
        k, own = len(context) + 1, after[len(context) + 1].get(context)
        below = p(context[1:], byte)
        if not own:
            return below
        v, total = counts[k][(*context, byte)], sum(own)
        return (v - lost(k, v) if v else 0) / total + sum(lost(k, v) for v in own) / total * below

    return p


def test_perplexity_and_thresholds(spark):
    rows = [(i, prose(lang, i), lang) for i in range(150) for lang in ("en", "de") if (i % 2) == (lang == "en")]
    rows += [(500 + i, f"%%% {i} $$$ &&& {i * i} ###", "en") for i in range(10)] + [(600, "new clear river water of the hill", "fr"), (601, None, "en"), (602, "", None), (None, prose("en", 3), "en")]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)] * 2 + [(None, 1, 0), (500, 0, 1), (999, 1, 0)], "doc_id long, quality int, toxic int")
    got = {(r.key, r.n_bytes): r for r in quality.judge(docs, labels).collect()}
    assert len(got) == len(rows)
    fold = {r.k: r.f for r in spark.range(150).selectExpr("id k", f"pmod(xxhash64(id, 'fold'), {quality.FOLDS}) <> 0 f").collect()}
    p = plain_model([t for k, t, _ in rows if k is not None and k < 150 and fold[k]], quality.ORDER)
    for k, t, _ in rows:
        r = got[k, len((t or "").encode())]
        if t:
            padded = (None,) * (quality.ORDER - 1) + tuple(t.encode())
            logs = [math.log(p(padded[i : i + quality.ORDER - 1], padded[i + quality.ORDER - 1])) for i in range(len(t.encode()))]
            assert math.isclose(r.perplexity, math.exp(-sum(logs) / len(logs)), rel_tol=1e-9)
            assert r.keep == (r.perplexity <= r.threshold)
        else:
            assert r.perplexity is None and not r.keep
    assert not any(got[500 + i, len(f"%%% {i} $$$ &&& {i * i} ###")].keep for i in range(10))
    assert sum(r.keep for (k, _), r in got.items() if k is not None and k < 150) >= 145


def test_rows_of_every_kind(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(k, 1, 0) for k in (1, 2, 3, 9)], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, labels).collect()
    assert sorted((r.key for r in got), key=repr) == sorted((k for k, *_ in ROWS), key=repr)
    none = quality.judge(docs, labels.limit(0)).collect()
    assert all(r.keep == (r.n_bytes > 0) and r.threshold is None for r in none)
    assert quality.judge(docs.limit(0), labels).collect() == []


def test_discounts_without_singletons():
    assert quality.discounts(0, 3, 1, 1) == (0.5, 1.0, 1.5)
    assert quality.discounts(10, 5, 3, 2) == pytest.approx((0.5, 1.1, 5 / 3))

import re

import pytest
from cases import ROWS, documents
from test_lines import plain as plain_lines
from test_simhash import plain_components, plain_fingerprint

import corpus_pipeline as cp

WORDS = {"en": "the of and to in is that it was for with as his they at be".split(), "de": "der die und in den von zu das mit sich des auf für ist im dem".split()}


def prose(lang, i, n=80):
    return " ".join(WORDS[lang][(i * 31 + j * j * (i % 7 + 1) + j * i) % 16] for j in range(n)) + f" {lang}{i}."


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows = [(100 + i, prose(["en", "de"][i % 2], i), ["en", "de"][i % 2]) for i in range(120)]
    rows += [(300 + i, rows[4][1], "en") for i in range(3)] + [(400, "quiet river stones under morning light near seven old mills by hand", "en")]
    documents(spark, rows + ROWS).write.parquet(f"{folder}/documents.parquet")
    bench = [(1, "quiet river stones under morning light near seven old mills by hand"), (2, None)]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=repr)


def test_stages_do_what_they_say(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "mixing"]
    for _, stage in cp.STAGES:
        empty = stage(spark, docs.limit(0), sf_dir)
        assert empty.columns == docs.columns and empty.count() == 0

    named = cp.identify_language(spark, docs, sf_dir)
    assert named.columns == docs.columns
    gone = set(rows_of(docs)) - set(rows_of(named))
    assert gone >= {r for r in rows_of(docs) if not re.search(r"[^\W\d_]", r[1] or "")}
    assert not [k for k, _ in gone if k is not None and 100 <= k <= 500]

    lined = cp.dedup_lines(spark, docs, sf_dir)
    before = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    assert rows_of(lined) == sorted(((k, t) for k, _, _, t in plain_lines(before)), key=repr)

    single = rows_of(cp.dedup_near(spark, docs, sf_dir))
    every = rows_of(docs)
    group = plain_components([plain_fingerprint(t) for _, t in every], list(range(len(every))), 4)
    want = {}
    for (k, t), g in zip(every, group):
        want.setdefault(g, []).append((k is None, k or 0))
    assert sorted(repr(k) for k, _ in single) == sorted(repr(None if min(v)[0] else min(v)[1]) for v in want.values())

    clean = rows_of(cp.decontaminate(spark, docs, sf_dir))
    assert clean == [r for r in every if r[0] != 400]

    mixed = rows_of(cp.mix(spark, docs, sf_dir))
    assert 0 < len(mixed) < len(every) and set(mixed) <= set(every)


def test_run_applies_every_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = docs
    for _, stage in cp.STAGES:
        want = stage(spark, want, sf_dir)
    got = cp.run(spark, sf_dir)
    assert got.columns == docs.columns and rows_of(got) == rows_of(want)

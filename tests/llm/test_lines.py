import zlib

import numpy as np
import pytest
from cases import ROWS, SHARED, documents

from fleetsig.llm import lines

BLANK = " \t\n\v\f\r"


def plain(rows, min_docs=3):
    """(n_lines, n_dropped, kept) per row."""
    def key(line):
        stripped = line.strip(BLANK)
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in stripped)

    holders = {}
    for k, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(-(10**18) if k is None else k)
    out = []
    for k, t, *_ in rows:
        own = (t or "").split("\n")
        stay = [x for x in own if len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == k]
        out.append((k, len(own), len(own) - len(stay), "\n".join(stay)))
    return out


def check(spark, rows):
    got = lines.dedup_lines(documents(spark, rows), counts=True, into="text").select("doc_id", "n_lines", "n_dropped", "text")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(plain(rows), key=repr)


def test_rows_of_every_kind(spark):
    check(spark, ROWS)


def test_empty_table_and_extra_columns(spark):
    docs = documents(spark)
    assert lines.dedup_lines(docs.limit(0), into="out").collect() == []
    assert lines.dedup_lines(docs, into="text").columns == docs.columns
    with pytest.raises(ValueError):
        lines.dedup_lines(docs, into="kept")


@pytest.mark.parametrize("parts", ["1", "13"])
def test_hot_lines_over_many_partitions(spark, parts):
    rng = np.random.default_rng(5)
    rows = [(i, "\n".join([SHARED] * (i % 3 > 0) + [f"line number {int(n):04d} of some length" for n in rng.integers(0, 60, 3)]), "en") for i in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        check(spark, rows + [(7, SHARED, "en")])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_bitmap(spark):
    docs = documents(spark, [(i, f"{SHARED}\n{i}\n{SHARED}", "en") for i in (1, 2, 3)])
    found = {r.doc: r for r in lines.keep_bitmaps(docs).collect()}
    assert set(found) == {1, 2} and found[1].dropped == 2 and found[1].n == 3
    assert np.unpackbits(np.frombuffer(zlib.decompress(found[1].keep), np.uint8))[:3].tolist() == [0, 1, 0]

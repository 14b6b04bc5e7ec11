import numpy as np
import pytest
import xxhash
from pyspark.sql import Row

from fleetsig.llm import simhash
from fleetsig.llm.components import connected_components


def plain_fingerprint(text, n=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lowered) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, keys, distance):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    group = {}
    for i, k in enumerate(keys):
        if k is not None:
            group[find(i)] = min(k, group.get(find(i), k))
    return [group.get(find(i)) for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", " \t", "One", "a B  c\nd e", "É x y z w q É", "w " * 70000, "ab cd ef gh " * 9])
def test_fingerprint(text):
    assert simhash.fingerprint(text, 4) == plain_fingerprint(text)


@pytest.mark.parametrize("distance,block", [(4, 4096), (4, 5), (1, 3), (7, 50)])
def test_links_connect_what_is_near(spark, distance, block):
    rng = np.random.default_rng(distance)
    base = [int(x) for x in rng.integers(0, 2**63, 12, np.int64)]
    fps = [0, 15, 2**64 - 1]
    for b in base:
        for _ in range(20):
            x = b
            for bit in rng.choice(64, rng.integers(0, distance + 3), replace=False):
                x ^= 1 << int(bit)
            fps.append(x)
    fps = list(dict.fromkeys(fps))
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {r.node: r.root for r in connected_components(simhash.links(df, distance, block)).collect()}
    want = plain_components(fps, signed, distance)
    assert [found.get(x, x) for x in signed] == want


def test_rows_of_every_kind(spark):
    long = " ".join(f"w{i % 997}" for i in range(60000))
    rows = [(5, "a b c d e f"), (2, "A b c\td e f"), (9, None), (7, ""), (None, "a b c d e f"), (2, "A b c\td e f"), (11, long), (3, long + " tail")]
    docs = spark.createDataFrame([Row(doc_id=k, text=t, fp="clash", component=0, key=1) for k, t in rows], "doc_id long, text string, fp string, component int, key int")
    got = simhash.near_duplicates(docs).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    want = plain_components(fps, [k for k, _ in rows], 4)
    assert sorted(((r.key, r.fp % 2**64, r.component) for r in got), key=repr) == sorted(
        ((k, f, c) for (k, _), f, c in zip(rows, fps, want)), key=repr
    )
    assert simhash.near_duplicates(docs.limit(0)).collect() == []

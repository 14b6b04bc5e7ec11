"""The sliced operators against plain Python, for random histories and slice widths."""

import random

import pytest
from helpers import at, got, samples
from pyspark.sql import functions as F

from fleetsig.operators import intervals
from fleetsig.operators.timeline import neighbours, running


def history(seed, keys=3, n=60, span=20_000, values=4, hot=True):
    """Random samples; one key holds about half of them."""
    rng = random.Random(seed)
    rows = []
    for k in range(keys):
        count = n * keys if hot and k == 0 else n
        for s in sorted(rng.sample(range(span), min(count, span))):
            rows.append((k, 1, s, rng.choice([None] + list(range(values))) if rng.random() < 0.1 else rng.randrange(values)))
    return rows


def per_key(rows):
    out = {}
    for k, _p, s, v in rows:
        out.setdefault(k, []).append((s, v))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_neighbours(spark, sliced, seed):
    rows = history(seed)
    want = []
    for k, series in per_key(rows).items():
        for i, (s, _v) in enumerate(series):
            want.append((
                k, float(s),
                None if series[i - 1][1] is None or i == 0 else float(series[i - 1][1]),
                float(series[i + 1][0]) if i + 1 < len(series) else None,
            ))
    for _ in sliced(60, 3600, 10**7):
        df = neighbours(samples(spark, rows), ["instrument_id"], "time", {"p": "value_num"}, {"n": "time"})
        assert got(df, "instrument_id", "time", "p", "n") == sorted(want, key=repr)


def test_running(spark, sliced):
    rows = history(3)
    want = []
    for k, series in per_key(rows).items():
        top, total = None, 0
        for s, v in series:
            top = v if top is None else max(top, v) if v is not None else top
            total += 1
            want.append((k, float(s), None if top is None else float(top), total))
    for _ in sliced(120, 5000):
        df = samples(spark, rows).withColumn("one", F.lit(1))
        out = running(df, ["instrument_id"], "time", [], {"top": "value_num"}, {"total": "one"})
        assert got(out, "instrument_id", "time", "top", "total") == sorted(want, key=repr)


def brute_sessions(rows):
    out = []
    for k, series in per_key(rows).items():
        changes = [
            (s, v) for (s, v), (_s, before) in zip(series[1:], series) if v is not None and before is not None and v != before
        ]
        for i, (s, v) in enumerate(changes):
            if v != 0:
                out.append((k, int(v), float(s), float(changes[i + 1][0]) if i + 1 < len(changes) else None))
    return out


@pytest.mark.parametrize("seed", [4, 5, 6])
def test_sessions(spark, sliced, seed):
    rows = history(seed, values=3 if seed < 6 else 2)
    want = sorted(brute_sessions(rows), key=repr)
    for _ in sliced(60, 1000, 10**7):
        df = intervals.sessions(samples(spark, rows))
        assert got(df, "instrument_id", "session_id", "start_time", "end_time") == want


def test_tagging_equals_range_join(spark, sliced):
    rows = history(7)
    points = samples(spark, history(8)).drop("value_text")
    for _ in sliced(90, 3600):
        spans = intervals.sessions(samples(spark, rows)).drop("param_id")
        direct = points.alias("p").join(
            spans.alias("s"),
            (F.col("p.instrument_id") == F.col("s.instrument_id"))
            & (F.col("p.time") >= F.col("s.start_time")) & (F.col("p.time") < F.col("s.end_time")),
        ).select("p.instrument_id", "p.time", "s.session_id", "s.start_time")
        tagged = intervals.tag_points(points, spans, ["instrument_id"])
        assert got(tagged, "instrument_id", "time", "session_id", "start_time") == got(direct)


def test_drop_overlapping_equals_pairs(spark, sliced):
    rng = random.Random(9)

    def spans(n, longest):
        return [(k, at(s), at(s + rng.randrange(1, longest))) for k in range(3) for s in rng.sample(range(50_000), n)]

    ivs, blocks = spans(120, 900), spans(60, 1500)
    # touching ends do not overlap
    ivs += [(0, at(60_000), at(60_100)), (0, at(60_200), at(60_300)), (1, at(60_000), None)]
    blocks += [(0, at(60_100), at(60_200))]
    ddl = "instrument_id INT, start_time TIMESTAMP, end_time TIMESTAMP"
    want = [
        (k, s, e) for k, s, e in ivs
        if e is not None and not any(k == bk and s < be and e > bs for bk, bs, be in blocks)
    ]
    for _ in sliced(100, 7200):
        out = intervals.drop_overlapping(spark.createDataFrame(ivs, ddl), spark.createDataFrame(blocks, ddl))
        assert got(out) == got(spark.createDataFrame(want, ddl))

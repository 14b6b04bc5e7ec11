import math
import random

import numpy as np
import pandas as pd
import pytest
from helpers import at, got, samples
from pyspark.sql import functions as F

from fleetsig.operators import quantiles, series, snapshots
from fleetsig.operators import downsample
from fleetsig.operators.downsample import lttb


def reference_lttb(points, n_out):
    """The published algorithm, on one list of (x, y)."""
    n = len(points)
    if n <= n_out:
        return points
    every = (n - 2) / (n_out - 2)
    cut = [math.floor(j * every) + 1 for j in range(n_out - 1)]
    out = [points[0]]
    for j in range(n_out - 2):
        nxt = points[cut[j + 1]:cut[j + 2]] if j + 2 < len(cut) else [points[-1]]
        cx, cy = np.mean([p[0] for p in nxt]), np.mean([p[1] for p in nxt])
        ax, ay = out[-1]
        bucket = points[cut[j]:cut[j + 1]]
        area = [abs((ax - cx) * (y - ay) - (ax - x) * (cy - ay)) for x, y in bucket]
        out.append(bucket[int(np.argmax(area))])
    return out + [points[-1]]


@pytest.mark.parametrize("n_out", [3, 10, 57])
def test_lttb_equals_the_published_algorithm(spark, n_out):
    rng = random.Random(n_out)
    rows, want = [], []
    for key, n in ((1, 900), (2, 400), (3, 12)):
        xs = sorted(rng.sample(range(200_000), n))
        walk = np.cumsum([rng.gauss(0, 1) for _ in xs])
        rows += [(key, 1, x, y) for x, y in zip(xs, walk)]
        want += [(key, float(x), float(y)) for x, y in reference_lttb(list(zip(xs, walk)), n_out)]
    out = lttb(samples(spark, rows), ["instrument_id"], "time", "value_num", n_out)
    assert got(out, "instrument_id", "time", "value_num") == sorted(want, key=repr)


@pytest.mark.parametrize("chunk", [7, 40])
def test_lttb_by_chunks_of_any_size(spark, chunk):
    """Series of several lengths at once; a convex one, whose rows are all corners."""
    rng = random.Random(chunk)
    series = {1: [(x, rng.gauss(0, 1)) for x in range(300)], 2: [(x, float(x * x)) for x in range(230)], 3: [(x, rng.gauss(0, 9)) for x in range(31)]}
    rows = [(k, 1, x, y) for k, points in series.items() for x, y in points]
    out = lttb(samples(spark, rows), ["instrument_id"], "time", "value_num", 30, chunk=chunk)
    want = [(k, float(x), y) for k, points in series.items() for x, y in reference_lttb(points, 30)]
    assert got(out, "instrument_id", "time", "value_num") == sorted(want, key=repr)


def test_lttb_never_gathers_a_convex_series(spark, monkeypatch):
    sizes = spark.sparkContext.accumulator(0)
    walk = downsample._walk

    def counting(key):
        inner = walk(key)

        def choose(pdf):
            sizes.add(1 << 40 if len(pdf) > 5000 else 1)
            return inner(pdf)

        return choose

    monkeypatch.setattr(downsample, "_walk", counting)
    rows = spark.range(30_000).selectExpr("1 AS instrument_id", "timestamp_seconds(id) AS time", "double(id * id) AS value_num")
    out = lttb(rows, ["instrument_id"], "time", "value_num", 60, chunk=3000)
    assert out.count() == 60 and 8 < sizes.value < 1 << 40


def test_lttb_of_a_constant_series(spark):
    out = lttb(samples(spark, [(1, 1, s, 5) for s in range(100)]), ["instrument_id"], "time", "value_num", 10)
    rows = got(out, "time", "value_num")
    assert len(rows) == 10 and {v for _t, v in rows} == {5.0}


def test_exact_quantiles(spark):
    rng = random.Random(1)
    groups = {1: [rng.gauss(0, 1) for _ in range(60_001)], 2: [float(rng.randrange(5)) for _ in range(20_000)], 3: [7.0], 4: [1.0, 2.0]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k INT, v DOUBLE")
    out = quantiles.exact_quantiles(df, ["k"], "v", {"p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0})
    for r in out.collect():
        for name, q in (("p10", 10), ("p50", 50), ("p95", 95), ("p100", 100)):
            assert r[name] == pytest.approx(np.percentile(groups[r["k"]], q), abs=1e-12), (r["k"], name)


def test_bands_and_texts(spark):
    df = spark.createDataFrame([(None,), (20.0,), (21.0,), (28.5,)], "v DOUBLE")
    steps = [(None, "green"), (21, "yellow"), (28, "red")]
    assert [r[0] for r in df.select(series.band(F.col("v"), steps)).collect()] == [None, "green", "yellow", "red"]


def test_share_of_zero_total(spark):
    df = spark.createDataFrame([(1, "a", 0), (1, "b", 0)], "k INT, s STRING, n INT")
    assert {r["percentage"] for r in series.share_of_total(df, ["k"], "s", "n").collect()} == {None}


def test_counter_reset_and_two_users(spark):
    ddl = "collected_at TIMESTAMP, queryid BIGINT, userid BIGINT, calls BIGINT, total_plan_time DOUBLE, " \
          "total_exec_time DOUBLE, blk_read_time DOUBLE, blk_write_time DOUBLE"
    rows = [(at(60 * i), 1, 1, c, 0.0, float(c), 0.0, 0.0) for i, c in enumerate([10, 14, 3, 5])]
    rows += [(at(60 * i + 1), 1, 2, c, 0.0, float(c), 0.0, 0.0) for i, c in enumerate([100, 101])]
    stats = spark.createDataFrame(rows, ddl)
    out = snapshots.activity(stats, at(0), at(3600), 3600)
    assert got(out, "userid", "calls") == [(1, 9), (2, 1)]  # 4 + 3 after the reset + 2
    plain = snapshots.statement_deltas(stats, at(0), at(3600)).where("delta_calls IS NOT NULL")
    assert got(plain, "userid", "delta_calls") == [(1, -11), (1, 2), (1, 4), (2, 1)]


def test_server_log_file(spark, tmp_path):
    plan = '{""Plan"": {""Total Cost"": 12.5, ""Shared Read Blocks"": 3, ""Shared I/O Read Time"": 0.5}}'
    line = "2024-01-01 00:00:01.000 UTC,{user},db,1,,s,{n},,,,,LOG,,\"{msg}\",,,,,,,,,,{backend},,{q}\n"
    vacuum = 'automatic vacuum of table ""db.public.data"": index scans: 2\npages: 7 removed\ntuples: 11 removed, 13 remain\nelapsed: 1.50 s'
    log = tmp_path / "log.csv"
    log.write_text(
        line.format(user="", n=1, msg=vacuum, backend="autovacuum worker", q="")
        + line.format(user="report", n=2, msg=f"duration: 700.25 ms  plan:\n{plan}", backend="client backend", q=42)
        + line.format(user="report", n=3, msg="noise", backend="client backend", q="")
    )
    from fleetsig.sources.tabular import read_server_log

    df = read_server_log(spark, str(log))
    assert df.count() == 3
    runs = snapshots.maintenance_runs(df, "db")
    assert got(runs, "relation", "started_at", "finished_at", "index_scans", "pages_removed", "tuples_removed", "tuples_remain", "wraparound") == [
        ("public.data", 1.0, 2.5, 2, 7, 11, 13, False)
    ]
    plans = snapshots.slow_plans(snapshots.logged_plans(df, "db", "report"))
    assert got(plans, "queryid", "duration", "total_cost", "bytes_read", "io_read_time") == [(42, 700.25, 12.5, 24576, 0.5)]


def test_quantiles_of_small_and_large_groups(spark):
    rng = np.random.default_rng(1)
    sizes = [1, 2, 3, 4, 5, 7, 10, 11, 13, 20, 21, 99, 101, 2000, 9999, 10_001, 15_001, 20_000, 30_011, 150_000]
    groups = [rng.normal(size=n) for n in sizes] + [rng.integers(0, max(2, n // 3), n).astype(float) for n in sizes]
    rows = pd.concat(pd.DataFrame({"g": i, "v": v}) for i, v in enumerate(groups))
    wanted = {"zero": 0.0, "a": 0.05, "b": 0.1, "c": 0.25, "d": 0.5, "e": 0.75, "f": 0.95, "h": 0.99, "one": 1.0}
    out = quantiles.exact_quantiles(spark.createDataFrame(rows), ["g"], "v", wanted).toPandas().set_index("g")
    assert len(out) == len(groups)
    for i, v in enumerate(groups):
        assert out.loc[i, list(wanted)].to_numpy() == pytest.approx(np.quantile(v, list(wanted.values())), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("fit", [20, 400])
def test_quantiles_selected_in_rounds(spark, fit):
    """Groups of any size, ties and a value that is most of its group, where few values may be ordered at once."""
    rng = np.random.default_rng(fit)
    groups = {
        0: rng.normal(size=3000), 1: np.exp(40 * rng.normal(size=2500)), 2: np.r_[np.full(4000, 2.5), rng.normal(size=900)], 3: np.array([7.0]),
        4: np.arange(500.0) % 7, 5: np.array([1.0, 2.0]),
    }
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [(6, None), (0, None), (4, float("nan"))]
    df = spark.createDataFrame(rows, "g INT, v DOUBLE")
    wanted = {"p0": 0.0, "p31": 0.31, "p50": 0.5, "p999": 0.999, "p100": 1.0}
    out = quantiles.exact_quantiles(df, ["g"], "v", wanted, fit=fit).toPandas().set_index("g")
    assert sorted(out.index) == sorted(groups)
    for g, v in groups.items():
        assert out.loc[g, list(wanted)].to_numpy() == pytest.approx(np.quantile(v, list(wanted.values())), rel=1e-12, abs=1e-12)

import random

from helpers import at, got, samples

from fleetsig import schema
from fleetsig.operators import alerts, intervals
from fleetsig.operators.counters import daily_delta
from fleetsig.streaming import aggregates, sessions


def history():
    rng = random.Random(5)
    return [(i, 1, s, rng.randrange(3)) for i in (1, 2, 3) for s in sorted(rng.sample(range(4 * 86_400), 40))]


def feed(spark, folder, rows, parts):
    """The rows as parquet files in time order, one micro-batch each."""
    rows = sorted(rows, key=lambda r: r[2])
    step = -(-len(rows) // parts)
    for n in range(parts):
        yield samples(spark, rows[n * step:(n + 1) * step]).coalesce(1).write.mode("append").parquet(folder)


def test_streamed_sessions_equal_batch_sessions(spark, tmp_path):
    rows = history()
    folder, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    for _ in feed(spark, folder, rows, 3):
        source = spark.readStream.schema(schema.EVENTS).parquet(folder)
        sessions.stream_sessions(spark, source, out, ckpt).awaitTermination()
    want = intervals.sessions(samples(spark, rows)).where("end_time IS NOT NULL")
    cols = ["instrument_id", "session_id", "start_time", "end_time"]
    assert got(spark.read.parquet(out), *cols) == got(want, *cols)


def test_replayed_batch_gives_the_same(spark):
    rows = samples(spark, history()).drop("value_text")
    early, late = rows.where("time < '2024-01-02'"), rows.where("time >= '2024-01-02'")
    _closed, state = sessions.advance(None, early)
    once, after = sessions.advance(state, late)
    again, after2 = sessions.advance(state, late.unionByName(early))  # rows seen before are ignored
    assert got(once) == got(again) and got(after) == got(after2)


def test_daily_aggregate_with_late_rows(spark, tmp_path):
    params = spark.createDataFrame([(i, 1, "AcquisitionJobs") for i in (1, 2, 3)], "instrument_id INT, param_id INT, param_name STRING")
    folder = str(tmp_path / "in")
    signal = {"param_name": "AcquisitionJobs"}
    rows = history()
    late = [(1, 1, 100, 50)]  # within four days of the newest row
    expected = None
    for i, _ in enumerate(feed(spark, folder, rows, 2)):
        if i == 1:
            samples(spark, late).write.mode("append").parquet(folder)
        df = aggregates.daily_delta(spark.readStream.schema(schema.EVENTS).parquet(folder), params, signal)
        name = f"daily_{i}"
        df.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
        expected = name
    full = daily_delta(
        samples(spark, rows + late).join(params, ["instrument_id", "param_id"]), ["instrument_id", "param_name"]
    )
    assert got(spark.table(expected), "day", "instrument_id", "delta") == got(full, "day", "instrument_id", "delta")


def test_duplicates_are_dropped(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = history()[:30]
    samples(spark, rows + rows).write.parquet(folder)
    df = aggregates.deduplicated(spark.readStream.schema(schema.EVENTS).parquet(folder))
    df.writeStream.format("memory").queryName("once").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("once").count() == len(rows)


FILTER = [(1, 1), (2, 1)]


def test_alert_stream_and_batch(spark, tmp_path):
    params = spark.createDataFrame(
        [(i, 1, "EnergyFilterBrick", "EnergyFilterIsAvailable") for i in (1, 2, 3, 4)],
        "instrument_id INT, param_id INT, subsystem STRING, param_name STRING",
    )
    hour = 3600
    rows = [(1, 1, hour, 1), (1, 1, 2 * hour, 0), (2, 1, hour, 0), (2, 1, 2 * hour, 1), (3, 1, -9 * hour, 0), (4, 1, 2 * hour, None)]
    now = at(3 * hour)
    rule = alerts.FILTER_OFF
    batch = alerts.evaluate(rule, samples(spark, rows), now)
    # 3 is older than the look-back, 4 has no number: no row, hence OK
    assert got(batch, "instrument_id", "last_value", "firing") == [(1, 0.0, True), (2, 1.0, False)]
    folder = str(tmp_path / "in")
    for _ in feed(spark, folder, rows, 2):
        pass
    latest = aggregates.last_values(spark.readStream.schema(schema.EVENTS).parquet(folder), params, rule)
    latest.writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).start().awaitTermination()
    assert got(aggregates.firing(spark.table("latest"), rule, now), "instrument_id") == [(1,)]


def test_mutes_and_repeats(spark):
    rows = [(s, sev) for s in (8 * 3600, 5 * 86_400 + 60) for sev in ("critical", "warning", "caution")]
    fired = spark.createDataFrame([(at(s), sev) for s, sev in rows], "time TIMESTAMP, severity STRING")
    muted = {(r["severity"], r["muted"]) for r in alerts.mute(fired).where("time < '2024-01-02'").collect()}
    assert muted == {("critical", False), ("warning", False), ("caution", True)}  # Monday morning
    weekend = {(r["severity"], r["muted"]) for r in alerts.mute(fired).where("time > '2024-01-02'").collect()}
    assert weekend == {("critical", False), ("warning", True), ("caution", True)}  # Saturday
    times = spark.createDataFrame([("a", at(m * 60)) for m in (0, 1, 15, 60, 75, 300, 301)], "rule STRING, time TIMESTAMP")
    kept = alerts.suppress_repeats(times, 3600, ["rule"])
    assert got(kept, "time") == [(0.0,), (18000.0,), (3600.0,)]

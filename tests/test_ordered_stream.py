import random

from helpers import at, got, samples
from test_streaming import history

from fleetsig import schema
from fleetsig.operators import intervals
from fleetsig.streaming import ordered

COLS = ["instrument_id", "param_id", "session_id", "start_time", "end_time"]
FLUSH = (99, 1, 40 * 86_400, 0)  # a sample long after all others lets the watermark pass them


def run(spark, tmp_path, batches, late="4 days", slice_seconds=3600):
    folder, out, rejects, ckpt = (str(tmp_path / n) for n in ("in", "out", "rejects", "ckpt"))
    for rows in batches:
        samples(spark, rows).coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema(schema.EVENTS).parquet(folder)
        ordered.stream_ordered_sessions(spark, source, out, rejects, ckpt, late, slice_seconds).awaitTermination()
    return spark.read.parquet(out), spark.read.parquet(rejects)


def test_shuffled_input_equals_the_batch_result(spark, tmp_path):
    """Samples in any order and repeated, within the allowed delay; missing values; restarts between the batches."""
    rng = random.Random(7)
    rows = [(i, p, s, v if rng.random() > 0.1 else None) for i, p, s, v in history()]
    shuffled = rng.sample(rows, len(rows))
    parts = [shuffled[:50], shuffled[40:], [FLUSH], [FLUSH]]
    found, rejects = run(spark, tmp_path, parts, late="5 days", slice_seconds=7200)
    want = intervals.sessions(samples(spark, rows)).where("end_time IS NOT NULL")
    assert got(found, *COLS) == got(want, *COLS) and want.count() > 20
    assert rejects.count() == 0


def test_too_late_samples_are_counted(spark, tmp_path):
    day = 86_400
    first = [(1, 1, 0, 0), (1, 1, 100, 5), (1, 1, 6 * day, 0), (2, 1, 5 * day, 3)]
    # the watermark stands at two days: the first two are refused, the others are placed between earlier samples
    second = [(1, 1, 50, 7), (2, 1, day, 1), (1, 1, 3 * day, 6), (2, 1, 4 * day, 0)]
    found, rejects = run(spark, tmp_path, [first, second, [FLUSH], [FLUSH]])
    placed = samples(spark, first + second[2:])
    assert got(found, *COLS) == got(intervals.sessions(placed).where("end_time IS NOT NULL"), *COLS)
    assert got(rejects, "instrument_id", "param_id", "time", "value_num") == [(1, 1, 50.0, 7.0), (2, 1, float(day), 1.0)]
    assert got(ordered.reject_counts(rejects)) == [(1, 1, at(50).date(), 1), (2, 1, at(day).date(), 1)]

"""Hand-computed answers for the points that are easy to lose."""

from datetime import date

from helpers import T0, at, got, samples
from pyspark.sql import functions as F

from fleetsig import schema
from fleetsig.functions.convert import numeric_value, text_value, utc_instant
from fleetsig.functions.times import time_bucket, whole
from fleetsig.operators import counters, intervals, series, states
from fleetsig.plans import views

DAY = 86_400
H = 3600 * 1_000_000


def test_first_sample_in_session_and_id_change_and_open_end(spark):
    sig = samples(spark, [(1, 1, 0, 5), (1, 1, 10, 0), (1, 1, 20, 5), (1, 1, 30, 7), (1, 1, 40, 7), (1, 1, 50, 5)])
    assert got(intervals.sessions(sig), "session_id", "start_time", "end_time") == [
        (5, 20.0, 30.0), (5, 50.0, None), (7, 30.0, 50.0),
    ]


def test_single_sample_is_no_session(spark):
    assert got(intervals.sessions(samples(spark, [(1, 1, 0, 3)]))) == []


def test_state_credit_goes_to_the_earlier_sample(spark):
    sig = samples(spark, [(1, 1, 0, 1), (1, 1, 10, 2), (1, 1, 40, 1)])
    assert got(states.state_durations(sig, ["instrument_id"])) == [(1, 1, 10_000_000), (1, 2, 30_000_000)]


def fleet(spark, rows, params, enums=()):
    """params: (param_id, param_name, subsystem, component, enum_id) for instrument 1."""
    cols = "instrument_id INT, param_id INT, param_name STRING, subsystem STRING, component STRING, enum_id INT"
    return views.Fleet(
        samples(spark, rows),
        spark.createDataFrame([(1, "i1", 1, "m", "one", "t", None, None)], schema.INSTRUMENTS),
        spark.createDataFrame([(1, *p) for p in params], cols),
        spark.createDataFrame([], schema.ENUM_TYPES),
        spark.createDataFrame(list(enums), schema.ENUM_VALUES),
    )


EPU = [(1, "EpuSessionID", "EPU", "c", None), (2, "AutomatedAcquisitionState", "EPU", "c", 9)]
STATES = [(9, "Idle", 0), (9, "Running", 1), (9, "Terminated", 2)]


def test_runs_credit_nothing_across_session_edges(spark):
    rows = [(1, 1, 0, 0), (1, 1, 100, 5), (1, 1, 200, 0), (1, 1, 300, 6), (1, 1, 400, 7)]
    # state running from before the session; last sample in the session is Terminated and still counts
    rows += [(1, 2, 50, 1), (1, 2, 120, 1), (1, 2, 150, 2), (1, 2, 310, 0), (1, 2, 320, 1)]
    out = views.epu_runs(fleet(spark, rows, EPU, STATES))
    assert got(out, "session_id", "start_time", "total_micros", "running_micros", "has_terminated") == [
        (5, 100.0, 100_000_000, 30_000_000, True),
    ]


def test_runs_without_terminated_label(spark):
    rows = [(1, 1, 0, 0), (1, 1, 100, 5), (1, 1, 200, 0), (1, 2, 110, 1), (1, 2, 120, 0)]
    out = views.epu_runs(fleet(spark, rows, EPU, STATES[:2]))
    assert got(out, "running_micros", "has_terminated") == [(10_000_000, None)]


def test_running_is_carried_over_days_and_gaps(spark):
    rows = [(1, 2, 22 * 3600, 1), (1, 2, 2 * DAY + 3 * 3600, 0), (1, 2, 2 * DAY + 23 * 3600, 1)]
    f = fleet(spark, rows, EPU, STATES)
    out = views.epu_running_daily(f)
    # day 2 has no sample and no row; day 3 gets 0-3 h from day 1's last state and 23-24 h to its end
    assert got(out, "day", "running_micros") == [(0.0, 2 * H), (2.0 * DAY, 4 * H)]


def test_counter_with_resets(spark):
    rows = [(1, 1, s, v) for s, v in [(0, 3), (10, 4), (20, 1), (30, 1), (40, 2)]]
    tagged = counters.with_previous(samples(spark, rows)).withColumns(
        {"session_id": F.lit(1), "start_time": F.lit(T0)}
    )
    # 4 before the first 1, 1 before the repeated 1, last value 2
    assert got(counters.session_counter(tagged, "reset_to_1"), "total") == [(7.0,)]
    later = tagged.withColumn("start_time", F.lit(at(15)))
    # the predecessor of the first 1 lies before the session
    assert got(counters.session_counter(later.where("time >= start_time"), "reset_to_1"), "total") == [(3.0,)]
    zero = samples(spark, [(1, 1, s, v) for s, v in [(0, 5), (10, 0), (20, 0), (30, 8)]])
    tagged0 = counters.with_previous(zero).withColumns({"session_id": F.lit(1), "start_time": F.lit(T0)})
    assert got(counters.session_counter(tagged0, "reset_to_0"), "total") == [(5.0,)]


def test_missing_counter_gives_zero(spark):
    params = [(1, "SessionId", "Tomography", "c", None), (3, "TemImageCount", "Tomography", "c", None)]
    rows = [(1, 1, 0, 0), (1, 1, 10, 4), (1, 1, 50, 0), (1, 3, 20, 1), (1, 3, 30, 2)]
    out = views.tomo_counters(fleet(spark, rows, params))
    assert got(out, "total_image_counter", "total_ts_counter", "total_sm_counter") == [(2, 0, 0)]


def test_off_period_ends_at_any_sample(spark):
    sig = samples(spark, [(1, 1, 0, 1), (1, 1, 10, 0), (1, 1, 20, 0), (1, 1, 30, 1), (1, 1, 40, 0)])
    assert got(intervals.off_periods(sig), "start_time", "end_time") == [(10.0, 20.0), (20.0, 30.0)]


def test_unknown_states_are_bridged(spark):
    rows = spark.createDataFrame(
        [(1, at(0), "open"), (1, at(10), "unknown"), (1, at(20), "closed")], "instrument_id INT, time TIMESTAMP, state STRING"
    )
    out = intervals.state_intervals(rows, ["open", "closed"])
    assert got(out, "state", "start_time", "end_time") == [("closed", 20.0, None), ("open", 0.0, 20.0)]


def test_interval_ending_at_midnight_has_an_empty_last_day(spark):
    rows = spark.createDataFrame(
        [(1, "open", at(DAY - 60), at(DAY)), (1, "off", at(5), at(5))],
        "instrument_id INT, state STRING, start_time TIMESTAMP, end_time TIMESTAMP",
    )
    split = intervals.split_by_day(rows)
    assert got(intervals.seconds_per_day(split), "day", "seconds") == [(date(2024, 1, 1), 60.0), (date(2024, 1, 2), 0.0)]


def test_rounding_is_half_to_even(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (1.7,)], "v DOUBLE")
    assert [r[0] for r in df.select(whole("v")).collect()] == [2, 4, 2]


def test_buckets_start_on_a_monday(spark):
    df = spark.createDataFrame([(at(3 * DAY),)], "t TIMESTAMP")  # Thursday 2024-01-04
    assert got(df.select(time_bucket("t", 7 * DAY))) == [(0.0,)]  # Monday 2024-01-01


def test_latest_with_unknown_newest_code(spark):
    params = [(1, "FegState", "MdlGunBrick", "c", 9)]
    f = fleet(spark, [(1, 1, 0, 1), (1, 1, 10, 2), (1, 1, 20, 77)], params, STATES)
    modules = {"FEG": [{"param_name": "FegState"}]}
    first = series.latest_decoded(f.data, f.parameters, f.enum_values, modules)
    assert got(first, "name", "value", "time") == [("FEG", "Terminated", 10.0)]
    assert got(series.latest_decoded(f.data, f.parameters, f.enum_values, modules, decode_first=False)) == []


def test_conversion_of_exported_text(spark):
    cases = [
        ("int", "5", 5.0, None), ("int", " 5 ", 5.0, None), ("int", "5.0", None, None), ("int", "", None, None),
        ("float", "1e3", 1000.0, None), ("float", "x", None, None), ("bool", " true ", 1.0, None),
        ("bool", "True", 0.0, None), ("bool", None, None, None), ("bool", "", None, None), ("str", " a ", None, " a "), ("str", "", None, None),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "kind STRING, raw STRING")
    out = df.select(numeric_value(F.col("raw"), F.col("kind")), text_value(F.col("raw"), F.col("kind"))).collect()
    assert [tuple(r) for r in out] == [c[2:] for c in cases]


def test_instants(spark):
    texts = ["2024-01-01T01:00:00.5+01:00", "2024-01-01T00:00:01Z", "nonsense"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    assert [r[0] for r in df.select(utc_instant(F.col("t"))).collect()] == [at(0.5), at(1), None]


def test_two_session_parameters_do_not_mix(spark):
    params = [
        (1, "EpuSessionID", "EPU", "a", None), (11, "EpuSessionID", "EPU", "b", None),
        (3, "CompletedExposuresCount", "EPU", "a", None), (4, "SkippedExposuresCount", "EPU", "a", None),
    ]
    rows = [(1, 1, 0, 0), (1, 1, 10, 5), (1, 1, 100, 0), (1, 11, 0, 0), (1, 11, 40, 6), (1, 11, 60, 0)]
    rows += [(1, 3, 20, 0), (1, 3, 45, 3), (1, 3, 55, 5), (1, 3, 90, 9)]
    out = views.epu_counters(fleet(spark, rows, params))
    assert got(out, "session_id", "total_image_counter") == [(5, 9), (6, 2)]

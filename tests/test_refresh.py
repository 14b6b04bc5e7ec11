from datetime import datetime, timedelta

import pytest
from helpers import at, got

from fleetsig import schema
from fleetsig.plans import refresh
from fleetsig.plans.views import VIEWS
from fleetsig.sources.lake import Lake

PARAMS = [
    (1, "EpuSessionID", "EPU", None), (2, "AutomatedAcquisitionState", "EPU", 9), (3, "CompletedExposuresCount", "EPU", None),
    (4, "SkippedExposuresCount", "EPU", None), (5, "SessionId", "Tomography", None), (6, "TiltSeries", "Tomography", 9),
    (7, "TemImageCount", "Tomography", None), (8, "AcquisitionJobs", "Camera", None), (9, "LoadCartridgeCounter", "Loader", None),
    (10, "NumberOffloadedTerabytes", "Camera", None), (11, "VacuumState", "Vacuum", 10), (12, "Value", "Software", None),
]
ENUMS = [(9, "Idle", 0), (9, "Running", 1), (9, "Terminated", 2), (10, "CryoCycle", 0), (10, "AllVacuumColumnValvesOpened", 1), (10, "odd", 2)]
DAYS = 8


def value(p, n, i):
    if p in (1, 5):
        return (n // 4) % 3
    modulus = {2: 3, 6: 3, 11: 3, 12: 2}.get(p, 11)
    return (n * n * (p + 1) + i * n + n // 3) % modulus


def data(spark, upto=DAYS):
    """Samples every few hours, irregular but fixed."""
    rows = []
    for i in (1, 2):
        for p, *_ in PARAMS:
            for n in range(upto * 6):
                rows.append((at(n * 14_400 + p * 60 + i), i, p, float(value(p, n, i)), None))
    return spark.createDataFrame(rows, schema.EVENTS)


@pytest.fixture
def lake(spark, tmp_path):
    out = Lake(spark, str(tmp_path / "lake"))
    out.replace("instruments", spark.createDataFrame([(i, str(i), i, "m", f"i{i}", "t", None, None) for i in (1, 2)], schema.INSTRUMENTS))
    rows = [(i, p, sub, "Server" if p == 12 else "c", name, name, None, None, enum, "int", None, None, None, None) for i in (1, 2) for p, name, sub, enum in PARAMS]
    out.replace("parameters", spark.createDataFrame(rows, schema.PARAMETERS))
    out.replace("enum_types", spark.createDataFrame([], schema.ENUM_TYPES))
    out.replace("enum_values", spark.createDataFrame(ENUMS, schema.ENUM_VALUES))
    return out


def test_refresh_all_and_window(spark, lake):
    lake.append_events(data(spark, upto=6))
    refresh.refresh_all(lake)
    for name in VIEWS:
        assert lake.view(name).count() > 0, name
    # every stored view equals its direct computation
    fleet = lake.fleet()
    for name in ("epu_runs", "vacuum_state_daily", "tomo_counters"):
        assert got(lake.view(name)) == got(VIEWS[name][0](fleet))

    # two more days arrive, and some late rows of a day inside the window
    late = data(spark, upto=6).where("param_id = 8").selectExpr(
        "time + INTERVAL 5 MINUTES AS time", "instrument_id", "param_id", "value_num + 100 AS value_num", "value_text"
    ).where("date(time) = '2024-01-05'")
    lake.append_events(data(spark).unionByName(late))
    now = datetime(2024, 1, 9, 12)  # window: 5th, 6th and 7th
    for name in refresh.DAILY:
        refresh.refresh_window(lake, name, now)
    fleet = lake.fleet()
    for name in refresh.DAILY:
        full = VIEWS[name][0](fleet).where("day < '2024-01-08'")
        stored = lake.view(name).drop("bucket_day")
        assert got(stored.where("day < '2024-01-08'").drop("durations")) == got(full.drop("durations")), name
        if "durations" not in full.columns:
            assert stored.where("day >= '2024-01-08'").count() == 0, name

    # the live tail completes the stored buckets
    fn = VIEWS["image_counters_daily"][0]
    live = refresh.realtime(lake.view("image_counters_daily").drop("bucket_day"), fleet, fn, datetime(2024, 1, 8).date())
    assert got(live.select(*sorted(live.columns))) == got(fn(fleet).select(*sorted(live.columns)))


def test_window_that_became_empty_is_cleared(spark, lake):
    lake.append_events(data(spark, upto=6))
    refresh.refresh_all(lake, ["image_counters_daily"])
    for i in (1, 2):
        lake.delete_before(i, datetime(2024, 1, 6).date())
    refresh.refresh_window(lake, "image_counters_daily", datetime(2024, 1, 8) + timedelta(hours=3))
    days = {r[0] for r in lake.view("image_counters_daily").select("bucket_day").distinct().collect()}
    assert {str(d) for d in days} == {"2024-01-01", "2024-01-02", "2024-01-03", "2024-01-06"}


def test_second_append_of_the_same_rows_changes_nothing(spark, lake):
    lake.append_events(data(spark, upto=3))
    before = lake.events().count()
    lake.append_events(data(spark, upto=3))
    assert lake.events().count() == before == 2 * 12 * 18

import random
from datetime import date, timedelta

import pytest
from helpers import T0, at, got
from pyspark.sql import functions as F
from test_refresh import DAYS, data, lake  # noqa: F401

from fleetsig import schema
from fleetsig.plans import incremental
from fleetsig.plans.views import VIEWS


def same_as_full(lake, names=incremental.VIEWS_BY_RESUME):
    fleet = lake.fleet()
    for name in names:
        full = VIEWS[name][0](fleet)
        want = got(full)
        assert got(lake.view(name).select(*full.columns)) == want and want, name


def test_new_days_and_a_refresh_that_died(spark, lake, monkeypatch):  # noqa: F811
    lake.append_events(data(spark, upto=5))
    incremental.refresh_changed(lake)  # nothing was stored before
    assert lake.pending_changes() == []
    lake.append_events(data(spark, upto=7))
    lake.append_events(data(spark))
    lake.append_events(data(spark))  # nothing new
    assert len(lake.pending_changes()) == 4
    write = lake.write_view

    def dying(name, *args):
        if name == "epu_counters":
            raise RuntimeError("lost")
        write(name, *args)

    with monkeypatch.context() as patch, pytest.raises(RuntimeError):
        patch.setattr(lake, "write_view", dying)
        incremental.refresh_changed(lake)
    assert incremental.refresh_changed(lake) == list(incremental.VIEWS_BY_RESUME)
    assert lake.pending_changes() == []
    same_as_full(lake)


@pytest.mark.parametrize("seed", [1, 3])
def test_late_rows_of_any_signal(spark, lake, seed):  # noqa: F811
    """Rows held back at random, of one instrument or of few signals, between and before all others; null and idle values."""
    rng = random.Random(seed)
    rows = [tuple(r) for r in data(spark).collect()]
    rows = [r if rng.random() > 0.05 else (*r[:3], rng.choice([None, 0.0]), None) for r in rows]
    late = [r for r in rows if rng.random() < 0.06 and (seed != 3 or r[2] in (1, 11, 12))]
    first = [r for r in rows if r not in late]
    late += [(T0 - timedelta(days=1, minutes=p), 2, p, 1.0, None) for p in (1, 5, 11, 12)] if seed == 1 else []
    lake.append_events(spark.createDataFrame(first, schema.EVENTS))
    incremental.refresh_changed(lake)
    lake.append_events(spark.createDataFrame(late, schema.EVENTS))
    incremental.refresh_changed(lake)
    same_as_full(lake)


def test_deleted_events_and_instruments(spark, lake):  # noqa: F811
    lake.append_events(data(spark))
    incremental.refresh_changed(lake)
    lake.delete_before(1, date(2024, 1, 4))
    lake.delete_events((F.col("param_id") == 12) & F.col("time").between(F.lit(at(2 * 86_400)), F.lit(at(5 * 86_400))))
    incremental.refresh_changed(lake)
    same_as_full(lake)
    lake.delete_instrument(2)
    incremental.refresh_changed(lake)
    assert {r[0] for r in lake.view("epu_sessions").select("instrument_id").distinct().collect()} == {1}


def test_old_days_are_not_read(spark, lake):  # noqa: F811
    lake.append_events(data(spark, upto=6))
    lake.forget_changes(lake.pending_changes())
    lake.append_events(data(spark))
    fleet = lake.fleet()
    since = incremental.changed(fleet, lake.changes(lake.pending_changes()), incremental.S.EPU_STATE)
    resume = incremental.resumed(since, incremental.last_before(fleet.signal(incremental.S.EPU_STATE), since))
    rows = incremental.from_resume(fleet.data, resume)
    assert rows.agg(F.min("day")).first()[0] >= date(2024, 1, 6)
    # the oldest resume point is a filter on the partitions of the scan, not only on rows
    scan = next(x for x in rows._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in x and "day#" in x)
    assert "day#" in scan.split("PartitionFilters")[1].split("PushedFilters")[0] and "ubquery" in scan

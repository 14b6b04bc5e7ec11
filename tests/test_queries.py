"""Some registered queries against their SQL on the smallest tables; tools/check.py compares all of them."""

import os
import sys
from pathlib import Path

import pytest

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

NAMES = [
    "an01_epu_sessions", "an06_tag_points", "an08_tomo_runs", "an12_tomo_running_daily", "an16_tomo_counters", "an26_state_seconds_per_day",
    "dq02_occupancy_share", "dq11_enum_catalogue", "dq18_status_table", "dq22_family_pressure", "dq27_reducers", "io07_registry", "io09_csv_events", "io17_csv_export", "io01_xml_events", "io01_xml_files", "io16_server_log",
    "io13_typed_properties", "im02_windowed_refresh", "md01_instrument_get_or_create", "md06_parameter_history",
    "ue04_incremental_errors", "cs02_runtime_percentiles_exact", "cs06_cache_hits", "cs11_plan_log", "al04_repeat_interval",
]


@pytest.fixture(scope="module")
def tables():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, tables, name):
    import __spark_entry__ as entry
    from check import rows

    df = entry.queries()[name](spark, SF_DIR)
    cursor = tables.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(cursor.fetchall(), columns)


def test_entry_and_catalogue(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    from fleetsig.plans.registry import ORACLES, QUERIES

    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())

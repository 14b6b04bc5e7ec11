"""Alarm import by increments: one partition per server, pushed marks, errors appended by month."""

import json
import os

import pytest
from helpers import at, got
from pyspark.sql import functions as F

from fleetsig import schema
from fleetsig.__main__ import import_alarms, parser, remote_alarms
from fleetsig.sources import alarm_store
from fleetsig.sources.lake import Lake

# a DB-API module over JSON files that notes each statement it is asked
DRIVER = '''
import json, os, re, uuid
from datetime import datetime
paramstyle = "qmark"
class connect:
    def __init__(self, url, user=None):
        assert user == "u"
        self.url = url
    def cursor(self):
        return self
    def close(self):
        pass
    def execute(self, query, params=()):
        with open(f"{self.url}/asked-{uuid.uuid4().hex}", "w") as out:
            json.dump([query, [str(p) for p in params]], out)
        columns, table = re.match(r"SELECT (.*) FROM (\\w+)", query).groups()
        rows = json.load(open(f"{self.url}/{table}.json"))
        mark = re.search(r"WHERE (\\w+) >", query)
        typed = lambda c, v: datetime.fromisoformat(v) if c == "ErrorDtm" else v
        rows = [{c: typed(c, v) for c, v in r.items()} for r in rows]
        self.rows = [tuple(r[c] for c in columns.split(", ")) for r in rows if not mark or r[mark[1]] > params[0]]
    def fetchmany(self, n):
        taken, self.rows = self.rows[:n], self.rows[n:]
        return taken
'''


def instruments(spark, lake, servers):
    lake.replace("instruments", spark.createDataFrame(
        [(i, str(i), i, "m", "n", "t", s, None) for i, s in servers.items()], schema.INSTRUMENTS
    ))


def definition(n, device=1):
    return dict(zip(schema.ALARM_DEFINITIONS.fieldNames(), (n, 1, "S", 1, "T", device, f"D{device}", 1, "E")))


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_servers_are_asked_for_what_is_new(spark, tmp_path):
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "filedb.py").write_text(DRIVER)
    spark.sparkContext.addPyFile(str(tmp_path / "lib" / "filedb.py"))
    lake = Lake(spark, str(tmp_path / "lake"))
    instruments(spark, lake, {1: "s1", 2: "s2", 3: None})

    def put(server, table, rows):
        os.makedirs(tmp_path / server, exist_ok=True)
        (tmp_path / server / f"{table}.json").write_text(json.dumps(rows))

    def note(day, code, text):
        return {"ErrorDtm": f"2024-01-{day:02d}T10:00:00.000250", "ErrorDefinitionID": code, "MessageText": text}

    def asked(server):
        found = [p for p in (tmp_path / server).iterdir() if p.name.startswith("asked-")]
        return sorted(params for p in found for params in json.loads(p.read_text())[1])

    args = parser().parse_args([
        "--lake", lake.root, "import-alarms", "--url", f"{tmp_path}/{{server}}", "--module", "filedb", "--user", "u",
        "--definitions", "defs", "--notifications", "notes",
    ])
    for s in ("s1", "s2"):
        put(s, "defs", [definition(1), definition(2)])
    put("s1", "notes", [note(1, 1, "a"), note(1, 1, "a"), note(2, 2, "b"), note(3, 99, "unknown")])
    put("s2", "notes", [])
    alarm_store.import_alarms(lake, remote_alarms(spark, args))
    errors = lake.errors().select(F.date_format("Time", "dd HH:mm:ss.SSSSSS"), "InstrumentID", "ErrorID", "MessageText")
    assert got(errors) == [("01 10:00:00.000250", 1, 1, "a"), ("02 10:00:00.000250", 1, 2, "b")]
    assert asked("s1") == [] and lake.read("alarms/device_instance").count() == 1
    before = files(f"{lake.root}/alarms/error_months")

    put("s1", "defs", [definition(1), definition(3, device=2)])
    put("s1", "notes", [note(1, 2, "late"), note(2, 2, "b"), note(4, 3, "c")])
    put("s2", "notes", [note(1, 1, "first")])
    alarm_store.import_alarms(lake, remote_alarms(spark, args))
    assert got(lake.errors(), "InstrumentID", "MessageText") == [(1, "a"), (1, "b"), (1, "c"), (2, "first")]
    assert asked("s1") == ["2", "2024-01-02 10:00:00.000250"] and asked("s2") == ["2"]
    after = files(f"{lake.root}/alarms/error_months")
    assert len(after) > len(before) and before.items() <= after.items()
    assert lake.read("alarms/device_instance").count() == 2


def test_cut_short_imports_deletions_and_old_stores(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    instruments(spark, lake, {1: "s1", 2: "s2"})
    old = [(at(0), 1, 1, "old"), (at(90_000), 2, 1, "kept")]
    lake.replace("alarms/errors", spark.createDataFrame(old, "Time TIMESTAMP, InstrumentID INT, ErrorID INT, MessageText STRING"))
    notes = [(at(0), 1, "again"), (at(10), 1, "new"), (at(10), 1, "new")]

    def source(server, kind):
        if kind == "definitions":
            return spark.createDataFrame([tuple(definition(1).values())], schema.ALARM_DEFINITIONS)
        return spark.createDataFrame(notes if server == "s1" else [], schema.ALARM_NOTIFICATIONS)

    real, lake.move_marks = lake.move_marks, lambda moved: 1 / 0
    with pytest.raises(ZeroDivisionError):
        import_alarms(lake, source)
    lake.move_marks = real
    want = sorted([(1, "new"), (1, "old"), (2, "kept")])
    lake.replace("alarms/marks", spark.createDataFrame([], "instrument_id INT, mark TIMESTAMP"))
    notes.append((at(20), 1, "newer"))
    notes.remove((at(0), 1, "again"))
    import_alarms(lake, source)
    assert got(lake.errors(), "InstrumentID", "MessageText") == sorted([*want, (1, "newer")])
    assert got(lake.alarm_marks()) == [(1, 20.0)]

    lake.delete_errors((F.col("InstrumentID") == 1) & (F.col("MessageText") == "newer"), 1)
    assert got(lake.errors(), "InstrumentID", "MessageText") == want
    assert got(lake.alarm_marks()) == [(1, 10.0)]
    lake.delete_errors(F.col("InstrumentID") == 1, 1)
    assert got(lake.errors()) == [(90_000.0, 2, 1, "kept")] and lake.alarm_marks().count() == 0

"""Import of exports into the stored tables, end to end."""

import gzip
import json
import os
from datetime import date, datetime

import pytest
from helpers import at, got
from pyspark.sql import functions as F

from fleetsig import schema
from fleetsig.__main__ import import_alarms, main
from fleetsig.sources import ingest, tabular, xml_export
from fleetsig.sources.lake import Lake

REGISTRY = [
    {"instrument": "9999, Test", "serial": 9999, "model": "M", "name": "Test 1", "type": "tem", "template": "t", "server": "10.0.0.1"},
    {"instrument": "8888, Other", "serial": 8888, "model": "M", "name": "Other", "type": "sem", "template": "t", "server": None},
]


def export(instrument="9999, Test", closed=4, limit="273.15", values=None, extra=""):
    values = values if values is not None else {
        1: [("2024-01-01T10:00:00.250Z", "5"), ("2024-01-01T12:00:00+01:00", "7"), ("2024-01-01T11:30:00Z", "x")],
        2: [("2024-01-01T10:00:00Z", "21.5"), ("2024-01-02T00:00:00+01:00", "nan?")],
        3: [("2024-01-02T08:00:00Z", " true "), ("2024-01-02T09:00:00Z", "false"), ("2024-01-02T10:00:00Z", "")],
        4: [("2024-01-02T10:00:00Z", "hello"), ("2024-01-02T11:00:00Z", "")],
        5: [("2024-01-02T10:00:00Z", "odd type")],
        77: [("2024-01-02T10:00:00Z", "1")],
    }
    data = "".join(
        f'<ValueData ParameterID="{p}"><ParameterValues>'
        + "".join(f'<ParameterValue Timestamp="{t}"><Value>{v}</Value></ParameterValue>' for t, v in vs)
        + "</ParameterValues></ValueData>"
        for p, vs in values.items()
    )

    def param(i, name, kind, more=""):
        return f'<Parameter ID="{i}" Name="{name}" DisplayName="{name} d" DisplayUnit="" StorageUnit="K" Type="{kind}" EventID="{i}" EventName="e" {more}/>'

    return f"""<?xml version="1.0" encoding="utf-8"?>
<Export xmlns="urn:export">
 <Enumerations>
  <Enumeration Name="Valve" Instrument="{instrument}"><Literal Name="Open"> 3 </Literal><Literal Name="Closed">{closed}</Literal></Enumeration>
  <Enumeration Name="Mode" Instrument="{instrument}"><Literal Name="Auto">1</Literal></Enumeration>
 </Enumerations>
 <Instruments><Instrument Name="{instrument}"><Component Name="Vacuum"><Component Name="Gun">
  {param(1, "ValveState", "Int", 'EnumerationName="Valve"')}
  {param(2, "Temperature", "Float", f'AbsoluteMinimum="0" AbsoluteMaximum="{limit}"')}
  {param(3, "Ready", "Boolean")}{param(4, "Message", "String")}{param(5, "Odd", "Complex", 'EnumerationName="Missing"')}{extra}
 </Component></Component></Instrument>
 <Instrument Name="second"><Component Name="X"><Component Name="Y">{param(90, "Ignored", "Int")}</Component></Component></Instrument></Instruments>
 <Values Start="2024-01-01T00:00:00Z" End="2024-01-03T00:00:00Z">{data}</Values>
</Export>"""


@pytest.fixture
def registry(spark, tmp_path):
    path = tmp_path / "instruments.json"
    path.write_text(json.dumps(REGISTRY))
    return tabular.read_registry(spark, str(path))


@pytest.fixture
def lake(spark, tmp_path):
    return Lake(spark, str(tmp_path / "lake"))


EVENTS = [
    (1, 11 * 3600.0, 7.0, None), (1, 36000.25, 5.0, None), (2, 36000.0, 21.5, None),
    (3, 86400 + 8 * 3600.0, 1.0, None), (3, 86400 + 9 * 3600.0, 0.0, None),
    (4, 86400 + 36000.0, None, "hello"), (5, 86400 + 36000.0, None, "odd type"),
]


def test_import_upsert_history_and_repeat(spark, tmp_path, registry, lake):
    first = tmp_path / "in" / "9999_data.xml"
    first.parent.mkdir()
    first.write_text(export())
    result = ingest.import_files(spark, [str(first)], registry, lake)
    assert got(lake.events(), "param_id", "time", "value_num", "value_text") == sorted(EVENTS, key=repr)
    assert got(result.rejects, "param_id", "reason", "rejected") == sorted(
        [(77, "unknown parameter", 1), (1, "value", 1), (2, "value", 1)], key=repr
    )
    f = lake.fleet()
    assert got(f.instruments, "id", "instrument", "serial") == [(1, "9999, Test", 9999)]
    names = f.enum_types.select("id", "name").join(f.enum_values, F.col("id") == F.col("enum_id"))
    assert got(names, "name", "member_name", "value") == [("Mode", "Auto", 1), ("Valve", "Closed", 4), ("Valve", "Open", 3)]
    assert got(f.parameters.where("param_id = 2"), "subsystem", "component", "display_unit", "storage_unit", "value_type", "abs_min", "abs_max") == [
        ("Vacuum", "Gun", None, "K", "float", 0.0, 273.15)
    ]
    assert f.parameters.count() == 5  # nothing of the second instrument
    assert f.parameters.where("enum_id IS NOT NULL").count() == 1

    # gzipped export with one changed label, one changed limit and one new value
    again = tmp_path / "in" / "9999_b_data.xml.gz"
    values = {1: [("2024-01-01T10:00:00.250Z", "5"), ("2024-01-03T10:00:00Z", "6")]}
    with gzip.open(again, "wt") as out:
        out.write(export(closed=99, limit="250.5", values=values))
    ingest.import_files(spark, [str(again)], registry, lake)
    assert lake.events().count() == len(EVENTS) + 1
    assert got(lake.read("enum_values").where("member_name = 'Closed'"), "value") == [(99,)]
    assert got(lake.spark.read.parquet(lake.path("enum_values_history")), "member_name", "value") == [("Closed", 4)]
    assert got(lake.spark.read.parquet(lake.path("parameters_history")), "param_id", "abs_max") == [(2, 273.15)]
    assert got(lake.read("parameters").where("param_id = 2"), "abs_max") == [(250.5,)]

    # a repeated import is a no-op
    before = got(lake.events())
    ingest.import_files(spark, [str(first.parent / "9999_b_data.xml.gz")], registry, lake)
    assert got(lake.events()) == before
    assert lake.spark.read.parquet(lake.path("parameters_history")).count() == 1
    assert lake.read("instruments").count() == 1


def test_several_files_and_bad_files(spark, tmp_path, registry, lake):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a_data.xml").write_text(export())
    (folder / "b_data.xml").write_text(export("8888, Other", values={2: [("2024-01-01T00:00:00Z", "1.5")]}))
    (folder / "c_data.xml").write_text("this is no export")
    (folder / "d_data.xml").write_text(export("7777, Unregistered"))
    paths = [str(p) for p in sorted(folder.iterdir())]
    with pytest.raises(ValueError, match="d_data"):
        ingest.import_files(spark, paths, registry, lake)
    result = ingest.import_files(spark, paths, registry, lake, strict=False)
    assert [os.path.basename(p) for p in sorted(result.skipped)] == ["c_data.xml", "d_data.xml"]
    by_name = lake.events().join(lake.read("instruments").select(F.col("id").alias("instrument_id"), "name"), "instrument_id")
    assert got(by_name.groupBy("name").count()) == [("Other", 1), ("Test 1", len(EVENTS))]


def outcomes(lake):
    rows = lake.log("import_outcomes", ingest.OUTCOMES).collect()
    return sorted((os.path.basename(r.path), r.status, r.accepted, r.rejected, r.malformed) for r in rows)


def test_one_bad_element_costs_only_itself(spark, tmp_path, registry, lake):
    file = tmp_path / "9999_data.xml"
    file.write_text(export().replace("<Value>nan?</Value>", "<Value>nan?</Vale>").replace('<Literal Name="Auto">1', "<Literal Name='Auto>1"))
    result = ingest.import_files(spark, [str(file)], registry, lake)
    assert got(lake.events(), "param_id", "time", "value_num", "value_text") == sorted(EVENTS, key=repr)
    assert got(result.rejects.where("reason = 'malformed'"), "rejected") == [(2,)]
    assert got(result.counts, "accepted", "rejected", "malformed") == [(len(EVENTS), 2, 2)]


def test_broken_and_early_files_are_tried_again(spark, tmp_path, registry, lake):
    folder = tmp_path / "in"
    folder.mkdir()
    whole = gzip.compress(export(values={2: [(f"2024-01-01T10:{i // 60:02d}:{i % 60:02d}Z", f"{i * i % 977}.5") for i in range(2000)]}).encode())
    (folder / "a_data.xml.gz").write_bytes(whole[: len(whole) * 2 // 3])
    (folder / "b_data.xml").write_text(export())
    (folder / "c_data.xml").write_text(export("7777, Later"))
    assert [os.path.basename(p) for p in ingest.poll(spark, str(folder), registry, lake)] == ["b_data.xml"]
    assert outcomes(lake) == [("a_data.xml.gz", "failed", 0, 0, 0), ("b_data.xml", "done", len(EVENTS), 3, 0), ("c_data.xml", "skipped", 0, 0, 0)]
    (folder / "a_data.xml.gz").write_bytes(whole)
    settings = tmp_path / "more.json"
    settings.write_text(json.dumps([*REGISTRY, {**REGISTRY[0], "instrument": "7777, Later", "serial": 7777}]))
    again = ingest.poll(spark, str(folder), tabular.read_registry(spark, str(settings)), lake)
    assert sorted(map(os.path.basename, again)) == ["a_data.xml.gz", "c_data.xml"]
    assert ingest.poll(spark, str(folder), registry, lake) == []


def test_watch_takes_overwritten_files_and_waits_for_growing_ones(spark, tmp_path, registry, lake, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a_data.xml").write_text(export())
    growing = folder / "b_data.xml"
    growing.write_text(export()[:500])
    seen = []

    def nap(_seconds):
        """What happens while the watch sleeps: settling, then the pause between rounds."""
        seen.append([r[1] for r in outcomes(lake)])
        if len(seen) == 1:
            growing.write_text(export("8888, Other", values={2: [("2024-01-01T00:00:00Z", "1.5")]}))
        if len(seen) == 2:
            (folder / "a_data.xml").write_text(export(values={2: [("2024-01-05T10:00:00Z", "3.5")]}))
            os.utime(folder / "a_data.xml", (2_000_000_000, 2_000_000_000))

    monkeypatch.setattr(ingest, "pause", nap)
    ingest.watch(spark, str(folder), lambda: registry, lake, rounds=2)
    assert seen == [[], ["done"], ["done"]]
    assert [r[:2] for r in outcomes(lake)] == [("a_data.xml", "done"), ("a_data.xml", "done"), ("b_data.xml", "done")]
    assert lake.events().count() == len(EVENTS) + 2


def test_versions_compaction_and_cascade(spark, tmp_path, registry, lake):
    for i in range(4):
        file = tmp_path / f"{i}_data.xml"
        file.write_text(export(closed=i, limit=str(i), values={2: [(f"2024-01-01T10:00:0{i}Z", "1.5")]}))
        if i == 1:
            held = lake.fleet()
        ingest.import_files(spark, [str(file)], registry, lake)
    assert got(held.parameters.where("param_id = 2"), "abs_max") == [(0.0,)]
    day = tmp_path / "lake" / "data" / "day=2024-01-01"
    assert len(list(day.glob("*.parquet"))) == 4
    spark.conf.set("spark.sql.adaptive.enabled", "true")  # small partitions are merged by it
    lake.compact()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    assert len(list(day.glob("*.parquet"))) == 1 and lake.events().count() == 4
    assert lake.vacuum() == [] and lake.vacuum(0)
    assert got(lake.read("parameters").where("param_id = 2"), "abs_max") == [(3.0,)]
    lake.append("imported_files", spark.createDataFrame([(f"file:{tmp_path}/3_data.xml", at(0)), ("other", at(0))], ingest.FILE_LOG))
    lake.delete_instrument(1)
    assert lake.spark.read.parquet(lake.path("parameters_history")).count() == 0
    assert lake.spark.read.parquet(lake.path("enum_values_history")).count() == 0
    assert lake.log("imported_files", ingest.FILE_LOG).count() == 1


def test_poll_sees_overwritten_files(spark, tmp_path, registry, lake):
    folder = tmp_path / "in"
    folder.mkdir()
    file = folder / "9999_data.xml"
    file.write_text(export())
    assert len(ingest.poll(spark, str(folder), registry, lake)) == 1
    assert ingest.poll(spark, str(folder), registry, lake) == []
    file.write_text(export(values={2: [("2024-01-05T10:00:00Z", "3.5")]}))
    os.utime(file, (2_000_000_000, 2_000_000_000))
    assert len(ingest.poll(spark, str(folder), registry, lake)) == 1
    assert lake.events().count() == len(EVENTS) + 1


def test_stream_of_files(spark, tmp_path, registry, lake):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "9999_data.xml").write_text(export())
    (folder / "bad_data.xml").write_text("<broken")
    (folder / "ignored.txt").write_text("x")
    ckpt = str(tmp_path / "ckpt")
    ingest.stream(spark, str(folder), registry, lake, ckpt, available_now=True).awaitTermination()
    assert lake.events().count() == len(EVENTS)
    with gzip.open(folder / "9999_2_data.xml.gz", "wt") as out:
        out.write(export(values={2: [("2024-01-05T10:00:00Z", "3.5")]}))
    ingest.stream(spark, str(folder), registry, lake, ckpt, available_now=True).awaitTermination()
    assert lake.events().count() == len(EVENTS) + 1


def test_delete(spark, tmp_path, lake):
    rows = [(at(s), i, 1, float(s), None) for i in (1, 2) for s in (0, 86_400, 2 * 86_400)] + [(at(5 * 86_400), 2, 1, 1.0, None)]
    lake.append_events(spark.createDataFrame(rows, schema.EVENTS))
    lake.replace("instruments", spark.createDataFrame([(i, str(i), i, "m", "n", "t", None, None) for i in (1, 2)], schema.INSTRUMENTS))
    lake.replace("enum_types", spark.createDataFrame([(10, 1, "a"), (20, 2, "b")], schema.ENUM_TYPES))
    lake.replace("enum_values", spark.createDataFrame([(10, "x", 1), (20, "y", 1)], schema.ENUM_VALUES))
    lake.delete_before(2, date(2024, 1, 2))
    assert got(lake.events(), "instrument_id", "time") == [
        (1, 0.0), (1, 172800.0), (1, 86400.0), (2, 172800.0), (2, 432000.0), (2, 86400.0)
    ]
    lake.delete_instrument(2)
    assert got(lake.events().groupBy("instrument_id").count()) == [(1, 3)]
    assert not (tmp_path / "lake" / "data" / "day=2024-01-06").exists()
    assert got(lake.read("enum_values"), "enum_id") == [(10,)]
    assert got(lake.read("instruments"), "id") == [(1,)]
    assert not list((tmp_path / "lake" / "_staging").iterdir())


def test_csv_events_and_export(spark, tmp_path):
    src = tmp_path / "events.csv"
    src.write_text("2024-01-01 00:00:00.250+00:00,1,2,3.5,\n2024-01-01 00:00:01+00:00,1,3,,text\n")
    rows = tabular.read_events_csv(spark, str(src))
    assert got(rows) == [(0.25, 1, 2, 3.5, None), (1.0, 1, 3, None, "text")]
    tabular.export_csv(rows.select("param_id", "value_num"), str(tmp_path / "out"))
    assert got(spark.read.csv(str(tmp_path / "out"), header=True)) == [("2", "3.5"), ("3", None)]


def test_registry_refuses_unknown_types(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text(json.dumps([{**REGISTRY[0], "type": "xyz"}]))
    with pytest.raises(Exception, match="not recognized"):
        tabular.read_registry(spark, str(path)).collect()


def test_config_enums(spark):
    xml = '<c xmlns:nil="x"><Instrument><P><Parm ID="3" Enum="A"/><Parm ID="4"/></P></Instrument><G><Enum Name="A"><Value Name="on" ID="1"/></Enum></G></c>'
    params, members = xml_export.enums_from_config(spark.createDataFrame([(xml,), (xml,)], "config STRING"))
    assert got(params) == [(3, "A")]
    assert got(members) == [("A", "on", 1)]


def test_alarms_of_all_servers(spark, lake):
    lake.replace("instruments", spark.createDataFrame(
        [(1, "a", 1, "m", "n", "t", "s1", None), (2, "b", 2, "m", "n", "t", "s2", None), (3, "c", 3, "m", "n", "t", None, None)],
        schema.INSTRUMENTS,
    ))
    defs = [(1, 1, "S", 1, "T", 1, "D", 1, "E"), (2, 1, "S", 1, "T", 2, "D2", 1, "E")]
    notes = {
        "s1": [(at(10), 1, "m"), (at(10), 1, "m"), (at(20), 2, "n"), (at(30), 99, "unknown definition")],
        "s2": [(at(5), 1, "k")],
    }

    def source(server, kind):
        if kind == "definitions":
            return spark.createDataFrame(defs, schema.ALARM_DEFINITIONS)
        return spark.createDataFrame(notes[server], schema.ALARM_NOTIFICATIONS)

    import_alarms(lake, source)
    want = [(5.0, 2, 1, "k"), (10.0, 1, 1, "m"), (20.0, 1, 2, "n")]
    assert got(lake.read("alarms/errors")) == sorted(want, key=repr)
    # only later ones are taken, per instrument
    notes["s1"] += [(at(15), 1, "late"), (at(40), 1, "new")]
    notes["s2"] += [(at(6), 2, "new too")]
    import_alarms(lake, source)
    assert got(lake.read("alarms/errors")) == sorted(want + [(40.0, 1, 1, "new"), (6.0, 2, 2, "new too")], key=repr)
    assert lake.read("alarms/device_instance").count() == 2
    lake.delete_before(1, date(2024, 1, 2))
    assert got(lake.read("alarms/errors").select("InstrumentID").distinct()) == [(2,)]


def test_command_line(spark, tmp_path, registry):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "9999_data.xml").write_text(export())
    root = str(tmp_path / "lake2")
    settings = str(tmp_path / "instruments.json")
    main(["--lake", root, "import", "-i", str(folder / "9999_data.xml"), "-s", settings])
    assert Lake(spark, root).events().count() == len(EVENTS)
    main(["--lake", root, "create-stats"])
    main(["--lake", root, "watch", "--once", "-i", str(folder), "-s", settings])
    main(["--lake", root, "clean-inst", "-i", "1", "--date", "02-01-2024"])
    assert got(Lake(spark, root).events().select(F.min("time"))) == [(86400 + 8 * 3600.0,)]
    main(["--lake", root, "clean-inst", "-i", "1"])
    assert Lake(spark, root).events().count() == 0

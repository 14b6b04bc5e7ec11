"""Files cut into blocks at any byte read as if they were read whole."""

import random

import pytest
from helpers import got
from pyspark.sql import functions as F

from fleetsig import schema
from fleetsig.sources import tabular, xml_export
from fleetsig.sources.pieces import BLOCK, carry_last, quoted_records, read_pieces, written

MAX_BYTES = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def block_size(spark):
    def sizes(*lengths):
        for n in lengths:
            spark.conf.set(MAX_BYTES, str(n))
            yield n
        spark.conf.unset(MAX_BYTES)

    yield sizes
    spark.conf.unset(MAX_BYTES)


def xml_file(rng, n):
    """An export's values: long and empty elements, escapes, empty values, umlauts, line breaks."""
    texts = ["5", " true ", "a &amp; b", "&lt;x&gt;", "", "Grüße", "two\nlines", "1e-3", "x" * 300]
    parts, at = ['<?xml version="1.0"?>\n<Export><Values>'], 0
    for p in range(n):
        size = rng.choice([0, 1, 3, 20, 60 if p % 5 == 0 else 2])
        parts.append(f'<ValueData ParameterID="{p * 7 % 11}">' if p % 3 else f'\n <ValueData  Unit="u" ParameterID=\'{p * 7 % 11}\' >')
        parts.append("<ParameterValues>" if size else "<ParameterValues/>")
        for _ in range(size):
            at += 1
            value = rng.choice(texts)
            body = f"<Value>{value}</Value>" if value or at % 2 else "<Value/>"
            parts.append(f'{" " * (at % 3)}<ParameterValue Timestamp="t{at}">{body}</ParameterValue>')
        parts.append("</ParameterValues></ValueData>" if size else "</ValueData>")
    return "".join([*parts, "</Values></Export>"])


def test_xml_values_equal_whole_elements(spark, tmp_path, block_size):
    for seed in (1, 2):
        (tmp_path / f"{seed}_data.xml").write_text(xml_file(random.Random(seed), 20))
    path = str(tmp_path)
    want = got(xml_export.explode_values(xml_export.read_value_data(spark, path)), "param_id", "time_text", "raw")
    assert len(want) > 100
    for size in block_size(401, 5003, 10**8):
        pieces = written(xml_export.value_pieces(spark, path))
        if size == 401:
            assert pieces.select(BLOCK).distinct().count() > 10
        assert got(xml_export.values_of_pieces(pieces), "param_id", "time_text", "raw") == want
        assert xml_export.lost_values(pieces).count() == 0


def test_broken_xml_values_cost_only_themselves(spark, tmp_path, block_size):
    def one(t, body):
        return f'<ParameterValue Timestamp="{t}">{body}</ParameterValue>'

    text = (
        '<V><ValueData ParameterID="1"><ParameterValues>' + one("a", "<Value>1</Value>") + one("b", "<Value>2</Vale>")
        + one("c", "<Value>3</Value>") + '<ParameterValue Timestamp="d"><Value>4</Value>' + one("e", "<Value>5</Value>")
        + '</ParameterValues></ValueData><ValueData><ParameterValues>' + one("f", "<Value>6</Value>")
        + '</ParameterValues></ValueData><ValueData ParameterID="2"><ParameterValues>' + one("g", "<Value>7</Value>")
        + '<ParameterValue Timestamp="h"><Value>8'
    )
    (tmp_path / "x_data.xml").write_text(text)
    for _ in block_size(60, 10**8):
        pieces = written(xml_export.value_pieces(spark, str(tmp_path)))
        values = got(xml_export.values_of_pieces(pieces), "param_id", "time_text", "raw")
        assert values == sorted([(1, "a", "1"), (1, "c", "3"), (1, "e", "5"), (None, "f", "6"), (2, "g", "7")], key=repr)
        # b is malformed, d has no end, h is cut off
        assert got(xml_export.lost_values(pieces), "malformed") == [(3,)]


def log_text(rng, n, end="\n"):
    lines = []
    for i in range(n):
        message = rng.choice(["noise", 'a ""quoted"" word', f"plan:\n{{\n  \"\"k\"\": {i}\n}}", "one\n\n\ntwo", ",,\n,", "", "ü\n" * rng.choice([1, 50])])
        lines.append(f'2024-01-01 00:00:{i % 60:02d}.000 UTC,"u{i}",db,{i},,s,{i},,,,,LOG,,"{message}",,,,,,,,,,backend,,{i}{end}')
        if i % 17 == 0:
            lines.append(end)
    return "".join(lines)


def test_log_of_many_blocks_equals_a_whole_read(spark, tmp_path, block_size):
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text(log_text(random.Random(name), 60))
    path = str(tmp_path)
    want = got(spark.read.csv(path, schema=schema.SERVER_LOG, multiLine=True, quote='"', escape='"'))
    assert len(want) == 120
    for size in block_size(257, 2003, 10**8):
        lines = read_pieces(spark, path, "\n")
        if size == 257:
            assert lines.select(BLOCK).distinct().count() > 15
        assert got(tabular.read_server_log(spark, path)) == want


def test_carriage_returns_open_quotes_and_empty_files(spark, tmp_path, block_size):
    (tmp_path / "a.csv").write_text('1,"x\r\ny"\r\n2,z\r\n3,"open\nto the end\n4,w\n', newline="")
    (tmp_path / "b.csv").write_text("")
    for _ in block_size(5, 10**8):
        lines = written(read_pieces(spark, str(tmp_path), "\n"))
        assert got(quoted_records(lines), "record") == sorted([('1,"x\r\ny"',), ("2,z",), ('3,"open\nto the end\n4,w',)], key=repr)


def test_carry_over_blocks_without_a_value(spark):
    rows = [("f", b, b * 100 + i, (b, i), 7 if (b, i) in ((0, 1), (40, 2)) else None) for b in (0, 10, 20, 40, 50) for i in range(3)]
    df = spark.createDataFrame(rows, "source_file STRING, _block BIGINT, _at BIGINT, _id STRUCT<b: INT, i: INT>, v INT")
    df = df.withColumn("v", F.when(F.col("v").isNotNull(), F.struct((F.col("_block") + 1).alias("x"))))
    out = {(r["_block"], r["_at"] % 100): r["v"] and r["v"]["x"] for r in carry_last(df, "v").collect()}
    assert out == {(b, i): None if (b, i) < (0, 1) else 1 if (b, i) < (40, 2) else 41 for b in (0, 10, 20, 40, 50) for i in range(3)}

import duckdb
import pytest
from cases import ROWS, documents
from pyspark.sql import functions as F

from fleetsig.llm import mixing


@pytest.fixture(scope="module")
def many(spark):
    rows = ROWS + [(1000 + i, " ".join(["w"] * (1 + i * 37 % 250)) + (" | x" if i % 5 == 0 else ""), ["en", "de", "fr", None][i % 4]) for i in range(800)]
    return documents(spark, rows)


def test_equals_sql(spark, many, tmp_path):
    many.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = con.execute(mixing.sql(rounds=4)).fetchall()
    dims = mixing.dimensions()
    got = mixing.calibrated(many.withColumn("topic", dims["topic"]), dims, rounds=4).select(
        "doc_id", "source", "lang", "topic", "__tokens", F.round("__p", 9), "__sampled"
    )
    key = lambda r: tuple(round(x, 8) if isinstance(x, float) else x for x in r)
    assert sorted((key(r) for r in got.collect()), key=repr) == sorted((key(r) for r in want), key=repr)


def test_marginals_and_rate(spark, many):
    dims = mixing.dimensions()
    given = {"lang": spark.createDataFrame([("en", 2.0), ("de", 1.0), ("xx", 5.0), (None, 1.0)], "value string, share double")}
    rows = mixing.calibrated(many, dims, targets=given, rate=0.02, rounds=12)
    assert rows.count() == many.count()
    expected = rows.groupBy("lang").agg(F.sum(F.col("__p") * F.col("__tokens")).alias("n")).collect()
    share = {r.lang: r.n for r in expected}
    total = sum(share.values())
    assert total == pytest.approx(0.02 * rows.agg(F.sum("__tokens")).first()[0])
    assert share["en"] / total == pytest.approx(0.5, abs=0.005) and share[None] / total == pytest.approx(0.25, abs=0.005)
    assert share["fr"] == 0 and share["es"] == 0
    sources = rows.groupBy("source").agg(F.sum(F.col("__p") * F.col("__tokens")).alias("n"), F.sum("__tokens").alias("of")).collect()
    raised = [r.of**0.5 for r in sources]
    assert [r.n / total for r in sources] == pytest.approx([x / sum(raised) for x in raised], abs=0.05)


def test_edges(spark, many):
    assert mixing.mix(many.limit(0)).collect() == []
    assert mixing.mix(many).columns == many.columns
    assert mixing.mix(many, rate=1.0).count() == many.count()
    once, again = (sorted(map(repr, mixing.mix(many).collect())) for _ in range(2))
    assert once == again and 0 < len(once) < many.count()

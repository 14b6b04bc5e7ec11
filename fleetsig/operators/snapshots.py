"""Analytics over snapshots of cumulative counters, and parsing of server logs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetsig.functions.times import between, ratio, time_bucket
from fleetsig.operators.counters import bucket_deltas, deltas
from fleetsig.operators.quantiles import exact_quantiles

STATEMENT_KEY = ["queryid", "userid"]
BLOCK_BYTES = 8192
COUNTERS = ["calls", "total_plan_time", "total_exec_time", "blk_read_time", "blk_write_time"]


def statement_deltas(stats: DataFrame, t_from, t_to) -> DataFrame:
    """Differences between consecutive snapshots of the same statement and user."""
    rows = stats.where(between("collected_at", t_from, t_to)).select(*STATEMENT_KEY, "collected_at", *COUNTERS)
    return deltas(rows, STATEMENT_KEY, "collected_at", COUNTERS)


def _busy() -> Column:
    return F.col("delta_plan_time") + F.col("delta_exec_time")


def _short(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({
        "delta_total_plan_time": "delta_plan_time", "delta_total_exec_time": "delta_exec_time",
    })


def runtime_percentiles(stats: DataFrame, t_from, t_to, step: float) -> DataFrame:
    """Median and 95th percentile of the time per call, interpolated, and mean I/O time per bucket."""
    return _runtime_percentiles(stats, t_from, t_to, step, exact=True)


def estimated_runtime_percentiles(stats: DataFrame, t_from, t_to, step: float) -> DataFrame:
    """The same as a dashboard estimates them: from a sketch whose rank is off by at most a ten-thousandth of a bucket."""
    return _runtime_percentiles(stats, t_from, t_to, step, exact=False)


def _runtime_percentiles(stats: DataFrame, t_from, t_to, step: float, exact: bool) -> DataFrame:
    per_call = (
        _short(statement_deltas(stats, t_from, t_to))
        .withColumn("time", time_bucket("collected_at", step))
        .withColumn("_ms", ratio(_busy(), F.col("delta_calls")))
        .withColumn("_io", F.col("delta_blk_read_time") + F.col("delta_blk_write_time"))
    )
    sums = [F.sum("_io").alias("_io"), F.sum("delta_calls").alias("_calls")]
    if exact:
        quantiles = exact_quantiles(per_call, ["time"], "_ms", {"_p50": 0.5, "_p95": 0.95})
        out = per_call.groupBy("time").agg(*sums).join(quantiles, "time", "left")
    else:
        both = F.percentile_approx("_ms", [0.5, 0.95], 10_000).alias("_p")
        out = per_call.groupBy("time").agg(*sums, both).withColumns({"_p50": F.get("_p", F.lit(0)), "_p95": F.get("_p", F.lit(1))})
    zero = F.lit(0.0)
    return out.select(
        "time",
        F.coalesce("_p50", zero).alias("median_time"),
        F.coalesce("_p95", zero).alias("p95_time"),
        F.coalesce(ratio(F.col("_io"), F.col("_calls")), zero).alias("avg_io_time"),
    )


def top_statements(stats: DataFrame, texts: DataFrame, users: DataFrame, t_from, t_to) -> DataFrame:
    """Statements with mean time, calls per minute and shares of all run time and I/O."""
    per = (
        _short(statement_deltas(stats, t_from, t_to))
        .where(F.col("delta_calls") > 0)
        .groupBy(*STATEMENT_KEY)
        .agg(
            F.sum("delta_calls").alias("_calls"),
            F.sum(_busy()).alias("_ms"),
            F.coalesce(F.sum(F.col("delta_blk_read_time") + F.col("delta_blk_write_time")), F.lit(0.0)).alias("_io"),
        )
    )
    whole = per.select(F.struct(F.sum("_ms").alias("ms"), F.sum("_io").alias("io"))).scalar()
    minutes = (F.lit(t_to).cast("timestamp").cast("double") - F.lit(t_from).cast("timestamp").cast("double")) / 60.0
    return (
        per.withColumn("_whole", whole)
        .join(texts, "queryid")
        .join(users, "userid")
        .select(
            "queryid",
            "query",
            "rolname",
            ratio(F.col("_ms"), F.col("_calls")).alias("avg_time"),
            ratio(F.col("_calls").cast("double"), minutes).alias("calls_per_min"),
            (ratio(F.col("_ms"), F.col("_whole.ms")) * 100).alias("pct_runtime"),
            (ratio(F.col("_io"), F.col("_whole.io")) * 100).alias("pct_io"),
        )
    )


def range_summary(stats: DataFrame, t_from, t_to, by: str = "queryid") -> DataFrame:
    """Per statement: counter ranges over the time range, per call."""

    def gained(c: str) -> Column:
        return F.max(c) - F.min(c)

    rows = stats.where(between("collected_at", t_from, t_to))
    blocks = gained("shared_blks_read") + gained("local_blks_read") + gained("temp_blks_read")
    return rows.groupBy(by).agg(
        gained("calls").alias("total_calls"),
        gained("total_exec_time").alias("_ms"),
        F.max("total_exec_time").alias("_max"),
        blocks.alias("_blocks"),
    ).select(
        by,
        ratio(F.col("_ms"), F.col("total_calls")).alias("avg_time_per_call"),
        ratio(F.col("_max"), F.col("total_calls")).alias("max_time_per_call"),
        ratio((F.col("_blocks") * BLOCK_BYTES).cast("double"), F.col("total_calls")).alias("bytes_per_call"),
        "total_calls",
    )


def activity(stats: DataFrame, t_from, t_to, step: float) -> DataFrame:
    """Reset-aware run time, I/O time and calls per bucket and statement."""
    rows = stats.where(between("collected_at", t_from, t_to))
    counters: Mapping[str, Column] = {
        "total_time": F.col("total_exec_time"),
        "total_io_time": F.col("blk_read_time") + F.col("blk_write_time"),
        "calls": F.col("calls"),
    }
    return bucket_deltas(rows, STATEMENT_KEY, "collected_at", counters, step)


def cache_hits(stats: DataFrame, t_from, t_to, step: float) -> DataFrame:
    """Share of blocks found in the buffer cache per bucket and statement, for buckets with calls."""
    rows = stats.where(between("collected_at", t_from, t_to))
    counters = {"hit": F.col("shared_blks_hit"), "read": F.col("shared_blks_read"), "calls": F.col("calls")}
    gained = bucket_deltas(rows, STATEMENT_KEY, "collected_at", counters, step).where(F.col("calls") > 0)
    blocks = F.col("hit") + F.col("read")

    def percent(part: str) -> Column:
        return F.when(blocks > 0, F.lit(100.0) * F.col(part).cast("double") / blocks)

    return gained.select(
        "time",
        *STATEMENT_KEY,
        percent("hit").alias("pct_from_cache"),
        percent("read").alias("pct_from_disk"),
        ((F.col("read") * BLOCK_BYTES).cast("double") / F.col("calls")).alias("bytes_per_call"),
    )


def slow_plans(explains: DataFrame) -> DataFrame:
    """Logged plans with the share of run time spent reading."""
    share = ratio(F.col("io_read_time"), F.col("duration")) * 100.0
    return explains.withColumn("io_read_pct", share)


def snapshot_totals(stats: DataFrame, columns: list[str]) -> DataFrame:
    """All statements of a snapshot added up."""
    return stats.groupBy("collected_at").agg(*[F.sum(c).alias(c) for c in columns])


def add_texts(texts: DataFrame, statements: DataFrame) -> DataFrame:
    """Statement-text dictionary with unseen statements added."""
    fresh = statements.select("queryid", "query").dropDuplicates(["queryid"])
    return texts.unionByName(fresh.join(texts.select("queryid"), "queryid", "left_anti"))


# Wording of the server's log messages.
_VACUUM = r'automatic vacuum of table "([^"]+)"'
_ELAPSED = r"elapsed: ([0-9\.]+) s"
_INDEX_SCANS = r"index scans: (\d+)"
_PAGES = r"pages: (\d+) removed"
_TUPLES = r"tuples: (\d+) removed"
_REMAIN = r"tuples: \d+ removed, (\d+) remain"
_DURATION = r"duration: ([\d.]+) ms"
_PLAN = r"(?s)plan:\n(\{.*)"


def _found(pattern: str, kind: str, group: int = 1) -> Column:
    return F.regexp_extract("message", pattern, group).try_cast(kind)


def maintenance_runs(log: DataFrame, database: str, schemas=("public", "uec", "pganalyze")) -> DataFrame:
    """Automatic vacuum runs found in the server log, one per table and start."""
    ours = F.lit(False)
    for s in schemas:
        ours = ours | F.col("message").startswith(f'automatic vacuum of table "{database}.{s}.')
    rows = log.where((F.col("error_severity") == "LOG") & (F.col("backend_type") == "autovacuum worker") & ours)
    seconds = _found(_ELAPSED, "double")
    return rows.select(
        F.regexp_replace(F.regexp_extract("message", _VACUUM, 1), r"^[^.]+\.", "").alias("relation"),
        F.col("log_time").alias("started_at"),
        F.timestamp_micros(F.unix_micros("log_time") + F.round(seconds * 1e6).cast("long")).alias("finished_at"),
        _found(_INDEX_SCANS, "bigint").alias("index_scans"),
        _found(_PAGES, "bigint").alias("pages_removed"),
        _found(_TUPLES, "bigint").alias("tuples_removed"),
        _found(_REMAIN, "bigint").alias("tuples_remain"),
        F.col("message").contains("to prevent wraparound").alias("wraparound"),
        F.col("message").alias("details"),
    ).dropDuplicates(["relation", "started_at"])


def logged_plans(log: DataFrame, database: str, user: str) -> DataFrame:
    """Plans of slow statements found in the server log."""
    rows = log.where(
        (F.col("database_name") == database)
        & (F.col("user_name") == user)
        & (F.col("error_severity") == "LOG")
        & F.col("message").startswith("duration: ")
    )
    plan = F.regexp_extract("message", _PLAN, 1)

    def field(name: str, kind: str) -> Column:
        return F.get_json_object(F.col("plan"), f"$.Plan['{name}']").try_cast(kind)

    return rows.select(
        F.col("log_time").alias("time"),
        F.col("query_id").alias("queryid"),
        _found(_DURATION, "double").alias("duration"),
        F.nullif(plan, F.lit("")).alias("plan"),
    ).select(
        "time",
        "queryid",
        "duration",
        field("Total Cost", "double").alias("total_cost"),
        (field("Shared Read Blocks", "bigint") * BLOCK_BYTES).alias("bytes_read"),
        field("Shared I/O Read Time", "double").alias("io_read_time"),
        "plan",
    ).dropDuplicates(["time", "queryid"])

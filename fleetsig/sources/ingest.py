"""Importing exports into the stored tables, by batch, by polling and by stream."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from time import sleep as pause

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsig import schema
from fleetsig.operators import metadata
from fleetsig.session import checkpoint_dir
from fleetsig.sources import tabular, xml_export
from fleetsig.sources.lake import Lake
from fleetsig.sources.xml_export import FILE

GLOB = "*_data.{xml,xml.gz}"
REJECTS = f"{FILE} STRING, param_id INT, reason STRING, rejected BIGINT, import_id STRING"
FILE_LOG = "path STRING, modificationTime TIMESTAMP"
OUTCOMES = (
    "path STRING, modificationTime TIMESTAMP, status STRING, error STRING, accepted BIGINT, rejected BIGINT, malformed BIGINT, "
    "import_id STRING, at TIMESTAMP"
)
DONE, SKIPPED, FAILED = "done", "skipped", "failed"
_COUNTS = f"{FILE} STRING, accepted BIGINT, rejected BIGINT, malformed BIGINT"


@dataclass
class ImportResult:
    """``rejects``: values per file, parameter and reason; ``skipped``: files of no known instrument; ``counts``: values per file."""

    rejects: DataFrame
    skipped: list[str]
    counts: DataFrame
    import_id: str


def import_files(spark: SparkSession, paths: Sequence[str], registry: DataFrame, lake: Lake, strict: bool = True) -> ImportResult:
    """Import exports: metadata with history first, then the values; a second import changes nothing.

    Each of the three sections is parsed once and kept as a staged table while the import lasts. Where files
    of one instrument disagree on metadata, the file later in name order wins. A file that cannot be read fails the import;
    a malformed value or enumeration costs only itself and is counted, as are values that do not convert.
    """
    paths = list(paths)
    with lake.staging() as stage:
        enumerations = stage(xml_export.read_enumerations(spark, paths))
        files = xml_export.file_instruments(enumerations).join(registry, "instrument")
        listed = spark.read.format("binaryFile").load(paths).select(F.col("path").alias(FILE))
        # one name per file of this import
        skipped = [r[0] for r in listed.join(files, FILE, "left_anti").collect()]
        if skipped and strict:
            raise ValueError(f"no registered instrument for: {', '.join(sorted(skipped))}")

        _store_instruments(lake, files)
        ids = lake.read("instruments").select(F.col("id").alias("instrument_id"), "instrument")
        owner = files.select(FILE, "instrument").join(ids, "instrument").select(FILE, "instrument_id")
        now = F.current_timestamp()
        labels = xml_export.flatten_enumerations(enumerations).drop("instrument")
        _store_enumerations(lake, labels.join(owner, FILE), now)
        described = stage(xml_export.read_parameters(spark, paths)).join(owner, FILE)
        _store_parameters(lake, described, now)

        pieces = stage(xml_export.value_pieces(spark, paths))
        values = xml_export.values_of_pieces(pieces).join(owner, FILE)
        typed = stage(xml_export.type_values(values, described.drop("instrument_id"), on=[FILE, "param_id"]))
        lake.append_events(xml_export.accepted(typed))
        run = uuid.uuid4().hex
        unknown = xml_export.rejected(typed).withColumn("reason", F.lit("unknown parameter"))
        lost = unknown.unionByName(xml_export.unconverted(typed))
        counts = lost.groupBy(FILE, "param_id", "reason").agg(F.count("*").alias("rejected"))
        broken = _malformed(stage, enumerations, pieces)
        named = broken.select(FILE, F.lit(None).cast("int").alias("param_id"), F.lit("malformed").alias("reason"), F.col("malformed").alias("rejected"))
        rejects = stage(counts.unionByName(named))
        lake.append("rejects", rejects.withColumn("import_id", F.lit(run)).select(*_names(REJECTS)))
        taken = xml_export.accepted(typed, [FILE]).groupBy(FILE).agg(F.count("*").alias("accepted"))
        refused = rejects.where("reason <> 'malformed'").groupBy(FILE).agg(F.sum("rejected").alias("rejected"))
        per_file = owner.join(taken, FILE, "left").join(refused, FILE, "left").join(broken, FILE, "left")
        per_file = per_file.fillna(0, ["accepted", "rejected", "malformed"])
        lake.append("import_counts", per_file.withColumn("import_id", F.lit(run)))
    mine = F.col("import_id") == run
    counted = lake.log("import_counts", f"{_COUNTS}, import_id STRING").where(mine)
    return ImportResult(lake.log("rejects", REJECTS).where(mine), skipped, counted, run)


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(",")]


def _malformed(stage, enumerations: DataFrame, pieces: DataFrame) -> DataFrame:
    """Per file: malformed enumerations and values."""
    both = xml_export.lost_values(pieces).unionByName(xml_export.malformed_counts(enumerations))
    return stage(both.groupBy(FILE).agg(F.sum("malformed").cast("long").alias("malformed")))


def _store_instruments(lake: Lake, files: DataFrame) -> None:
    incoming = files.select("instrument", "serial", "model", "name", "template", "server").distinct()
    stored = lake.read("instruments", schema.INSTRUMENTS)
    lake.replace("instruments", metadata.get_or_create(stored, incoming, ["instrument"]))


def _newest_file(df: DataFrame, key: Sequence[str], attrs: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.max_by(F.struct(*attrs), FILE).alias("_n")).select(*key, "_n.*")


def _store_with_history(lake: Lake, name: str, incoming: DataFrame, key, attrs, struct, now) -> None:
    stored = lake.read(name, struct)
    kept, history = metadata.upsert_with_history(stored, incoming, key, attrs, now)
    lake.append(f"{name}_history", history)
    lake.replace(name, kept)


def _store_enumerations(lake: Lake, enums: DataFrame, now) -> None:
    types = lake.read("enum_types", schema.ENUM_TYPES)
    named = enums.select("instrument_id", F.col("enum_name").alias("name")).distinct()
    lake.replace("enum_types", metadata.get_or_create(types, named, ["instrument_id", "name"]))
    ids = lake.read("enum_types").select("instrument_id", F.col("name").alias("enum_name"), F.col("id").alias("enum_id"))
    values = _newest_file(
        enums.join(ids, ["instrument_id", "enum_name"]).where("value IS NOT NULL"), ["enum_id", "member_name"], ["value"]
    )
    _store_with_history(lake, "enum_values", values, ["enum_id", "member_name"], ["value"], schema.ENUM_VALUES, now)


def _store_parameters(lake: Lake, described: DataFrame, now) -> None:
    key, attrs = metadata.SIGNAL_KEY, schema.PARAMETER_ATTRS
    resolved = metadata.resolve_enums(described, lake.read("enum_types", schema.ENUM_TYPES))
    incoming = _newest_file(resolved, key, attrs)
    _store_with_history(lake, "parameters", incoming, key, attrs, schema.PARAMETERS, now)


def batch(spark: SparkSession, paths: Sequence[str], registry_path: str, root: str) -> ImportResult:
    return import_files(spark, paths, tabular.read_registry(spark, registry_path), Lake(spark, root))


def poll(
    spark: SparkSession, directory: str, registry: DataFrame, lake: Lake, files_per_batch: int = 64, settle_seconds: float = 0,
) -> list[str]:
    """Import the files that are new or were overwritten since they were last imported; returns the names imported.

    The exporter rewrites its files in place, so files are remembered with their modification time. They are
    taken in groups until none is left. What became of each file is one row of ``import_outcomes``; only a file that is
    ``done`` is remembered as imported, so one that failed, or whose instrument was unknown, is tried again by the next
    poll. With ``settle_seconds`` a file waits until its size and time have not changed for so long.
    """
    imported: list[str] = []
    begun = datetime.now(timezone.utc)
    with lake.staging() as stage:
        settled = _settled(spark, directory, settle_seconds, stage)
        while True:
            file = ["path", "modificationTime"]
            done = lake.log("imported_files", FILE_LOG)
            # whatever became of them, files this poll has taken are not taken again
            tried = lake.log("import_outcomes", OUTCOMES).where(F.col("at") >= F.lit(begun))
            waiting = settled.join(done, file, "left_anti").join(tried, file, "left_anti")
            group = waiting.orderBy("modificationTime", "path").limit(files_per_batch).select(*file).collect()
            if not group:
                return imported
            imported += _import_group(spark, group, registry, lake)


def _listed(spark: SparkSession, directory: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("pathGlobFilter", GLOB).load(directory)
    return found.select("path", "modificationTime", "length")


def _settled(spark: SparkSession, directory: str, seconds: float, stage) -> DataFrame:
    """Files whose length and time are the same after ``seconds``; one that still grows is left for the next poll."""
    first = stage(_listed(spark, directory))
    if not seconds:
        return first
    pause(seconds)
    return stage(_listed(spark, directory).join(first, ["path", "modificationTime", "length"], "left_semi"))


def _import_group(spark: SparkSession, group: list, registry: DataFrame, lake: Lake) -> list[str]:
    """Import files together, or one by one if that fails, so that a broken file stops no other."""
    times = {r["path"]: r["modificationTime"] for r in group}
    try:
        results = [(list(times), import_files(spark, sorted(times), registry, lake, strict=False), None)]
    except Exception as error:  # whatever a file may cause: it is recorded below
        if len(group) > 1:
            return [p for r in group for p in _import_group(spark, [r], registry, lake)]
        results = [(list(times), None, f"{type(error).__name__}: {error}"[:2000])]
    done, rows = [], []
    for paths, result, error in results:
        counts = {r[FILE]: r for r in result.counts.collect()} if result else {}
        for path in paths:
            c = counts.get(path)
            status = FAILED if error else SKIPPED if path in result.skipped else DONE
            numbers = (c["accepted"], c["rejected"], c["malformed"]) if c else (0, 0, 0)
            rows.append((path, times[path], status, error, *numbers, result.import_id if result else None, datetime.now(timezone.utc)))
            done += [path] if status == DONE else []
    lake.append("import_outcomes", spark.createDataFrame(rows, OUTCOMES))
    if done:
        lake.append("imported_files", spark.createDataFrame([(p, times[p]) for p in done], FILE_LOG))
    return done


def watch(
    spark: SparkSession, directory: str, registry, lake: Lake, every: float = 300, settle_seconds: float = 10,
    rounds: int | None = None,
) -> None:
    """Poll a folder again and again. ``registry`` is a function, read before each round, so new instruments count at once."""
    while rounds is None or rounds > 0:
        for path in poll(spark, directory, registry(), lake, settle_seconds=settle_seconds):
            print(path)
        rounds = None if rounds is None else rounds - 1
        if rounds is None or rounds > 0:
            pause(every)


def stream(
    spark: SparkSession, directory: str, registry: DataFrame, lake: Lake, checkpoint: str | None = None,
    available_now: bool = False, every: str = "1 minute", files_per_batch: int = 64,
):
    """Import files as they appear under new names; returns the streaming query. Files that failed or were skipped are in
    ``import_outcomes`` and left to ``poll``.

    The stream only carries file names, a bounded number per micro-batch; the files themselves are read and
    written by the batch import, whose de-duplication makes a replayed micro-batch harmless.
    """
    names = (
        spark.readStream.format("binaryFile")
        .schema("path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY")
        .option("pathGlobFilter", GLOB)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(directory)
        .select("path", "modificationTime")
    )

    def run(batch_df: DataFrame, _batch_id: int) -> None:
        group = batch_df.collect()
        if group:
            _import_group(spark, group, registry, lake)

    writer = names.writeStream.foreachBatch(run).option(
        "checkpointLocation", checkpoint or f"{checkpoint_dir(spark)}/ingest"
    )
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    return writer.trigger(**trigger).start()

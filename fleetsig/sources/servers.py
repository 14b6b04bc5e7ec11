"""One table of several remote databases as one source: a partition per server, each with its own lower bound."""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

FORMAT = "server_tables"
_FETCH = 10_000
# how a DB-API module marks the one parameter
_MARKS = {"qmark": "?", "numeric": ":1", "format": "%s", "pyformat": "%s"}


@dataclass
class Server(InputPartition):
    """``since``: only rows whose mark column is above it are asked for; text is an instant in UTC, None asks for all."""

    instrument_id: int
    server: str
    since: str | int | None = None


def read_servers(
    spark: SparkSession, servers: Sequence[Server], table: str, struct: str, module: str, url: str, mark_column: str, **login: str,
) -> DataFrame:
    """Rows of ``table`` on every server, with ``instrument_id`` first.

    ``module`` is a DB-API module the executors can import; ``url`` goes to its ``connect``, with ``{server}`` replaced, and
    so do ``login``'s entries. The plan is the same for any number of servers. A server that cannot be read fails the query.
    """
    spark.dataSource.register(ServerTables)
    listed = json.dumps([[s.instrument_id, s.server, s.since] for s in servers])
    options = {"servers": listed, "table": table, "module": module, "url": url, "mark": mark_column, "login": json.dumps(login)}
    return spark.read.format(FORMAT).schema(f"instrument_id INT, {struct}").options(**options).load()


class ServerTables(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def reader(self, schema: StructType) -> ServerReader:
        return ServerReader(dict(self.options), schema.fieldNames()[1:])


class ServerReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.options, self.columns = options, columns

    def partitions(self) -> list[Server]:
        return [Server(*s) for s in json.loads(self.options["servers"])]

    def read(self, partition: Server) -> Iterator[tuple]:
        if partition is None:
            return
        module = importlib.import_module(self.options["module"])
        login = json.loads(self.options["login"])
        connection = module.connect(self.options["url"].replace("{server}", partition.server), **login)
        try:
            cursor = connection.cursor()
            query = f"SELECT {', '.join(self.columns)} FROM {self.options['table']}"
            if partition.since is None:
                cursor.execute(query)
            else:
                cursor.execute(f"{query} WHERE {self.options['mark']} > {_MARKS[module.paramstyle]}", (_bound(partition.since),))
            while rows := cursor.fetchmany(_FETCH):
                for row in rows:
                    yield (partition.instrument_id, *map(_utc, row))
        finally:
            connection.close()


def _bound(since: str | int):
    return datetime.fromisoformat(since) if isinstance(since, str) else since


def _utc(value):
    return value.replace(tzinfo=timezone.utc) if isinstance(value, datetime) and value.tzinfo is None else value

"""Command line: ``spark-submit fleetsig/__main__.py <command>`` or ``python -m fleetsig <command>``."""

from __future__ import annotations

import argparse
from datetime import datetime, timezone

from pyspark.sql import functions as F

from fleetsig import schema
from fleetsig.plans import incremental, refresh
from fleetsig.session import build_session
from fleetsig.sources import alarm_store, ingest, servers, tabular
from fleetsig.sources.lake import Lake, parse_day


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="fleetsig")
    top.add_argument("--lake", required=True, help="root folder of the stored tables")
    sub = top.add_subparsers(dest="command", required=True)
    one = sub.add_parser("import", help="import XML exports")
    one.add_argument("-i", "--input", nargs="+", required=True)
    one.add_argument("-s", "--settings", required=True, help="instrument registry (JSON)")
    one.add_argument("--rejects", help="folder for the full list of refused values (CSV)")
    watch = sub.add_parser("watch", help="import files as they appear in a folder")
    watch.add_argument("-i", "--input", required=True)
    watch.add_argument("-s", "--settings", required=True)
    watch.add_argument("-t", "--interval", type=float, default=300, help="seconds between polls")
    watch.add_argument("--settle", type=float, default=10, help="seconds a file must stay unchanged before it is read")
    watch.add_argument("--once", action="store_true", help="import what is new or modified and stop")
    sub.add_parser("create-stats", help="recompute all derived tables")
    vacuum = sub.add_parser("vacuum", help="remove replaced versions of tables")
    vacuum.add_argument("--days", type=float, default=7, help="keep what was replaced more recently")
    compact = sub.add_parser("compact", help="merge the files of event days")
    compact.add_argument("--day", type=parse_day, nargs="*", help="DD-MM-YYYY; all days if none is given")
    sub.add_parser("refresh-stats", help="bring all derived tables up to date: recent day buckets, and the others from what was imported")
    clean = sub.add_parser("clean-inst", help="delete an instrument, or its older events")
    clean.add_argument("-i", "--instrument", type=int, required=True)
    clean.add_argument("--date", type=parse_day, help="delete only events before DD-MM-YYYY")
    uec = sub.add_parser("import-alarms", help="import new error definitions and notifications")
    uec.add_argument("--url", required=True, help="URL; {server} is replaced by the instrument's server")
    uec.add_argument("--module", help="DB-API module on the executors whose connect takes the URL; JDBC if none is given")
    uec.add_argument("--user")
    uec.add_argument("--password")
    uec.add_argument("--definitions", default="qry.ErrorDefinitions")
    uec.add_argument("--notifications", default="qry.ErrorNotifications")
    return top


def import_alarms(lake: Lake, source) -> None:
    """``source(server, table kind)`` gives the remote frames of one instrument's server."""
    alarm_store.import_alarms(
        lake, lambda kind, servers: tabular.union_sources({s.instrument_id: source(s.server, kind) for s in servers})
    )


def remote_alarms(spark, args):
    """The remote tables by a DB-API module on the executors, or by JDBC."""
    tables = {"definitions": args.definitions, "notifications": args.notifications}
    columns = {"definitions": schema.ALARM_DEFINITIONS.toDDL(), "notifications": schema.ALARM_NOTIFICATIONS.toDDL()}
    marks = {"definitions": "ErrorDefinitionID", "notifications": "ErrorDtm"}
    login = {k: v for k, v in (("user", args.user), ("password", args.password)) if v}

    def by_module(kind, asked):
        return servers.read_servers(spark, asked, tables[kind], columns[kind], args.module, args.url, marks[kind], **login)

    def by_jdbc(kind, asked):
        return tabular.union_sources({
            s.instrument_id: tabular.read_alarm_source(
                spark, args.url.format(server=s.server), tables[kind], s.since, marks[kind], **login
            ) for s in asked
        })

    return by_module if args.module else by_jdbc


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = build_session()
    lake = Lake(spark, args.lake)
    if args.command == "import":
        result = ingest.batch(spark, args.input, args.settings, args.lake)
        for row in result.rejects.groupBy("reason").agg(F.sum("rejected").alias("n")).orderBy("reason").toLocalIterator():
            print(f"{row.reason}: {row.n} values")
        if args.rejects:
            tabular.export_csv(result.rejects, args.rejects)
    elif args.command == "watch":
        ingest.watch(
            spark, args.input, lambda: tabular.read_registry(spark, args.settings), lake, args.interval,
            settle_seconds=0 if args.once else args.settle, rounds=1 if args.once else None,
        )
    elif args.command == "vacuum":
        print("\n".join(lake.vacuum(args.days * 86_400)))
    elif args.command == "compact":
        lake.compact(args.day or None)
    elif args.command == "create-stats":
        refresh.refresh_all(lake)
    elif args.command == "refresh-stats":
        now = datetime.now(timezone.utc)
        for name in refresh.DAILY:
            refresh.refresh_window(lake, name, now)
        incremental.refresh_changed(lake)
    elif args.command == "clean-inst":
        if args.date:
            lake.delete_before(args.instrument, args.date)
        else:
            lake.delete_instrument(args.instrument)
    elif args.command == "import-alarms":
        alarm_store.import_alarms(lake, remote_alarms(spark, args))


if __name__ == "__main__":
    main()

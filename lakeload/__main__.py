"""Command line: ``python -m lakeload generate|ingest|publish|lookup|preview``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from lakeload.operators.generate import sample_records
from lakeload.operators.lookup import lookup_by_id, preview
from lakeload.sources.table import read_table
from lakeload.sources.tsv import write_tsv
from lakeload.sources.warehouse import BUCKETS, open_warehouse, publish_all
from lakeload.streaming.ingest import ingest
from lakeload.streaming.load import IngestOptions


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lakeload", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    generate = commands.add_parser("generate", help="write sample files")
    generate.add_argument("folder")
    generate.add_argument("files", nargs="+", metavar="NAME=ROWS")

    load = commands.add_parser("ingest", help="load new files into the table")
    load.add_argument("folder")
    load.add_argument("table")
    load.add_argument("--file", action="append", default=[], help="load this file first")
    load.add_argument("--extension", default=IngestOptions.extension)
    load.add_argument("--recursive", action="store_true")
    load.add_argument("--take-known", action="store_true", help="load known files again")
    load.add_argument("--partitions", type=int, default=IngestOptions.partitions)
    load.add_argument("--delete-consumed", action="store_true")

    move = commands.add_parser("publish", help="move loaded rows to a warehouse table")
    move.add_argument("table")

    find = commands.add_parser("lookup", help="show the rows with an ID")
    find.add_argument("table")
    find.add_argument("id")
    find.add_argument("--library")

    show = commands.add_parser("preview", help="show the first rows of the table")
    show.add_argument("table")
    for command in (load, move, find, show):
        command.add_argument("--warehouse", metavar="NAME", required=command is move)
        command.add_argument("--buckets", type=int, default=BUCKETS)
    return top


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.command == "generate":
        sizes = {name: int(rows) for name, _, rows in (f.rpartition("=") for f in args.files)}
        write_tsv(sample_records(spark, sizes), args.folder, partition_by="file_name")
    elif args.command == "ingest":
        options = IngestOptions(
            extension=args.extension,
            recursive=args.recursive,
            ignore_duplicates=not args.take_known,
            partitions=args.partitions,
            warehouse=args.warehouse,
            buckets=args.buckets,
        )
        entries = ingest(
            spark,
            args.folder,
            args.table,
            listed=args.file,
            options=options,
            delete_consumed=args.delete_consumed,
        )
        entries.groupBy("status").agg(
            {"path": "count", "rows_loaded": "sum", "rows_rejected": "sum"}
        ).show()
    elif args.command == "publish":
        moved = publish_all(spark, args.warehouse, args.table, args.buckets)
        print(f"{moved} sources moved")
    elif args.command == "lookup":
        lookup_by_id(_table(spark, args), args.id, args.library).show()
    else:
        preview(_table(spark, args)).show()


def _table(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.warehouse:
        return open_warehouse(spark, args.warehouse, args.table, args.buckets)
    return read_table(spark, args.table)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    run(SparkSession.builder.appName("lakeload").getOrCreate(), args)


if __name__ == "__main__":
    main()

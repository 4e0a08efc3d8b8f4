"""Command line: ``python -m changeflow <command> …`` (also through ``spark-submit``)."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from changeflow.operators import evidence, maintain, reconcile
from changeflow.plans import sqlapi
from changeflow.schemas import CURRENT_COLUMNS
from changeflow.session import build_session, run_dir
from changeflow.sources import feeds, readers
from changeflow.streaming import ingest, verify
from changeflow.streaming.table import ChangeTable


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="changeflow")
    parser.add_argument("--master")
    sub = parser.add_subparsers(dest="command", required=True)

    def command(name: str, help_: str, *options: str, **defaults) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=help_)
        for option in options:
            p.add_argument(f"--{option}", required=True)
        for option, value in defaults.items():
            kind = type(value) if value is not None else str
            p.add_argument(f"--{option.replace('_', '-')}", type=kind, default=value)
        return p

    command("generate", "write seeded orders", "out", events=10_000, seed=1, batch_size=1_000)
    command(
        "ingest", "stream JSON envelopes into a table", "base", "landing", "checkpoint", "writer",
        mode="quarantine", max_files=1_000, every_seconds=0,
    )
    command("sql", "run one statement, print tab-separated rows", "base", query="")
    command("inspect", "commit summary of a table", "base")
    command("layout", "file layout of a table", "base", repetitions=7)
    command("compact", "write a compacted snapshot", "base", target_bytes=128 * 1024 * 1024)
    command("reconcile", "compare a table with its source rows", "base", "source")
    failing = command("verify", "induce failures and reconcile", runs=1, out=None)
    failing.add_argument("--failure", nargs="+", choices=sqlapi.FAILURE_CLASSES, default=[*sqlapi.FAILURE_CLASSES])
    rewrite = verify.RewriteProfile()
    command("rewrite", "small files before and after compaction", batches=rewrite.batches, rows=rewrite.rows_per_batch, out=None)
    load = verify.LoadProfile()
    command("load", "metrics of a run under load", events=load.spike_events, files=load.files, out=None)
    return parser


def _show(rows) -> None:
    for row in rows:
        print(json.dumps(row.asDict(recursive=True), default=str, sort_keys=True))


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = build_session("changeflow", args.master)
    began = evidence.utc_now()

    def record(results, name: str) -> None:
        if args.out:
            stamp = evidence.provenance(spark, f"changeflow {name}", "", began)
            evidence.write_record(results.coalesce(1), stamp, args.out)

    if args.command == "generate":
        feeds.write_orders(feeds.seeded_orders(spark, args.events, args.seed), args.out, args.batch_size)
    elif args.command == "ingest":
        table = ChangeTable(spark, args.base).create()
        stream = ingest.json_envelope_stream(spark, args.landing, args.max_files)

        def start():
            return ingest.start_ingest(
                stream, table, args.checkpoint, args.writer, mode=args.mode,
                every_seconds=args.every_seconds or None,
            )

        if args.every_seconds:
            start().awaitTermination()
        else:
            ingest.run_with_restarts(start)
        _show(table.commit_summary().collect())
    elif args.command == "sql":
        sqlapi.register(spark, ChangeTable(spark, args.base))
        for row in sqlapi.tsv(sqlapi.sql(spark, args.query)).toLocalIterator():
            print(row["line"])
    elif args.command == "inspect":
        _show(ChangeTable(spark, args.base).commit_summary().collect())
    elif args.command == "layout":
        _show(maintain.file_layout(ChangeTable(spark, args.base), args.repetitions).collect())
    elif args.command == "compact":
        print(json.dumps(ChangeTable(spark, args.base).compact(args.target_bytes), sort_keys=True))
    elif args.command == "reconcile":
        target = ChangeTable(spark, args.base).current()
        diff = reconcile.snapshot_diff(readers.source_rows(spark, args.source), target)
        counts = diff.groupBy("side").count().collect()
        for row in diff.orderBy(*CURRENT_COLUMNS, "side").toLocalIterator():
            _show([row])
        _show(counts)
        return 1 if counts else 0
    elif args.command == "verify":
        classes = list(dict.fromkeys(args.failure))
        runs = spark.range(args.runs).withColumnRenamed("id", "scenario_id")
        results = verify.verify_failures(spark, classes, runs, run_dir(spark, "verify"))
        rows = results.collect()
        _show(rows)
        summary = reconcile.scenario_summary(spark.createDataFrame(rows, results.schema))
        _show(summary.collect())
        record(summary, "verify")
        good = summary.first()
        return 0 if all(good[c] for c in good.asDict() if c.startswith(("passed", "all_"))) else 1
    elif args.command == "rewrite":
        profile = verify.RewriteProfile(args.batches, args.rows)
        result = spark.createDataFrame(
            rows := verify.rewrite_small_files(spark, profile, run_dir(spark, "rewrite")).collect(),
        )
        _show(rows)
        record(result, "rewrite")
    elif args.command == "load":
        profile = verify.LoadProfile(args.events, args.files)
        samples, summary = verify.run_under_load(spark, profile, run_dir(spark, "load"))
        _show(samples.collect())
        _show(summary.collect())
        record(summary.select(F.struct("*").alias("summary")), "load")
    return 0


if __name__ == "__main__":
    sys.exit(main())

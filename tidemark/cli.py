"""Command line: run, fetch, shadow, benchmark and inspect."""

from __future__ import annotations

import argparse
import sys
import time
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.functions.mappers import mapper
from tidemark.operators import diagnose, reconcile
from tidemark.plans import cycle
from tidemark.plans.observe import Observer, source_hash, target_hash
from tidemark.plans.state import StateStore
from tidemark.sources import sinks, tables
from tidemark.sources.spec import Config, load_config
from tidemark.streaming import change_stream


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def config(name: str, text: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        c.add_argument("-c", "-t", "--config", "--table", required=True, help="YAML file of the table")
        c.add_argument("--version-column", default=None)
        c.add_argument("--deleted-column", default=None)
        c.add_argument("--change-log", default="", help="folder of change records (Parquet: lsn, op and the columns as text)")
        return c

    for name, text in (("run", "observe both tables and reconcile"), ("fetch", "observe both tables, write scan files only")):
        c = config(name, text)
        c.add_argument("--initial-load", action="store_true")
        c.add_argument("--out", default="scans", help="folder for scan files")
        c.add_argument("--errors", default="", help="folder for rows in error (JSON lines)")
        if name == "run":
            c.add_argument("--fetch-only", action="store_true")
    s = sub.add_parser("shadow", help="reconcile scan files")
    for flag in ("source-scan", "target-scan", "source-changes", "source-extract-scan", "errors"):
        s.add_argument(f"--{flag}", default="")
    s.add_argument("--shadow-path", required=True)
    s.add_argument("--initial-load", action="store_true")
    s.add_argument("--explain", action="store_true")
    b = config("benchmark", "time one scan")
    b.add_argument("scan", choices=("source-scan", "source-extract-scan", "target-scan"))
    i = config("inspect", "show hashes and texts of some rows")
    i.add_argument("--pks", required=True, help="keys, with commas between")
    i.add_argument("--cols", "--column-names", default="", help="columns, with commas between; the key is always there")
    return p


def _observer(spark: SparkSession, config: Config, args: argparse.Namespace) -> Observer:
    return Observer(spark, config.table, tables.open_table(config.source), tables.open_table(config.target), mapper(config.mapper), args.version_column, args.deleted_column)


def _report(store: StateStore, outcome: cycle.Outcome, errors: str) -> None:
    print(sinks.metrics_text(outcome.counts))
    if errors:
        sinks.write_errors(reconcile.errors(store.read(outcome.version)), errors)


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    config = load_config(args.config)
    seen = _observer(spark, config, args)
    spec, how = seen.spec, seen.mapper
    state = config.state_path or f"{spec.table}.state"
    changes = None
    if not args.initial_load:
        log_schema = "lsn bigint, op string, " + ", ".join(f"`{c}` string" for c in dict.fromkeys([spec.pk, *spec.source_columns]))
        changes = change_stream.consume(change_stream.read_log(spark, args.change_log, log_schema), spec, how, f"{state}.changes", f"{state}.offsets", hash_=source_hash(seen.source), target_hash=target_hash(seen.target)) if args.change_log else spark.createDataFrame([], tables.EXTRACT)
    data = seen.data(args.initial_load, changes)
    if args.command == "fetch" or getattr(args, "fetch_only", False):
        for name in ("target_scan", "source_scan", "source_changes", "source_extract"):
            if (df := getattr(data, name)) is not None:
                sinks.write_scan(df, f"{args.out}/{name}")
        return
    store = StateStore(spark, state)
    _report(store, cycle.run_cycle(store, data, args.initial_load), args.errors)
    if args.change_log and not args.initial_load:
        change_stream.compact(spark, f"{state}.changes")


def shadow(spark: SparkSession, args: argparse.Namespace) -> None:
    needed = ("target_scan", "source_extract_scan") if args.initial_load else ("target_scan", "source_scan", "source_changes")
    if missing := [n for n in needed if not getattr(args, n)]:
        raise ValueError("missing: " + ", ".join("--" + n.replace("_", "-") for n in missing))
    data = cycle.DataSet.from_files(spark, args.target_scan, args.source_scan, args.source_changes, args.source_extract_scan)
    store = StateStore(spark, args.shadow_path)
    if args.explain:
        print(cycle.explain(data, None if args.initial_load else store.read(), args.initial_load))
        return
    _report(store, cycle.run_cycle(store, data, args.initial_load), args.errors)


def benchmark(spark: SparkSession, args: argparse.Namespace) -> None:
    config = load_config(args.config)
    seen = _observer(spark, config, args)
    scan, side = {"target-scan": (seen.target_scan, "target"), "source-scan": (seen.source_scan, "source"), "source-extract-scan": (seen.extract, "source")}[args.scan]
    began = time.time()
    rows, out = sinks.scan_stats(scan(), side).first()
    print({k: round(v, 2) for k, v in sinks.throughput(rows, time.time() - began, seen.bytes(side), out).items()} | {"rows": rows})


def inspect(spark: SparkSession, args: argparse.Namespace) -> None:
    config = load_config(args.config)
    pks = [int(k) for k in args.pks.split(",") if k.strip()]
    seen = _observer(spark, config, args)
    if args.cols:
        seen = replace(seen, spec=seen.spec.narrowed([c.strip() for c in args.cols.split(",")]))
    shown = seen.inspect(pks)
    for name, df in shown.items():
        print(f"--- {name} ---")
        df.orderBy("pk").show(len(pks), truncate=False, vertical=True)
    print("--- target against extract ---")
    diagnose.inspect_diff(shown["target"], shown["extract"], diffs=True).where(F.col("verdict") != "equal").orderBy("pk", "field").show(3 * len(pks), truncate=False, vertical=True)


COMMANDS = {"run": run, "fetch": run, "shadow": shadow, "benchmark": benchmark, "inspect": inspect}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        COMMANDS[args.command](spark, args)
    except (ValueError, NotImplementedError) as e:
        print(f"tidemark: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())

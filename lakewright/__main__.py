"""Command line: `spark-submit` or `python -m lakewright <command> ...`; see --help."""

from __future__ import annotations

import argparse
import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.operators import aggregates, files, ordering, skew, snapshots
from lakewright.operators.timeline import DEFAULT_WIDTH, stage_times, timeline
from lakewright.plans import curate, sync
from lakewright.session import build_session
from lakewright.sinks.export import export
from lakewright.sinks.tables import read_log
from lakewright.sources import logs, metrics


def _now() -> dt.datetime:
    return dt.datetime.now()


def _spec(path: str) -> dict:
    with open(path) as file:
        if path.endswith(".json"):
            return json.load(file)
        try:
            import yaml
        except ImportError as error:
            raise SystemExit("reading YAML needs PyYAML; give the spec as JSON") from error
        return yaml.safe_load(file)


def _stages(spark: SparkSession, path: str, event_log: bool) -> DataFrame:
    return metrics.stages_from_event_log(metrics.read_event_log(spark, path)) if event_log else metrics.read_stages(spark, path)


def _tasks(spark: SparkSession, path: str, event_log: bool) -> DataFrame:
    if event_log:
        return metrics.task_metrics_from_event_log(metrics.read_event_log(spark, path))
    return metrics.task_metrics(metrics.read_stages(spark, path))


def _vacuum(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    live = spark.read.text(args.live).select(F.col("value").alias("path"))
    return files.vacuum_candidates(files.file_inventory(spark, args.path), live, F.lit(_now()), args.retain_hours)


def _run_sync(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    sync.sync_full(spark, sync.jobs_from_spec(_spec(args.spec), args.warehouse), args.log, _now())
    return snapshots.recent_snapshots(read_log(spark, args.log))


def _compact(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    columns = args.partition_by.split(",") if args.partition_by else None
    return files.compact_files(spark, args.src, args.dst, args.target_bytes, columns)


def show(result: DataFrame, limit: int) -> None:
    """Print at most `limit` rows and say so when there are more."""
    held = result.limit(limit + 1).collect()
    result.sparkSession.createDataFrame(held[:limit], result.schema).show(limit, truncate=False)
    if len(held) > limit:
        print(f"more than {limit} rows: give --limit or --out for the rest")


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lakewright")
    parser.add_argument("--out", help="write the result to this path instead of showing it")
    parser.add_argument("--fmt", choices=["csv", "json", "parquet"], default="csv", help="format for --out")
    parser.add_argument("--limit", type=int, default=100, help="rows to show without --out")
    parser.add_argument("--master", help="Spark master; left to spark-submit when not given")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, run, *positional: str, **options: object) -> None:
        sub = commands.add_parser(name)
        for argument in positional:
            sub.add_argument(argument)
        for option, default in options.items():
            flag = "--" + option.replace("_", "-")
            if default is False:
                sub.add_argument(flag, action="store_true")
            else:
                sub.add_argument(flag, default=default, type=type(default) if default is not None else str)
        sub.set_defaults(run=run)

    command("silver", lambda s, a: curate.run_silver(s, a.orders, a.silver, a.log, _now()), "orders", "silver", "log")
    command(
        "gold",
        lambda s, a: curate.run_gold(s, a.orders, a.gold, a.new_gold, a.log, _now(), a.compact_to),
        "orders", "gold", "new_gold", "log", compact_to=None,
    )
    command("sync", _run_sync, "spec", "warehouse", "log")
    command("query", lambda s, a: s.sql(a.sql), "sql")
    command("average", lambda s, a: aggregates.average_over(s.read.parquet(a.table), a.column, a.over), "table", "column", over=0.0)
    command("histogram", lambda s, a: aggregates.bucket_histogram(s.read.parquet(a.table), a.column, a.width), "table", "column", width=10)
    command("snapshots", lambda s, a: snapshots.recent_snapshots(read_log(s, a.log), a.last), "log", last=snapshots.RECENT)
    command("files", lambda s, a: files.file_inventory(s, a.path), "path")
    command("vacuum", _vacuum, "path", "live", retain_hours=files.RETAIN_HOURS)
    command("compact", _compact, "src", "dst", target_bytes=files.TARGET_BYTES, partition_by=None)
    command(
        "skew",
        lambda s, a: skew.skew_report(_tasks(s, a.metrics, a.event_log), "stage_id", "run_time_ms", a.threshold),
        "metrics", event_log=False, threshold=skew.DEFAULT_THRESHOLD,
    )
    command(
        "timeline",
        lambda s, a: timeline(stage_times(_stages(s, a.metrics, a.event_log)), a.width),
        "metrics", event_log=False, width=DEFAULT_WIDTH,
    )
    command(
        "log",
        lambda s, a: logs.parse_driver_log(s.read.text(a.path)),
        "path",
    )
    command(
        "history",
        lambda s, a: ordering.last_lines(s, a.path, a.last),
        "path", last=20,
    )
    return parser


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = build_session("lakewright", args.master)
    result = args.run(spark, args)
    if args.out:
        export(result, args.out, args.fmt)
    else:
        show(result, args.limit)


if __name__ == "__main__":
    main()

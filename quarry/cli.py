"""Command line: ``python -m quarry.cli COMMAND``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry import tools
from quarry.config import Config
from quarry.functions.scalars import human_size
from quarry.sources import devices
from quarry.sources.indexer import Synced
from quarry.streaming.watch import index_stream, watch_tree
from quarry.workspace import Workspace, find_root, init


def session() -> SparkSession:
    return SparkSession.builder.appName("quarry").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quarry")
    parser.add_argument("--root", default=".")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("init", "sync", "mcp"):
        commands.add_parser(name)
    for name in ("upsert", "delete", "remove"):
        commands.add_parser(name).add_argument("path")
    watch = commands.add_parser("watch")
    watch.add_argument("--interval", type=float, help="seconds; else sync_interval_minutes of the configuration, else 60")
    watch.add_argument("--cycles", type=int, help="stop after so many")
    watch.add_argument("--progress", help="follow changes as a stream that keeps its progress in this folder; with --cycles up to what is there now")
    search = commands.add_parser("search")
    search.add_argument("query")
    search.add_argument("--limit", type=int, default=10)
    cache = commands.add_parser("cache")
    cache.add_argument("action", choices=["sync", "rebuild", "info", "embed", "clean", "cells", "check"])
    device = commands.add_parser("device").add_subparsers(dest="action", required=True)
    device.add_parser("list")
    device.add_parser("set-name").add_argument("name")
    device.add_parser("show").add_argument("target", nargs="?")
    given = parser.parse_args(args)
    if given.command == "init":
        print(init(given.root))
        return 0
    root = find_root(given.root)
    if root is None:
        print("no workspace here or above; use init", file=sys.stderr)
        return 1
    spark = session()
    workspace = Workspace(spark, root, Config.read())
    if given.command == "sync":
        workspace.report_device()
        print(tools.workspace_sync(workspace))
        workspace.exchange()
    elif given.command in ("upsert", "delete", "remove"):
        workspace.on_event(given.path) if given.command == "upsert" else workspace.forget(given.path)
    elif given.command == "search":
        print(tools.search(workspace, given.query, given.limit))
    elif given.command == "mcp":
        tools.serve(workspace)
    elif given.command == "watch":
        if given.progress:
            stream = index_stream(spark, workspace.store, workspace.root, given.progress, once=given.cycles is not None, on_batch=_said, line_ranges=workspace.config.line_ranges)
            stream.awaitTermination()
            return 0
        interval = given.interval if given.interval is not None else workspace.config.sync_interval or 60
        watch_tree(workspace, interval=interval, cycles=given.cycles)
    elif given.command == "cache":
        _cache(workspace, given.action)
    else:
        _device(workspace, given)
    return 0


def _said(number: int, done: Synced) -> None:
    if any(done):
        print(f"batch {number}: {done[0]} indexed, {done[1]} removed", flush=True)


def _cache(workspace: Workspace, action: str) -> None:
    if action == "sync":
        print(tools.workspace_sync(workspace))
    elif action == "rebuild":
        print(tools.workspace_rebuild(workspace))
    elif action == "embed":
        print(workspace.embed_pending(lambda done, total: print(f"{done} of {total}", file=sys.stderr)))
    elif action == "cells":
        workspace.store.build_cells()
    elif action == "check":
        workspace.store.check().show(truncate=False)
    elif action == "clean":
        gone = workspace.store.clean_stale()
        print("\n".join(f"removed: {path} ({size} bytes)" for path, size in gone) or "nothing to clean")
    else:
        print(tools.workspace_info(workspace))
        workspace.store.stale().withColumn("size", human_size(F.col("size"))).show(truncate=False)


def _device(workspace: Workspace, given: argparse.Namespace) -> None:
    if given.action == "list":
        devices.shown(workspace.devices()).show(truncate=False)
    elif given.action == "show":
        devices.find(workspace.devices(), given.target or workspace.device).show(vertical=True, truncate=False)
    else:
        workspace.report_device()
        workspace.rename_device(workspace.device, given.name)


if __name__ == "__main__":
    sys.exit(main())

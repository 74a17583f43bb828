"""Command lines: python -m tesserine.cli index|maintain|archive."""

from __future__ import annotations

import argparse
import datetime
import json
import sys

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.functions.text import index_tokens
from tesserine.operators.graph import TRIPLE
from tesserine.operators.postings import PostingsIndex
from tesserine.operators.runs import GraphStore, RunStore, archive_graph
from tesserine.sources import formats, readers


def _session() -> SparkSession:
    return SparkSession.builder.appName("tesserine").getOrCreate()


def _source(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    """The entries and the manifest of a folder's files."""
    files = readers.manifest(readers.read_files(spark, args.dir, args.pattern).drop("content"))
    if args.extractor == "jsonl":
        return readers.jsonl_entries(readers.read_lines(spark, args.dir, args.pattern)).select("file", "entry_idx", "line_no", "text"), files
    return formats.entries(spark, args.dir, args.extractor, args.pattern).withColumn("entry_idx", F.col("entry_idx").cast("int")), files


def _index(args: argparse.Namespace) -> dict:
    spark = _session()
    if args.action == "query":
        index = PostingsIndex(spark, args.index)
        if not index.store.version():
            raise ValueError(f"no index at {args.index}")
        hits = index.with_lines(index.search(index_tokens(args.query), "or" if args.any else "and")).orderBy("file", "entry_idx")
        return {"query": args.query, "hits": [{"file_idx": r["file_idx"], "entry_idx": r["entry_idx"], "file": r["file"], "line_no": r["line_no"]} for r in hits.toLocalIterator()]}
    entries, files = _source(spark, args)
    index = PostingsIndex(spark, args.output if args.action == "build" else args.index)
    if args.action == "build":
        numbered = entries.join(files.select("file", "file_idx"), "file")
        index.create(numbered, files)
        n = files.count()
        return {"unchanged": 0, "updated": 0, "added": n, "removed": 0, "total_slots": n, "needs_compact": False}
    if not index.store.version():
        raise ValueError(f"no index at {args.index}")
    return index.update(entries, files)


def _maintain(args: argparse.Namespace) -> dict:
    spark = _session()
    graphs = GraphStore(spark, args.graph)
    if not graphs.version():
        raise ValueError(f"no graph at {args.graph}")
    runs = RunStore(spark, args.runs, graphs)
    run = args.replay or runs.create(args.run_id)
    before = graphs.read(runs.record(run)["version"])
    planned = runs.run(run, args.from_stage)
    added = planned.relations.join(before.relations.select(TRIPLE), TRIPLE, "left_anti").count()
    renamed = planned.entities.join(before.entities.select("name", F.col("entity_type").alias("was")), "name").where("entity_type != was").count()
    if args.apply:
        runs.apply(run, planned)
    return {"run_id": run, "added_relations": added, "renamed": renamed, "applied": args.apply}


def _archive(args: argparse.Namespace) -> dict:
    now = datetime.datetime.fromisoformat(args.now) if args.now else datetime.datetime.now(datetime.UTC).replace(tzinfo=None)
    path = f"{args.archive_dir.rstrip('/')}/archive-{now.strftime('%Y-%m-%dT%H%M%S')}"
    done = archive_graph(GraphStore(_session(), args.graph), F.lit(now), path, args.days, args.apply)
    return done | {"archive_path": path if done["deleted"] else ""}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tesserine")
    what = top.add_subparsers(dest="what", required=True)
    index = what.add_parser("index", help="build, update or ask an index of files").add_subparsers(dest="action", required=True)
    for action in ("build", "update"):
        one = index.add_parser(action)
        one.add_argument("--dir", required=True)
        one.add_argument("--pattern", default="*")
        one.add_argument("--extractor", default="jsonl", choices=sorted(formats.extractor_names() - {"notification"}))
        one.add_argument("--output" if action == "build" else "--index", required=True)
    asked = index.add_parser("query")
    asked.add_argument("--index", required=True)
    asked.add_argument("--query", required=True)
    asked.add_argument("--any", action="store_true", help="entries that hold any of the words")
    maintain = what.add_parser("maintain", help="a maintenance run on the stored graph; without --apply nothing changes")
    maintain.add_argument("--graph", required=True)
    maintain.add_argument("--runs", required=True)
    maintain.add_argument("--run-id")
    maintain.add_argument("--replay", help="run this run again on the graph that it began with")
    maintain.add_argument("--from-stage", default="discover")
    maintain.add_argument("--apply", action="store_true")
    old = what.add_parser("archive", help="moves old observations out of the graph; without --apply it only counts")
    old.add_argument("--graph", required=True)
    old.add_argument("--archive-dir", required=True)
    old.add_argument("--days", type=int, default=90)
    old.add_argument("--now", help="the moment that ages count from, as an ISO date")
    old.add_argument("--apply", action="store_true")
    return top


def main(argv: list[str] | None = None) -> int:
    """Prints what was done as JSON; 1 and a message on standard error where it can't be done."""
    args = parser().parse_args(argv)
    try:
        print(json.dumps({"index": _index, "maintain": _maintain, "archive": _archive}[args.what](args), indent=2))
    except (ValueError, RuntimeError, OSError, PySparkException, Py4JJavaError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

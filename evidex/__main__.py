"""``python -m evidex ingest|search|deep|route|health``: the facade from a shell."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from evidex.engine import Engine
from evidex.sources.files import documents_of_files


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="evidex", description="Ingest documents and search them")
    top.add_argument("--path", required=True, help="folder of the engine's tables")
    commands = top.add_subparsers(dest="command", required=True)
    ingest = commands.add_parser("ingest", help="read a folder of PDF and XML files")
    ingest.add_argument("--dir", required=True)
    ingest.add_argument("--source", required=True)
    ingest.add_argument("--recreate", action="store_true", help="drop what is indexed before")
    ingest.add_argument("--batch-size", type=int, default=10, help="files in a task")
    for name in ("search", "deep", "route"):
        one = commands.add_parser(name)
        one.add_argument("--query", required=True, action="append")
        if name != "route":
            one.add_argument("--top-k", type=int, default=8)
    commands.add_parser("health")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    engine = Engine(spark, args.path)
    if args.command == "health":
        state = engine.health()
        print(state)
        return 0 if state["healthy"] else 1
    if args.command == "ingest":
        documents, failures = documents_of_files(spark, args.dir, args.source, batch=max(1, args.batch_size))
        engine.ingest(documents, args.source, recreate=args.recreate)
        for name, value in engine.runs().orderBy("started_at", ascending=False).first().asDict().items():
            print(f"{name}: {value}")
        failures.show(20, False)  # a report for the eye
        return 0
    asked = spark.createDataFrame(list(enumerate(args.query)), "query_id long, query string")
    if any(not q.strip() for q in args.query):
        raise SystemExit("a query is empty")
    found = engine.route(asked) if args.command == "route" else engine.search(asked, args.top_k) if args.command == "search" else engine.deep_search(asked, args.top_k)
    found.show(100, False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

"""A command line over the store: ``python -m anamnesis ROOT COMMAND ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from anamnesis.engine import MemoryEngine


def main() -> None:
    parser = argparse.ArgumentParser(prog="anamnesis")
    parser.add_argument("root", help="folder of the store")
    commands = parser.add_subparsers(dest="command", required=True)
    ask = commands.add_parser("recall")
    ask.add_argument("query")
    ask.add_argument("-k", type=int, default=5)
    ask.add_argument("--mode", choices=("fast", "deep", "excavate"), default="fast")
    write = commands.add_parser("remember")
    write.add_argument("summary")
    write.add_argument("content")
    gone = commands.add_parser("forget")
    gone.add_argument("ids", type=int, nargs="+")
    commands.add_parser("list")
    commands.add_parser("counts")
    commands.add_parser("versions")
    given = parser.parse_args()
    spark = SparkSession.builder.appName("anamnesis").getOrCreate()
    engine = MemoryEngine(spark, given.root)
    if given.command == "recall":
        engine.recall(given.query, given.k, mode=given.mode).select("id", "kind", "summary").show(truncate=False)
    elif given.command == "remember":
        engine.remember(summary=given.summary, content=given.content).show()
    elif given.command == "forget":
        print(engine.forget(given.ids))
    elif given.command == "list":
        engine.list().select("id", "kind", "summary", "status").show(truncate=False)
    elif given.command == "counts":
        engine.counts().show()
    else:
        print(*engine.store.versions())


if __name__ == "__main__":
    main()

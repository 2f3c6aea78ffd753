"""Command line: ``python -m graphquarry FOLDER COMMAND ...``.

Commands: ``create``, ``query TEXT``, ``ask QUESTION``, ``execute STATEMENT``,
``plan TEXT`` (canonical text and JSON), ``schema``, ``stats``, ``dump``,
``explain TEXT`` and ``pin NAME``. Rows are written as JSON lines.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphquarry.engine import Engine
from graphquarry.errors import InvalidArgument
from graphquarry.plans import text as P

COMMANDS = ("create", "query", "ask", "execute", "plan", "schema", "stats", "dump", "explain", "pin")


def lines(df: DataFrame):
    """Rows as JSON objects, one at a time."""
    named = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    whole = named.select(F.to_json(F.struct(*(F.col(c) for c in named.columns)), {"ignoreNullFields": "false"}).alias("j"))
    for row in whole.toLocalIterator():
        yield json.dumps(dict(zip(df.columns, json.loads(row["j"]).values())), ensure_ascii=False)


def run(spark: SparkSession, folder: str, command: str, text: str | None):
    """The lines that a command prints."""
    if command == "create":
        Engine.create(spark, folder)
        return
    e = Engine(spark, folder)
    if command in ("query", "ask", "pin"):
        yield from lines({"query": e.query, "ask": e.ask, "pin": e.run_pin}[command](text))
    elif command == "execute":
        e.execute(text)
    elif command == "plan":
        plan = e.parse(text)
        yield P.print_plan(plan)
        yield P.to_json(plan)
    elif command == "explain":
        yield e.explain(text)
    elif command == "schema":
        yield json.dumps(e.schema(), ensure_ascii=False)
    elif command == "stats":
        yield json.dumps(e.stats())
    else:
        yield from e.dump()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("graphquarry")
    parser.add_argument("folder")
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("text", nargs="?")
    args = parser.parse_args(argv)
    if args.text is None and args.command in ("query", "ask", "execute", "plan", "explain", "pin"):
        parser.error(f"{args.command} needs a text")
    spark = SparkSession.builder.appName("graphquarry").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        for line in run(spark, args.folder, args.command, args.text):
            print(line)
    except InvalidArgument as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

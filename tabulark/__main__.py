"""Commands over a store: python -m tabulark STORE import FILE... | count TEXT | search TEXT | sql QUERY | rollups | stats."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .engine import Engine
from .plans.query import Query


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tabulark", description=__doc__)
    parser.add_argument("store", help="a folder of any store that Spark writes")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("import").add_argument("files", nargs="+")
    for name in ("count", "search"):
        commands.add_parser(name).add_argument("text", nargs="?", default="")
    commands.add_parser("sql").add_argument("query")
    commands.add_parser("rollups")
    commands.add_parser("stats")
    asked = parser.parse_args(args)
    engine = Engine(SparkSession.builder.appName("tabulark").getOrCreate(), asked.store)
    if asked.command == "import":
        for file in asked.files:
            print(file, engine.ingest(file))
    elif asked.command == "count":
        print(engine.count(Query(asked.text)))
    elif asked.command == "search":
        engine.search(Query(asked.text)).show(truncate=40)
    elif asked.command == "sql":
        engine.sql(asked.query).show(1000, truncate=False)
    elif asked.command == "rollups":
        engine.build_rollups()
    else:
        engine.stats().show()
        print(engine.stored_bytes())
    return 0


if __name__ == "__main__":
    sys.exit(main())

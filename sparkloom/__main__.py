"""``python -m sparkloom QUERY --tables DIR [--out DIR | --limit N | --explain]``: runs a registered query."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from sparkloom import queries


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="sparkloom", description="Runs a registered query over a folder of tables.")
    parser.add_argument("query", nargs="?", help="a name; all names are listed without one")
    parser.add_argument("--tables", default="/root/testdata/sf0.001", help="folder of <table>.parquet")
    parser.add_argument("--out", help="folder for the result, as Parquet; shown otherwise")
    parser.add_argument("--limit", type=int, default=20, help="rows to show")
    parser.add_argument("--explain", action="store_true", help="print the plan, run nothing (dry run)")
    given = parser.parse_args(arguments)
    if not given.query:
        print("\n".join(sorted(queries.QUERIES)))
        return
    if given.query not in queries.QUERIES:
        parser.error(f"no query {given.query}")
    spark = SparkSession.builder.appName(f"sparkloom {given.query}").getOrCreate()
    result = queries.QUERIES[given.query](spark, given.tables)
    if given.explain:
        result.explain("formatted")
    elif given.out:
        result.write.mode("errorifexists").parquet(given.out)
    else:
        result.show(given.limit, truncate=False)


if __name__ == "__main__":
    main()

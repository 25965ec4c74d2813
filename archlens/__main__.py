"""Command line: python -m archlens list | run QUERY DIR [OUT] | extract FOLDER OUT."""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="archlens")
    verbs = parser.add_subparsers(dest="verb", required=True)
    verbs.add_parser("list")
    run = verbs.add_parser("run")
    run.add_argument("query")
    run.add_argument("dir")
    run.add_argument("out", nargs="?")
    extract_ = verbs.add_parser("extract")
    extract_.add_argument("folder")
    extract_.add_argument("out")
    args = parser.parse_args(argv)

    from archlens.plans.registry import QUERIES

    if args.verb == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = SparkSession.builder.appName("archlens").getOrCreate()
    if args.verb == "run":
        df = QUERIES[args.query](spark, args.dir)
        df.write.parquet(args.out) if args.out else df.show(50, truncate=False)
        return 0
    from archlens.sources import extract, inventory, sinks

    blobs = inventory.read_blobs(spark, args.folder)
    files = inventory.source_files(blobs).select("path", F.col("content").cast("string").alias("text"))
    facts = extract.python_facts(files)
    tables = {"inventory": inventory.inventory(blobs), "imports": extract.resolve_specifiers(extract.js_specifiers(files), files).unionByName(extract.python_imports(files)), "symbols": facts.where("fact = 'symbol'"), "calls": extract.call_edges(facts), "descriptions": extract.descriptions(files)}
    print(sinks.publish(tables, args.out, "latest"))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

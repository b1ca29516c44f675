"""Build, query and inspect indexes from the command line: python -m siltstone."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from siltstone.config import IndexConfig, SearchOptions, parse_field_spec
from siltstone.sources import store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siltstone", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="index documents (a JSON array, JSON lines, CSV, ORC or Parquet)")
    build.add_argument("documents")
    build.add_argument("-o", "--out", required=True)
    build.add_argument("--fields", required=True, help="name:weight or name:kind:weight, with commas between")
    build.add_argument("--store", help="fields to keep with the documents, with commas between")
    build.add_argument("--tags", help="the column of tags")
    build.add_argument("--id", default="id", help="the column of ids")
    build.add_argument("--no-fuzzy", action="store_true", help="no typo corrections")
    query = commands.add_parser("query", help="search an index")
    query.add_argument("index")
    query.add_argument("text", nargs="+")
    query.add_argument("--limit", type=int, default=10)
    inspect = commands.add_parser("inspect", help="counts and settings of an index")
    inspect.add_argument("index")
    return p


def _size(n: int) -> str:
    return f"{n} B" if n < 1024 else f"{n / 1024:.1f} KB" if n < 1024 * 1024 else f"{n / 1024 / 1024:.2f} MB"


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    said = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("siltstone").getOrCreate()
    try:
        if said.command == "build":
            listed = lambda x: tuple(s.strip() for s in x.split(",")) if x else None
            config = IndexConfig(tuple(map(parse_field_spec, said.fields.split(","))), id_column=said.id, store_fields=listed(said.store), tags_field=said.tags, fuzzy=not said.no_fuzzy)
            began = time.perf_counter()
            made = store.save_documents_index(store.read_documents(spark, said.documents), config, said.out).first()
            print(f"{made.docs} documents, {made.features} features, {made.postings} postings, {made.correction_deletes} deletions; {_size(store.index_bytes(spark, said.out))} in {time.perf_counter() - began:.1f} s")
        elif said.command == "query":
            engine = store.load_index(spark, said.index)
            hits, _, rewrites = engine.search_detailed(" ".join(said.text), SearchOptions(limit=said.limit))
            for hit in hits.orderBy("rank").collect():
                print(f"{hit['rank']:3d}  {hit.score:10.2f}  {hit.id}  {next((v for v in hit.fields.values() if v), '')[:100]}")
            instead = rewrites.first()
            if instead is not None and instead.corrected_query:
                print(f"did you mean: {instead.corrected_query}")
        else:
            engine = store.load_index(spark, said.index)
            for name, value in engine.stats().first().asDict().items():
                print(f"{name}: {value}")
            print(f"stored fields: {', '.join(engine.index.config.store_fields)}")
            print(f"size: {_size(store.index_bytes(spark, said.index))}")
    except ValueError as why:
        print(why, file=sys.stderr)
        return 1
    return 0

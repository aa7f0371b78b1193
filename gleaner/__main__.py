"""Command line: build an index, then answer queries typed in, one a line.

    python -m gleaner --data corpus.tsv --indexdir /shared/index [--buildindex] [--limit N] [--query Q] [--synonyms FILE]
    python -m gleaner --data corpus.tsv --genqueries 1000 --out queries.txt [--limit N] [--seed S]
"""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Iterable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gleaner.operators import index as ix
from gleaner.operators import search as sx
from gleaner.operators import synonyms, workload
from gleaner.plans.nodes import QueryError
from gleaner.sources import tsv


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="gleaner")
    parser.add_argument("--data", default="", help="tab-separated corpus: doc_id, url, title, text")
    parser.add_argument("--indexdir", default="", help="folder of the index")
    parser.add_argument("--buildindex", action="store_true", help="build the index and stop")
    parser.add_argument("--limit", type=int, default=0, help="documents to index, 0 for all")
    parser.add_argument("--query", help="answer one query and stop")
    parser.add_argument("--synonyms", default="", help="tab-separated term, synonym, rank")
    parser.add_argument("--genqueries", type=int, default=0, help="write so many random queries over --limit documents and stop")
    parser.add_argument("--out", default="", help="file of the random queries")
    parser.add_argument("--seed", type=int, default=workload.SEED)
    found = parser.parse_args(args)
    if found.genqueries and not found.out:
        parser.error("--genqueries needs --out")
    if not found.genqueries and not found.indexdir:
        parser.error("--indexdir is required")
    return found


def generate(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    """Random queries over the first ``limit`` documents (1,000 if none is given), written to ``out``."""
    docs = tsv.load(spark, args.data, args.limit or 1_000).select(F.concat_ws(" ", "title", "body").alias("t"))
    made = workload.generate([r["t"] for r in docs.collect()], args.genqueries, args.seed)
    tsv.write_queries(spark, args.out, made)
    return made


def synonym_table(spark: SparkSession, path: str):
    """Synonyms of the terms in a tab-separated file, by rank."""
    rows = spark.read.csv(path, sep="\t", schema="term string, synonym string, rank int", quote="")
    return synonyms.from_table(rows, [r["term"] for r in rows.select("term").distinct().collect()])


def respond(index: ix.Index, lines: Iterable[str], out=print, provider=None) -> None:
    """Answers each line until ``>exit`` or the end; a bad query gets its message."""
    for line in lines:
        query = line.strip()
        if query == ">exit":
            return
        if not query:
            out("type a query, or >exit to leave")
            continue
        began = time.monotonic()
        try:
            response = sx.search(index, query, synonyms=provider)
        except QueryError as e:
            out(f"error: {e}")
            continue
        for row in sx.rendered(sx.enrich(response.bm25, index.documents)).collect():
            out(row["line"])
        out(f"{response.total} hits in {time.monotonic() - began:.3f} s")


def main() -> None:
    args = arguments()
    spark = SparkSession.builder.appName("gleaner").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if args.genqueries:
        print(f"{len(generate(spark, args))} queries")
        return
    if args.buildindex:
        ix.build_index(spark, args.data, args.indexdir, args.limit)
        print(ix.manifest(spark, args.indexdir))
        return
    respond(ix.ensure_index(spark, args.data, args.indexdir, args.limit), [args.query] if args.query else sys.stdin, provider=synonym_table(spark, args.synonyms) if args.synonyms else None)


if __name__ == "__main__":
    main()

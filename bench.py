"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR: folder of tables (default /root/testdata/sf0.1). BENCH_CPUS: local cores (default 8). The index
is built, written sorted and read from there, as serving does; its build and writing is timed as index_build.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from gleaner import registry

SERVING = ["term_bm25_top10", "and_query", "or_query", "and_not_query", "nested_parens_query", "phrase_query", "phrase_over_stopword", "mixed_precedence_query", "top10_enriched", "hit_total", "batch_bm25_top10_per_query", "vector_top10"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # the session's own start isn't the engine's
    seconds: dict[str, float] = {}

    began = time.perf_counter()
    index = registry.index_of(spark, sf_dir)
    documents = index.stats.documents
    seconds["index_build"] = time.perf_counter() - began

    found = registry.queries()
    for name in SERVING:
        best = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            found[name](spark, sf_dir).collect()
            best = min(best, time.perf_counter() - began)
        seconds[name] = best
    out = {
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": {k: round(v, 4) for k, v in seconds.items()},
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "docs_per_second_build": round(documents / seconds["index_build"], 1),
    }
    print(json.dumps(out), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()

"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 1: runs after a warm-up, of
which the median counts; a query whose warm-up takes over fifteen seconds is not run again).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from folioscope.plans import bindings, load
from folioscope.session import local_session

HEADLINE = [
    "library_counts", "library_first_page", "library_page", "library_search", "build_postings", "search", "classify_titles",
    "key_sentences", "taste_profile", "score_candidates", "curate_plan", "leader_cluster", "select_briefing", "page_metadata",
]


def library_520k(spark, sf_dir):
    """The library repeated to about 520,000 rows, written once: the size the published counts refer to."""
    from pyspark.sql import functions as F

    from folioscope.session import stage

    a = bindings.articles(spark, sf_dir).select("id", "topic", "subtopic", "locked", "notes_count", "added", "doc_id", "title")
    times = max(1, round(520_000 / max(1, a.count())))
    return stage(a.select("*", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("copy")).repartition(int(os.environ.get("BENCH_CPUS", "8"))), "lib520k")


def timed(run, runs):
    started = time.perf_counter()
    run()
    first = time.perf_counter() - started
    if first > 15:
        return round(first, 3)
    took = []
    for _ in range(runs):
        started = time.perf_counter()
        run()
        took.append(time.perf_counter() - started)
    return round(statistics.median(took), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cpus, **{"spark.sql.shuffle.partitions": cpus})
    queries, _ = load()

    def noop(df):
        df.write.format("noop").mode("overwrite").save()

    out = {}
    for name in HEADLINE:
        out[name] = timed(lambda n=name: noop(queries[n](spark, sf_dir)), runs)
        print(f"{name}: {out[name]}", file=sys.stderr, flush=True)

    from pyspark.sql import functions as F

    from folioscope.operators import library

    big = library_520k(spark, sf_dir)
    tree = big.select("topic", "subtopic").distinct()
    out["library_counts_520k"] = timed(lambda: noop(library.counts(big, tree)), runs)
    out["library_first_page_520k"] = timed(
        lambda: noop(library.first_page(big, [F.desc("added"), F.asc("doc_id"), F.asc("copy")], topic="en")), runs)

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").count()
    readers = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().count()
    rates = {
        "search_queries_per_sec": round(asked / out["search"], 2),
        "build_postings_docs_per_sec": round(docs / out["build_postings"], 1),
        "classify_titles_per_sec": round(docs / out["classify_titles"], 1),
        "key_sentences_docs_per_sec": round(docs / out["key_sentences"], 1),
        "score_candidates_readers_per_sec": round(readers / out["score_candidates"], 2),
    }
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "rates": rates,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()

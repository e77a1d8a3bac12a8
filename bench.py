"""Times the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

The index is built once and timed on its own, as ``index_build``; the searches after it reuse it.
A short run over the smallest tables, if they lie beside, starts the JVM and the Python workers.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from helpgrid.plans import tables
from helpgrid.plans.queries import QUERIES
from helpgrid.session import local_session

HEADLINE = (
    "hybrid_retrieve",
    "keyword_retrieve",
    "dense_topk",
    "hybrid_alpha_sweep",
    "benchmark_passage_retrieval",
    "stream_triage",
    "smoothed_idf",
    "tfidf_weights",
    "index_refresh",
    "eval_summary_tiers",
    "triage_prompt",
    "response_extract",
    "judgement_summary",
    "generated_array_explode",
    "kb_growth",
)


def timed(work) -> float:
    start = time.perf_counter()
    work()
    return round(time.perf_counter() - start, 3)


def run(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = local_session(cpus, shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")

    small = str(Path(sf_dir).parent / "sf0.001")
    if small != sf_dir and os.path.isdir(small):
        run(QUERIES["hybrid_retrieve"](spark, small))

    seconds = {"index_build": timed(lambda: tables.index(spark, sf_dir))}
    for name in HEADLINE:
        seconds[name] = timed(lambda: run(QUERIES[name](spark, sf_dir)))
    print(
        json.dumps(
            {
                "metric": "helpgrid_headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

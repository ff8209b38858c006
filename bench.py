"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS
(timed runs per query after one warm-up, default 1; the median counts) and
BENCH_QUERIES (comma-separated names, or ``all``) choose what is measured. Every
query is computed to the last row and column and written nowhere.
"""

from __future__ import annotations

import contextlib
import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from textloom.plans.catalog import QUERIES  # noqa: E402
from textloom.session import build_session  # noqa: E402

HEADLINE = [
    "text_metrics_by_source", "document_metrics", "document_word_frequency", "document_perplexity",
    "uniformity_score", "document_intake", "mask_citations", "mask_math", "mask_roundtrip", "chunk_documents",
    "prepared_chunks", "finished_documents", "slice_text", "candidate_selection", "convergence_flags",
    "failover_resolution", "quota_usage", "requests_per_minute", "page_block_table", "distributed_blocks",
    "overflow_report", "fitted_paragraphs", "runs_with_chunks", "sequence_audit", "error_feed", "run_states_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    settings = {
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false",
    }
    with contextlib.redirect_stdout(sys.stderr):
        spark = build_session(f"local[{cpus}]", **settings)
        spark.sparkContext.setLogLevel("ERROR")
        seconds: dict[str, float] = {}
        for name in names:
            taken = []
            for _ in range(runs + 1):
                start = time.perf_counter()
                QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                taken.append(time.perf_counter() - start)
            seconds[name] = round(statistics.median(taken[1:]), 3)
            print(name, [round(t, 2) for t in taken], file=sys.stderr, flush=True)
        spark.stop()
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                "sf": float(scale.group(1)) if scale else None, "cpus": int(cpus), "runs": runs, "settings": settings,
            }
        )
    )


if __name__ == "__main__":
    main()

"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line.

Each query is planned and written to the ``noop`` sink ``$BENCH_RUNS`` times after one warm-up run; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from corpusloom import plans  # noqa: E402
from corpusloom.session import local_session  # noqa: E402

HEADLINE = (
    "line_counts", "duplicate_blocks", "credential_findings", "repo_health", "cosine_topk_batch", "lexical_topk", "hybrid_rrf",
    "tree_listing", "code_quality_findings", "code_security_findings", "import_edges", "trace_evidence", "test_runs",
)


def run(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    plans.load_all()
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    seconds = {}
    for name in names:
        run(spark, sf_dir, name)
        seconds[name] = round(statistics.median(run(spark, sf_dir, name) for _ in range(runs)), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": Path(sf_dir).name,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

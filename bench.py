"""Benchmark: run the headline queries at $BENCH_SF_DIR (default
/root/testdata/sf0.1) on local[$BENCH_CPUS] and print one JSON line.

Each query is executed in full through the ``noop`` sink (every row is
computed, nothing is collected to the driver); the median of $BENCH_RUNS
timed runs per query (default 3; the median drops the cold first run), after
$BENCH_WARMUP untimed passes over all queries (default 1: JIT and file-listing warm-up).  Fitted models are dropped before
every run, so the FP-Growth and ALS queries include their training time.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "popular_movies",            # flagship: aggregate + global top-n + lookup
    "ratings_clean",             # two aggregates + two semi joins
    "transactions",              # window top-k per user + collect_set
    "association_rules_015",     # FP-Growth at the default support
    "rule_recommendations",      # FP-Growth + per-item top-k + de-dup
    "related_index",             # FP-Growth + max-lift pairs + ordered lists
    "search_titles_regex",       # regex scan + top-n
    "movie_detail",              # JSON projection
    "user_feed",                 # three-tier fallback, resolved
    "movie_feed",                # rules tier + popular fallback, resolved
    "movie_pages",               # feed + catalogue details
    "user_index_map",            # contiguous indexing
    "als_popular_gated",         # ALS fit + candidates + popularity gate
]


def main() -> None:
    from reelrank.plans import queries as Q
    from reelrank.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = local_session(cpus, shuffle_partitions=max(8, 2 * cpus), app="reelrank-bench")

    def run(name: str) -> float:
        for model in Q._models.values():
            if hasattr(model, "freqItemsets"):
                model.freqItemsets.unpersist()
        Q._models.clear()
        t0 = time.perf_counter()
        Q.REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    for _ in range(int(os.environ.get("BENCH_WARMUP", "1"))):
        for name in names:
            run(name)
    times = {name: round(statistics.median(run(name) for _ in range(runs)), 3) for name in names}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_queries_total_median_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
        "runs": runs,
    }))


if __name__ == "__main__":
    main()

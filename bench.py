"""Seconds per headline query at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

BENCH_QUERIES=all (or a comma list) measures others; BENCH_RUNS sets the number of warm runs, of which the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "term_counts top_terms mention_join resolve_identity entity_rollup norm_match compact_docs chunk_docs prose_filter content_hash "
    "upsert_customers insert_if_absent promote_legacy plan_missing alias_lookup entity_link tag_rules facet_counts rank_search "
    "co_usage panel_usage asof_above sequential_pairing overlap_join region_evidence figure_table usage_rollup daily_ledger "
    "build_requests stream_ledger"
).split()


def main() -> None:
    from corpuskit.plans.catalog import QUERIES
    from corpuskit.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE
    spark = local_session(cpus, app="bench")
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("row_count")
    seconds = {}
    for name in names:
        first = run(name)
        seconds[name] = round(statistics.median([run(name) for _ in range(runs)]) if runs else first, 3)
        print(f"{name}: first {first:.2f}, warm {seconds[name]:.2f}", file=sys.stderr, flush=True)
    scale = os.path.basename(folder.rstrip("/"))
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {"metric": f"sum of warm query times at {scale} on local[{cpus}]", "value": total, "unit": "sec", "queries": seconds, "sf": scale.removeprefix("sf")}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

"""Run the headline queries and print one JSON line with seconds per query.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

from notelattice.session import local_session
from notelattice.plans.queries import REGISTRY

HEADLINE = [
    "search_relevance",
    "search_or",
    "search_type_filter",
    "search_batch",
    "trigram_postings",
    "tags_and",
    "stats",
    "neighbors_out",
    "neighbors_in",
    "orphans",
    "shared_links_batch",
    "lint",
    "broken_links",
    "maintain_full",
    "parse_roundtrip",
    "extract_wikilinks",
    "timeline_stats",
    "reindex",
    "sync_classify",
    "sync_pages",
    "sync_links",
    "edits_apply",
    "stream_sync_pages",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    # Start-up (class loading, first code generation) is not a query's cost.
    REGISTRY["parse_roundtrip"](spark, sf_dir).limit(1).collect()
    seconds: dict[str, float] = {}
    for name in names:
        begin = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

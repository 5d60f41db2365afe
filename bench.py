"""Headline queries, timed: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 1).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from loglattice import catalog  # noqa: E402
from loglattice.session import local_session  # noqa: E402

HEADLINE = (
    "query_logs",
    "scan_journald",
    "validate_records",
    "noise_summary",
    "log_hashes",
    "canonicalize_logs",
    "canonicalize_documents",
    "template_dimension",
    "resolve_templates",
    "accept_new_events",
    "ingest_twice",
    "recent_examples",
    "search_logs",
    "search_templates",
    "embed_documents",
    "retention_report",
    "report_gaps",
    "report_service_share",
    "detect_error_spikes",
    "detect_context",
    "stream_ingest",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session("bench", cores, os.environ.get("BENCH_MEMORY", "12g"))
    catalog.QUERIES["report_hosts"](spark, folder).collect()  # start the JVM, warm the file cache
    seconds = {}
    for name in HEADLINE:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            # every row is computed and none is brought to the driver
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - start
            best = spent if best is None else min(best, spent)
        seconds[name] = round(best, 3)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": float(scale)}))


if __name__ == "__main__":
    main()

"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is planned and run once on sf0.001 first (code generation warm-up, independent of data size), then timed
at the bench scale with a no-op sink (full execution, nothing collected to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "frontier_next", "link_edges", "links_resolved", "canonical_urls", "queue_urls", "alias_global", "scope_default",
    "frontier_admitted", "params_by_page", "params_unique", "param_summary", "redirect_chains", "similar_bodies",
    "exact_bodies", "report_lines", "status_by_host", "url_indegree", "discovery_candidates",
    "frontier_rounds", "crawl_report", "stream_param_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    os.environ.setdefault("WEBMINE_MASTER", f"local[{cpus}]")
    from webmine.plans.queries import REGISTRY
    from webmine.session import get_session

    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    keys = [k for k in HEADLINE if k in REGISTRY]
    if os.path.isdir(warm_dir):
        for k in keys:
            REGISTRY[k](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for k in keys:
        t0 = time.time()
        REGISTRY[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[k] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()

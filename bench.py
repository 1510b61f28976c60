"""Time the headline queries: one JSON line on standard output."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from counterpane.plans.queries import QUERIES  # noqa: E402
from counterpane.session import local_session  # noqa: E402

HEADLINE = ["nun_euclidean", "nun_dtw", "knn_euclidean", "knn_manhattan", "dist_dtw", "dist_soft_dtw", "dist_gak",
            "panel_events", "score_centroid", "cam", "naive_candidates", "evaluated_masks", "pareto_front",
            "pareto_rank", "assign_niche", "survivors", "searched_masks", "explain_all"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = local_session(cpus, cpus, "bench")
    for name in ("score_conv", "panel_long_roundtrip"):  # start the JVM's and Python's workers once
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()

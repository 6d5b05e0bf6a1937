"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the data and the cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from folioline.plans.queries import QUERIES
from folioline.session import local_session

HEADLINE = [
    "ocr_quality_route",
    "gate_exact",
    "gate_fuzzy",
    "cost_by_document",
    "cost_global",
    "group_pages",
    "parse_replies",
    "merge_fields",
    "document_records",
    "skip_records",
    "bucket_listing",
    "delete_by_key",
    "template_normalise",
    "model_requests",
    "skew_angle",
    "otsu_threshold",
    "stream_costs",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, partitions=int(cores), app="folioline-bench")
    # Starting the JVM's caches and the Python workers is no query's cost.
    QUERIES["gate_fuzzy"](spark, "/root/testdata/sf0.001").count()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 2)
    line = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 2),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()

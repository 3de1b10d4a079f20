"""Headline queries on ``local[$BENCH_CPUS]``; prints one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_ONLY (names, optional)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wishgrid.queries import QUERIES  # noqa: E402
from wishgrid.session import build_session  # noqa: E402

HEADLINE = [
    "j4_radius_join",
    "j6_radius_or_nearest",
    "a1_poi_profile",
    "a4_fold_facts",
    "a11_usage_report",
    "j18_criteria_listings",
    "a18_facet_stats",
    "p15_public_params",
    "u7_merge_catalog",
    "w4_rank_by_landmark",
    "w7_narrow",
    "e24_assemble_criteria",
    "e18_landmark_requirements",
    "f1_match_gazetteer",
    "f10_semantic_lookup",
    "a13_corpus_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_ONLY", "").split()
    spark = build_session("bench", cores=cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    times: dict[str, float] = {}
    for name in only or HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    wishes = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    extra = {}
    if "e24_assemble_criteria" in times:
        extra["ms_per_wish"] = round(1000 * times["e24_assemble_criteria"] / wishes, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                **extra,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

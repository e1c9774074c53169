"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with a ``noop`` write (every row computed, none
collected to the driver). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ratecraft.plans.catalog import FULL  # noqa: E402
from ratecraft.plans.catalog import QUERIES as CHECKED  # noqa: E402
from ratecraft.plans.flagship import recommend_for_profile  # noqa: E402
from ratecraft.session import env_cpus, local_session  # noqa: E402

# Model queries are timed in full, not in the form that SQL can check.
QUERIES = {**CHECKED, **FULL}

HEADLINE = [
    "parse_ratings", "item_stats", "rating_stats", "split_sizes", "training_union",
    "enrich_predictions", "popular_top_n", "unrated_top_n", "recs_json", "rmse_pairwise",
    "select_best", "als_rmse", "als_rank_search", "als_recommend", "als_recommend_all",
    "als_refresh",
]


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = env_cpus(8)
    log_dir = os.environ.get("BENCH_EVENT_LOG_DIR")
    # Optional event log (a scratch folder) for tools/stage_times.py.
    spark = local_session(cpus, extra={"spark.eventLog.enabled": "true",
                                       "spark.eventLog.dir": log_dir} if log_dir else None)
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    times: dict[str, float] = {}
    # Warm the JVM (JIT, ALS code paths) and one Python worker per core once,
    # untimed, on a smaller fixture when present: steady-state timings, not
    # first-call ones.
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.01")
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    _run(QUERIES["item_counts"](spark, warm_dir))
    _run(QUERIES["als_recommend"](spark, warm_dir))
    _run(QUERIES["unrated_top_n"](spark, warm_dir))
    for name in (only or HEADLINE):
        spark.sparkContext.setJobDescription(name)
        t0 = time.perf_counter()
        if name == "flagship":
            _run(recommend_for_profile(spark, sf_dir))
        else:
            _run(QUERIES[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - t0, 3)
    if not only:
        spark.sparkContext.setJobDescription("flagship")
        t0 = time.perf_counter()
        _run(recommend_for_profile(spark, sf_dir))
        times["flagship"] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus}))


if __name__ == "__main__":
    main()

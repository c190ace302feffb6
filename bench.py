"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lumatlas.plans import catalog  # noqa: E402
from lumatlas.plans.views import Views  # noqa: E402
from lumatlas.session import local_session  # noqa: E402

HEADLINE = (
    "join_reverse_geocode join_nearest_leaf agg_fuse_posterior agg_hierarchy_decision agg_best_detection join_text_words "
    "join_knn agg_retrieval_vote join_classifier join_same_day join_group_best agg_street_verdict join_nearby "
    "join_facing_building agg_accuracy agg_calibration join_horizon win_skyline_rank set_patch_photos"
).split()


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    v = Views(spark, folder)
    v.lineitem.agg({"l_orderkey": "count"}).collect()  # JVM warm-up, not timed
    plans = {k: catalog.queries()[k] for k in HEADLINE}
    plans["locate"] = catalog.flagship
    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name, fn in plans.items():
        t = time.perf_counter()
        try:
            run(fn(v))
        except Exception as e:  # noqa: BLE001 - one failing query must not hide the others' times
            failed[name] = str(e).splitlines()[0][:200]
            continue
        times[name] = round(time.perf_counter() - t, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_wall", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "failed": failed, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()

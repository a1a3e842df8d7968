"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores.  Every query
is run twice and the second run counts (a run over 20 s
counts at once); the value is the sum of the timed runs.  ``stage_tables`` is
the time to derive and write the frame, box and future tables the other queries read.
"""

from __future__ import annotations

import json
import os
import time

from kerbside.plans import catalog
from kerbside.plans.views import Views
from kerbside.session import local_session

HEADLINE = [
    "b4_actor_boxes", "e2_annotation_chain", "e5_future_local", "j1_extract_fact", "t10_template_trace",
    "f6_l2_by_gear", "f5_trajectory_score", "f7_faithfulness", "f8_distinct_ngrams", "d17_confidence_match",
    "f9_detection_table", "f12_average_precision", "f16_planning_l2", "f23_calibration", "k1_occupancy_raster",
    "d19_layers_on_point", "n9_global_running_sum", "l3_track_lifecycle",
]


def consume(df) -> None:
    """Compute every column of every row without collecting anything."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    timings: dict[str, float] = {}
    start = time.time()
    v = Views(spark, sf_dir)
    v.all_boxes, v.futures, v.facts("gt")  # noqa: B018  (each writes its stage table)
    timings["stage_tables"] = round(time.time() - start, 3)
    for name in HEADLINE:
        for _ in range(2):
            start = time.time()
            consume(catalog.QUERIES[name](spark, sf_dir))
            timings[name] = round(time.time() - start, 3)
            # warming up matters for short runs only
            if timings[name] > 20:
                break
    print(json.dumps({
        "metric": "headline_total_seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()

"""Time the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans.named_queries import QUERIES  # noqa: E402
from tidemark.session import local_session  # noqa: E402
from tidemark.storage import ship_package  # noqa: E402

HEADLINE = [
    "shared_step_quality",
    "train_two_rounds",
    "local_fit",
    "local_fit_rounds",
    "learning_curve",
    "gradient_step",
    "softmax_gradient",
    "predict",
    "class_report",
    "buffer_occupancy",
    "buffer_evictions",
    "buffer_at_training",
    "release_schedule_sequential",
    "release_schedule_bounded",
    "clock_gap",
    "iteration_overlap",
    "weights_at_release",
    "weight_history",
    "metric_series",
    "hash_text",
    "text_rounds",
    "decode_tagged_json",
    "stream_adaptive_buffer",
    "stream_training_sequential",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores=cpus, spark__checkpoint__dir=tempfile.mkdtemp(prefix="bench-"))
    ship_package(spark)
    QUERIES["shared_step_quality"](spark, sf).collect()  # start the Python workers
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()

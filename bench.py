"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every query runs once to warm up and then ``$BENCH_REPEATS`` times (3 by default); the median counts.
Results are written to the no-op sink, so that all rows are produced and none is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from airframe.plans import catalog  # noqa: E402
from airframe.session import build_session  # noqa: E402

HEADLINE = [
    "daily_aqi",
    "impute_readings",
    "interpolate_linear",
    "positional_split",
    "hourly_pattern",
    "score_forecast",
    "describe_table",
    "data_summary",
    "ks_statistic",
    "dedup_rows",
    "chunk_text",
    "pii_redact",
    "input_guard",
    "output_guard",
    "rouge_l",
    "knn_topk",
    "counter_rate",
    "bucket_histogram",
    "histogram_quantile",
    "usage_by_model",
    "windowed_rate",
    "regression_metrics",
    "train_linear",
]

#: Told apart from the headline, whose sum is compared from round to round: one run after one to warm up.
FURTHER = ["cv_compare", "backtest", "text_cosine", "sketch_summary", "guard_event_log", "stream_guard_counts", "stream_safety"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(name: str, repeats: int) -> float:
        runs = []
        for _ in range(repeats + 1):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        return round(statistics.median(runs[1:]), 3)

    seconds = {name: timed(name, repeats) for name in names}
    further = {name: timed(name, 1) for name in FURTHER} if names is HEADLINE else {}
    spark.stop()
    total = round(sum(seconds.values()), 3)
    told = {"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "further": further, "sf": os.path.basename(sf.rstrip("/")), "cpus": int(cpus)}
    print(json.dumps(told))


if __name__ == "__main__":
    main()

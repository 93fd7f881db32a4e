"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from plantwatch.registry import QUERIES
from plantwatch.session import build_session

HEADLINE = (
    "top_risk", "list_nodes", "failure_heatmap", "diagnostic", "recent_stats", "sensor_readings", "process_readings",
    "attach_nominals", "alert_stream", "alerts_with_context", "lag_windows", "lag_windows_bucketed", "trailing_frames",
    "zscore_stats", "stratified_split", "score_timeline", "per_label_report", "any_failure_report", "operating_point",
    "class_histogram", "detection_by_mode", "elementwise_mean", "build_labels", "build_chat_rows", "run_summary",
    "field_confusion", "best_epoch", "work_orders", "root_cause_verdict", "isolation_forest", "windowed_health",
    "windowed_scores",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        "bench",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["top_risk"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

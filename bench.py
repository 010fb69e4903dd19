"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tidewire.plans import catalogue  # noqa: E402
from tidewire.session import local_session  # noqa: E402

HEADLINE = [
    "daily_label_table", "daily_variant_table", "daily_threat_act_table", "fixed_panel_shift",
    "grouping_strategies", "upsert_keep_last", "url_deduplicated", "keyword_matches",
    "daily_event_table", "perception_indices", "anticipation_episodes", "weekly_resample",
    "hac_regression", "label_race_same_day", "predictor_forecast_tests", "combined_forecasts",
    "supremum_break", "candidate_validation", "two_way_demeaned", "ridge_race", "asset_rules",
    "escalation_grid", "confidence_set", "reused_label_table", "streamed_daily_labels",
    "streamed_activity_blocks", "streamed_distinct_urls",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench")
    queries = catalogue.all_queries()
    spark.read.parquet(f"{folder}/lineitem.parquet").count()  # start the executors
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": Path(folder).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full into Spark's ``noop`` sink (nothing is collected on
the driver).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyscope.plans.registry import QUERIES  # noqa: E402
from tallyscope.session import get_session  # noqa: E402

HEADLINE = [
    "describe_measure", "describe_by_category", "describe_lineitem_price", "iqr_flags", "headline",
    "daily_trend", "monthly_trend", "weekday_profile", "week_over_week", "linear_trend",
    "customer_summary", "pareto_share", "category_breakdown", "top_products",
    "rapid_repeat", "duplicate_signature", "daily_spike", "data_gap", "cohort_retention",
    "anomaly_table", "judgment", "price_volume_contradiction", "ranked_findings",
    "typed_amounts", "typed_timestamps", "quality_report", "strip_markup", "classify_documents",
    "inr_display", "chart_series", "rate_limit_windows", "apply_manual_bans",
    "hourly_quota_bans", "daily_trend_stream", "rapid_repeat_stream", "kpi_table", "chart_tags",
    "cohort_matrix", "confidence_grade", "read_delimited_roundtrip",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    # warm-up: JVM, codegen caches and parquet footers
    QUERIES["daily_trend"](spark, sf).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf.rstrip("/")).replace("sf", ""), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()

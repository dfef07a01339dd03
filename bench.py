"""Times headline queries on local Spark and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (8), BENCH_RUNS (3, the median is kept) and
BENCH_QUERIES (comma-separated names, or "all") can be set. Each query is run once first and its rows
are produced in full but not stored.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans import all_queries  # noqa: E402
from tidemark.session import build_session  # noqa: E402

HEADLINE = [
    "gold_portfolio_risk", "gold_portfolio_performance", "gold_sector_allocation", "gold_top_holdings", "gold_top5_per_portfolio",
    "gold_investment_summary", "gold_security_type_summary", "silver_daily_prices", "silver_dedupe", "silver_identifier_map",
    "silver_currency_convert", "silver_rule_validate", "silver_weight_pct", "silver_nav_period_returns", "scd2_build",
    "scd2_point_in_time", "feat_sma", "feat_ema", "feat_max_drawdown", "feat_portfolio_composition", "train_dataset",
    "pred_backtest", "mask_client_pii", "row_filter_client_tier", "mon_credits_by_role", "mon_query_performance",
    "mon_data_transfer", "audit_pii_access", "audit_risk_score", "dq_value_summary", "dq_summary_view_profile",
    "stream_queue_load",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    wanted = os.environ.get("BENCH_QUERIES", "")
    known = all_queries()
    names = list(known) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    spark = build_session("tidemark-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.files.maxPartitionBytes": str(4 << 20), "spark.sql.files.openCostInBytes": str(1 << 20)})
    spark.sparkContext.setLogLevel("OFF")

    def once(name: str) -> float:
        start = time.perf_counter()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    label = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    scale = float(label) if label.replace(".", "", 1).isdigit() else label
    seconds = {}
    for name in names:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total seconds over headline queries (median run each)", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Seconds per headline query on $BENCH_SF_DIR, as one JSON line.

Every query is run once to warm up, then timed; the figure is the median. Results
go to a sink that reads every row and keeps none, so all columns are computed."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerloom.session import local_session
from ledgerloom.workload.queries import QUERIES

HEADLINE = [
    "monthly_spend", "weekly_spend", "money_parse", "fingerprints", "account_resolution", "occurrence_numbers",
    "overlap_dedupe", "match_transactions", "deduplicated_monthly_spend", "current_balances", "latest_holdings",
    "net_worth_delta", "account_breakdown", "coverage_gaps_orders", "coverage_calendar", "coverage_pivot",
    "contiguous_end", "balance_continuity", "derived_ledger", "normalize_transactions", "normalize_holdings",
    "running_liability_balance", "layout_detection", "text_segmentation", "parse_chase", "parse_natwest_statement",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds = {}
    for name in names:
        run(name)
        seconds[name] = round(statistics.median(run(name) for _ in range(repeats)), 3)
    print(
        json.dumps(
            {
                "metric": "total seconds, headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": cpus,
                "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"), "repeats": repeats,
            }
        )
    )


if __name__ == "__main__":
    main()

"""Time the headline queries and print one JSON line.

Each query runs once to warm up and then ``BENCH_RUNS`` times into a sink that
discards the rows; the median of the timed runs counts. Building the query is
part of the run, because some queries stage an intermediate table.
"""

from __future__ import annotations

import json
import os
import pathlib
import statistics
import sys
import tempfile
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from ledger_spark.plans.queries import registry
from ledger_spark.session import build_session
from ledger_spark.staging import release

HEADLINE = (
    "normalized_transactions",
    "monthly_cash_flow",
    "monthly_income_vs_expenses",
    "monthly_income_vs_expenses_by_account",
    "category_spending",
    "monthly_category_spending_by_account",
    "spending_breakdown",
    "spending_breakdown_by_account",
    "category_trend",
    "summary",
    "summary_by_account",
    "running_balance",
    "running_balance_by_account",
    "top_income_sources_by_account",
    "recurring_expenses_by_account",
    "large_expenses",
    "large_expenses_by_account",
    "pattern_lines_by_account",
    "health_score",
    "health_score_by_account",
    "explore_filtered",
    "explore_summary",
    "page_assembly",
    "clean_statement_text",
    "parse_responses",
    "repair_truncated",
    "facts_block_by_account",
    "report_set",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        shuffle_partitions=cpus,
        extra={
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-stage-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry()
    times: dict[str, float] = {}
    for name in chosen:
        taken = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - started)
            release(spark)
        times[name] = round(statistics.median(taken[1:]), 4)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": pathlib.Path(folder).name.removeprefix("sf"),
                "cpus": cpus,
                "runs": runs,
            }
        )
    )


if __name__ == "__main__":
    main()

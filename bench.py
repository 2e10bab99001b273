"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all), BENCH_RUNS
(default 2 warm runs; the median counts).  Every query runs to completion into a
sink that drops the rows, so the whole result is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tallybook.catalog import QUERIES  # noqa: E402
from tallybook.session import build_session  # noqa: E402

HEADLINE = (
    "store_monthly", "store_sku_daily", "store_sku_totals", "marketplace_sku_totals", "land_shipment_report",
    "supersede_range_upsert", "upsert_latest_by_key", "audit_superseded_rows", "erp_sku_channel_pivot", "refunds_month",
    "five_channel_month", "inventory_rollup", "po_rollup", "stock_risk", "mailer_demand", "line_fulfilment",
    "import_marketplace_csv", "sellout_transition",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(cpus, "tallybook-bench")
    seconds = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        # The first run pays for compilation.
        seconds[name] = round(statistics.median(times[1:] or times), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": cpus,
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()

"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from sparkloom.plans import catalog
from sparkloom.plans.session import session

HEADLINE = ["pricing_summary", "agg_stats", "agg_first_last_by", "join_inner_whole", "join_outer_whole", "join_asof_backward", "join_asof_nearest", "win_cum", "win_rolling", "win_rank", "win_over_agg", "dyn_tumbling", "dyn_sliding", "dyn_calendar_month", "pivot_last", "unique_first", "row_index", "str_regex", "dt_fields", "math_binary_guarded", "horizontal_ops", "arr_stats"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, **{"spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    made, took = catalog.queries(), {}
    made["pricing_summary"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # compiles and warms up
    for name in HEADLINE:
        began = time.perf_counter()
        made[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, wall time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

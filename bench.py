"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is run once to warm up and once timed. Stored stages are forgotten before
each run, so a time always covers the whole work from the driver tables on.
"""

from __future__ import annotations

import json
import os
import time

from firmwatt.checks import queries as registered
from firmwatt.session import local_session

HEADLINE = [
    "daily_surplus",
    "monthly_energy",
    "nearest_tower",
    "upwind_rank",
    "wake_speeds",
    "turbine_power",
    "wind_plant",
    "max_power_point",
    "inverter_fit",
    "solar_plant",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = registered.queries(), {}
    for name in HEADLINE:
        for _ in range(2):
            registered.forget_stages()
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

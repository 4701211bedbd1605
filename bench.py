"""Benchmark the headline queries.

Runs each headline query at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints one JSON line:
``{"metric": "headline_total", "value": N, "unit": "sec", "queries": {...}, "sf": ...}``.
Every result is fully executed with the ``noop`` sink (no collect to the driver).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tricolor.plans.registry import HEADLINE, queries  # noqa: E402
from tricolor.plans.workflow import flagship_metrics  # noqa: E402
from tricolor.session import get_spark  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    only = sys.argv[1:]
    t0 = time.time()
    spark = get_spark()
    startup = time.time() - t0
    qs = queries()
    names = only or list(HEADLINE)
    times: dict[str, float] = {}
    errors: dict[str, str] = {}
    for name in names + ([] if only else ["flagship"]):
        t = time.time()
        try:
            df = flagship_metrics(spark, sf_dir) if name == "flagship" else qs[name](spark, sf_dir)
            df.write.mode("overwrite").format("noop").save()
            times[name] = round(time.time() - t, 3)
        except Exception as e:  # noqa: BLE001
            errors[name] = str(e)[:200]
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir, "startup_sec": round(startup, 3),
           "cpus": int(os.environ.get("BENCH_CPUS", "8"))}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()

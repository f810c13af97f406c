"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the local cores. Three
groups: from the raw events, from prepared tables, and (``wide_``) from
prepared tables with one station per user.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession

from dockwatch.catalog import PLANS, QUERIES, Data
from dockwatch.session import local_session, stage

# From the raw events to the answer.
FROM_RAW = ["snapshot_dedupe", "station_master", "history_build", "weekly_profile"]
# From prepared tables, as a serving layer or a training job would run them.
PREPARED = [
    "pulse", "pulse_newest_day", "profile_rollup", "station_list", "districts",
    "overview", "overview_history", "worst", "replay", "replay_days", "station_history", "alerts",
    "episodes", "forecast_top", "forecast_alerts", "dispatch", "grid", "holidays",
    "baseline_metrics", "best_threshold", "average_precision", "event_leads", "policy_coverage",
    "concentration"]
# One station per user: 1,500 stations at sf0.1.
WIDE = ["grid", "lags", "rolling", "features", "episodes", "neighbours",
        "neighbour_mean", "policy_coverage"]


def prepared(spark: SparkSession, sf_dir: str, wide: bool) -> Data:
    """The tables a running system has at hand: history, stations, latest, profile, forecast."""
    d = Data(spark, sf_dir, wide)
    d.stage_inputs()
    for name in ("latest", "profile", "forecast", "model_stations"):
        setattr(d, name, stage(getattr(d, name), name))
    return d


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark: SparkSession = local_session(cpus, int(cpus) if cpus.isdigit() else 8,
                                        spark__driver__memory="16g")
    run(QUERIES["pulse"](spark, sf_dir))        # warm up the JVM
    times: dict[str, float] = {}

    def timed(name: str, work) -> None:
        t0 = time.perf_counter()
        work()
        times[name] = round(time.perf_counter() - t0, 3)

    for name in FROM_RAW:
        timed(name, lambda: run(QUERIES[name](spark, sf_dir)))
    for label, wide, names in (("", False, PREPARED), ("wide_", True, WIDE)):
        made: list[Data] = []
        timed(f"{label}prepare", lambda: made.append(prepared(spark, sf_dir, wide)))
        for name in names:
            if f"{label}{name}" not in times:
                timed(f"{label}{name}", lambda: run(PLANS[name](made[0])))
    print(json.dumps({"metric": "total wall time of headline queries",
                      "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Features of the newest slot from recent and historical readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dockwatch.operators.series import bridged_grid
from dockwatch.plans.features import feature_matrix, observations
from dockwatch.plans.profiles import bridge
from dockwatch.plans.serve import newest
from dockwatch.schemas import BRIDGE_DAYS, WEEK_SLOTS
from dockwatch.session import stage


def live_features(recent: DataFrame, history: DataFrame, stations: DataFrame, groups: DataFrame,
                  norm: DataFrame, edges: DataFrame, days_off: DataFrame) -> DataFrame:
    """The training features at the newest valid slot of ``recent``, with
    name, district, docks_avail and is_live for the forecast table."""
    # Only the scored week and the bridged weeks are read, whatever the history holds.
    old = history.filter(F.col("ts") >= newest(history) - F.make_dt_interval(F.lit(BRIDGE_DAYS)))
    now = stage(observations(recent, stations), "live_obs")
    base = newest(now)
    usual = bridge(observations(old, stations), newest(history))
    grid = stage(bridged_grid(stations, now, usual, base, WEEK_SLOTS), "live_grid")
    out = feature_matrix(grid, stations, groups, norm, edges, days_off, targets=False,
                         only_at=base, keep=["docks_avail", "is_live"])
    return out.join(stations.select("station_id", "name", "district"), "station_id")

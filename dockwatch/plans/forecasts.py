"""Questions over the forecast table, and dispatch proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dockwatch.functions.cols import c
from dockwatch.functions import timefn as tf
from dockwatch.operators.spatial import nearest
from dockwatch.schemas import DRAIN_TARGET, FILL_TARGET, MIN_MOVE
from dockwatch.session import stage


def _at(forecast: DataFrame, horizon: int, district: str | None) -> DataFrame:
    out = forecast.filter(F.col("horizon") == F.lit(horizon))
    return out if district is None else out.filter(F.col("district") == F.lit(district))


def _first(rows: DataFrame, limit: int | None) -> DataFrame:
    """All rows unless the caller asks for the first few."""
    return rows if limit is None else rows.limit(limit)


def forecast_list(forecast: DataFrame, horizon: int = 60, district: str | None = None,
                  risk_only: bool = False, limit: int | None = None) -> DataFrame:
    """Stations by risk at a horizon."""
    rows = _at(forecast, horizon, district)
    if risk_only:
        rows = rows.filter(F.col("watch_empty") | F.col("watch_full"))
    return _first(rows.withColumn("risk", c.risk).orderBy(F.desc("risk"), "station_id"), limit)


def forecast_station(forecast: DataFrame, station_id: int) -> DataFrame:
    """All horizons of one station."""
    return (forecast.filter(F.col("station_id") == F.lit(station_id))
            .drop("station_id", "name", "district", "is_live").orderBy("horizon"))


def forecast_alerts(forecast: DataFrame, horizon: int = 60, mode: str = "operational",
                    district: str | None = None, limit: int | None = None) -> DataFrame:
    """Stations whose predicted risk passes the threshold of the mode."""
    flag = "alert" if mode == "strict" else "watch"
    rows = _at(forecast, horizon, district).filter(F.col(f"{flag}_empty") | F.col(f"{flag}_full"))
    kind = F.when(F.col("proba_empty") >= F.col("proba_full"), "empty").otherwise("full")
    rows = (rows.select("station_id", "name", "district", "base_ts", "horizon", "now_bikes",
                        "now_docks_avail", "docks_total", "pred_bikes", "pred_docks",
                        "proba_empty", "proba_full", kind.alias("kind"), c.risk.alias("proba"))
            .orderBy(F.desc("proba"), "station_id"))
    return _first(rows, limit)


def forecast_totals(forecast: DataFrame) -> DataFrame:
    """Alerts per horizon under both thresholds."""
    return forecast.groupBy("horizon").agg(
        F.count("*").alias("n_rows"),
        *[F.count_if(x).alias(f"n_{x}") for x in
          ("alert_empty", "alert_full", "watch_empty", "watch_full")])


def forecast_curve(forecast: DataFrame) -> DataFrame:
    """Line and band per station: the base reading, then each horizon."""
    lo = F.coalesce("pred_bikes_lo", "pred_bikes")
    hi = F.coalesce("pred_bikes_hi", "pred_bikes")
    ahead = forecast.select(
        "station_id", tf.plus_minutes(F.col("base_ts"), F.col("horizon")).alias("ts"),
        F.col("pred_bikes").alias("bikes"), lo.alias("band_lo"),
        F.greatest(hi - lo, F.lit(0)).alias("band_width"))
    base = (forecast.groupBy("station_id").agg(
        F.min_by("base_ts", "horizon").alias("ts"), F.min_by("now_bikes", "horizon").alias("bikes"))
        .select("station_id", "ts", "bikes", F.col("bikes").alias("band_lo"),
                F.lit(0).alias("band_width")))
    return base.unionByName(ahead)


def need_bikes(total: Column, bikes: Column) -> Column:
    """Bikes that lift a station to the fill target."""
    return F.greatest(F.lit(MIN_MOVE), F.ceil(total * F.lit(FILL_TARGET)) - bikes).cast("int")


def spare_bikes(total: Column, bikes: Column) -> Column:
    """Bikes a station can give down to the drain target."""
    return F.greatest(F.lit(MIN_MOVE), bikes - F.floor(total * F.lit(DRAIN_TARGET))).cast("int")


def dispatch(forecast: DataFrame, stations: DataFrame, horizon: int = 60,
             district: str | None = None, max_km: float = 3.0, limit: int | None = None) -> DataFrame:
    """Each short station with its nearest station that can give.

    Stations without a partner in reach stay in the list. Only the short side
    is limited to a district; one giver may serve several tasks.
    """
    places = stations.select("station_id", "lon", "lat")
    # One row per station; read by both sides of the match and by each level of its search.
    f = stage(forecast.filter(F.col("horizon") == F.lit(horizon))
              .filter(F.col("watch_empty") | F.col("watch_full")).join(places, "station_id"), "at_risk")
    total, pred = F.col("docks_total"), F.col("pred_bikes")
    need = f.filter("watch_empty")
    if district is not None:
        need = need.filter(F.col("district") == F.lit(district))
    need = need.select(
        F.col("station_id").alias("to_station"), F.col("name").alias("to_name"), "district",
        "now_bikes", pred.alias("to_pred_bikes"), total.alias("to_capacity"), "proba_empty",
        need_bikes(total, pred).alias("need_bikes"), "lat", "lon")
    give = f.filter("watch_full").select(
        F.col("station_id").alias("from_station"), F.col("name").alias("from_name"),
        spare_bikes(total, pred).alias("spare_bikes"), "proba_full", "lat", "lon")
    partner = nearest(need.select(F.col("to_station").alias("id"), "lat", "lon"),
                      give.select(F.col("from_station").alias("id"), "lat", "lon"), 1, max_km
                      ).select(F.col("left_id").alias("to_station"),
                               F.col("right_id").alias("from_station"), "km")
    tasks = (need.drop("lat", "lon").join(partner, "to_station", "left")
             .join(give.drop("lat", "lon"), "from_station", "left"))
    return (_first(tasks.orderBy(F.desc("proba_empty"), F.desc("need_bikes"), "to_station"), limit)
            .select("to_station", "to_name", "district", "now_bikes", "to_pred_bikes",
                    "to_capacity", F.round("proba_empty", 3).alias("proba_empty"), "need_bikes",
                    "from_station", "from_name", "spare_bikes",
                    F.round("proba_full", 3).alias("proba_full"),
                    F.round("km", 2).alias("distance_km"),
                    F.least("need_bikes", F.coalesce("spare_bikes", "need_bikes"))
                    .alias("move_bikes")))


def dispatch_by_rule(alert_rows: DataFrame, district: str | None = None,
                     limit: int | None = None) -> DataFrame:
    """Fallback without a forecast: stations already empty, longest first."""
    rows = alert_rows.filter(F.col("level").isin("critical", "warning") & (F.col("bikes") <= 1))
    if district is not None:
        rows = rows.filter(F.col("district") == F.lit(district))
    rows = (rows.select("station_id", "name", "district", F.col("bikes").cast("int").alias("now_bikes"),
                        F.col("docks_total").cast("int").alias("docks_total"),
                        need_bikes(F.col("docks_total"), F.col("bikes")).alias("need_bikes"),
                        "level", "duration_min")
            .orderBy(F.desc("duration_min"), "station_id"))
    return _first(rows, limit)


def dispatch_totals(tasks: DataFrame) -> DataFrame:
    """Number of tasks, paired tasks and bikes.

    ``total_move_bikes`` counts every task, as reports have always done;
    ``paired_move_bikes`` only those with a source.
    """
    paired = F.col("from_station").isNotNull()
    return tasks.agg(
        F.count("*").alias("n_tasks"), F.count_if(paired).alias("n_paired"),
        F.coalesce(F.sum("move_bikes"), F.lit(0)).alias("total_move_bikes"),
        F.coalesce(F.sum(F.when(paired, F.col("move_bikes"))), F.lit(0)).alias("paired_move_bikes"))

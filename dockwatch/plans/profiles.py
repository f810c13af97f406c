"""Weekly profiles, norms and the bridge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dockwatch.functions.cols import c
from dockwatch.functions import status as st, timefn as tf
from dockwatch.plans.serve import newest
from dockwatch.schemas import BRIDGE_DAYS, MODEL_EMPTY_MAX, MODEL_FULL_MAX



def weekly_profile(snapshots: DataFrame) -> DataFrame:
    """Exact percentiles and rates per station, ISO weekday and half-hour.

    Bikes are small whole numbers, so the percentile buffers hold at most one
    counter per possible dock count however many rows a group has.
    """
    q = F.percentile("bikes", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    ts = F.col("ts")
    return (snapshots.groupBy("station_id", tf.iso_weekday(ts).alias("isodow"),
                              tf.slot_of_day(ts).alias("slot"))
            .agg(F.count("*").alias("n"), q.alias("q"), F.avg("bikes").alias("m"),
                 st.steady_round(st.share(c.bikes == 0), 4).alias("empty_rate"),
                 st.steady_round(st.share(c.docks == 0), 4).alias("full_rate"),
                 st.steady_round(F.avg(st.safe_ratio(c.bikes, c.total)), 4).alias("occ_rate"))
            .select("station_id", "isodow", "slot", "n",
                    st.steady_round(F.col("q")[1], 2).alias("bikes_p50"),
                    st.steady_round(F.col("q")[0], 2).alias("bikes_p10"),
                    st.steady_round(F.col("q")[2], 2).alias("bikes_p90"),
                    st.steady_round(F.col("m"), 2).alias("bikes_mean"), "empty_rate", "full_rate", "occ_rate"))


def station_profile(profile: DataFrame, station_id: int) -> DataFrame:
    return (profile.filter(F.col("station_id") == F.lit(station_id)).drop("station_id")
            .orderBy("isodow", "slot"))


def profile_rollup(profile: DataFrame, stations: DataFrame | None = None,
                   district: str | None = None) -> DataFrame:
    """Profile of a district or the city, weighted by readings."""
    rows = profile
    if district is not None and stations is not None:
        members = stations.filter(F.col("district") == F.lit(district)).select("station_id")
        rows = rows.join(members, "station_id")

    def weighted(x: str) -> Column:
        return st.steady_round(F.sum(F.col(x) * F.col("n")) / F.sum("n"), 4).alias(x)
    return (rows.groupBy("isodow", "slot")
            .agg(weighted("empty_rate"), weighted("full_rate"), weighted("occ_rate"),
                 F.sum("n").alias("n")).orderBy("isodow", "slot"))


def heatmap(spark: SparkSession, rollup: DataFrame) -> DataFrame:
    """Dense 7 x 48 picture of the empty rate, scaled to its peak."""
    cells = (spark.range(1, 8).select(F.col("id").cast("int").alias("isodow"))
             .withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(47)))))
    peak = rollup.agg(F.greatest(F.lit(0.001), F.max("empty_rate"))).scalar()
    v = F.coalesce("empty_rate", F.lit(0.0))
    return (cells.join(rollup.select("isodow", "slot", "empty_rate"), ["isodow", "slot"], "left")
            .select("isodow", "slot", v.alias("empty_rate"),
                    st.steady_round(F.least(F.lit(1.0), v / peak), 6).alias("shade"))
            .orderBy("isodow", "slot"))


def norms(obs: DataFrame, until: str) -> DataFrame:
    """Usual level per station, weekday and half-hour before ``until``."""
    ts = F.col("ts")
    return (obs.filter(ts < F.lit(until).cast("timestamp_ntz"))
            .groupBy("station_id", tf.sunday_weekday(ts).alias("dow"),
                     tf.slot_of_day(ts).alias("slot_of_day"))
            .agg(F.avg("ratio").alias("norm_ratio"),
                 st.share(c.bikes <= MODEL_EMPTY_MAX).alias("norm_empty_rate"),
                 st.share(c.docks <= MODEL_FULL_MAX).alias("norm_full_rate")))


def bridge(obs: DataFrame, history_end: Column | None = None, days: int = BRIDGE_DAYS) -> DataFrame:
    """Last reading per station, weekday and half-hour near the end of history."""
    end = newest(obs) if history_end is None else history_end
    ts = F.col("ts")
    return (obs.filter(ts >= end - F.make_dt_interval(F.lit(days)))
            .groupBy("station_id", tf.sunday_weekday(ts).alias("dow"),
                     tf.slot_of_day(ts).alias("slot_of_day"))
            .agg(*[F.max_by(x, "ts").alias(x)
                   for x in ("bikes", "docks_avail", "docks_total", "ratio")]))

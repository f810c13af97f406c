"""Snapshot tables derived from the generic ``events`` table.

Each event becomes one raw station reading; ``nation`` and ``region`` give the
stations names and districts. ``wide`` keeps one station per user, ``narrow``
folds users onto 16 stations so that slots are well filled.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dockwatch.functions import status as st, timefn as tf
from dockwatch.operators.dedupe import last_per_slot
from dockwatch.schemas import HORIZONS, STRICT_THRESHOLD

NARROW_STATIONS = 16
WATCH_THRESHOLD = 0.30
MIN_SNAPSHOTS = 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_days(spark: SparkSession, sf_dir: str) -> dict[str, tuple[str, str]]:
    """First and last day of train, valid and test, which together cover every day of the events.

    The last two sixths of the days, in whole days, are valid and test.
    """
    lo, hi = table(spark, sf_dir, "events").agg(
        F.min("ts").cast("date"), F.max("ts").cast("date")).first()
    if lo is None:
        lo = hi = date(1970, 1, 1)
    n = (hi - lo).days + 1
    edges = [0, n - 2 * (n // 6), n - n // 6, n]
    day = lambda k: str(lo + timedelta(days=k))
    return {name: (day(a), day(b - 1)) for name, a, b in zip(("train", "valid", "test"), edges, edges[1:])}


def raw_snapshots(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    e = table(spark, sf_dir, "events")
    station = F.col("user_id") if wide else F.col("user_id") % NARROW_STATIONS
    cap = (F.lit(20) + F.lit(4) * (F.col("user_id") % 6)).cast("int")
    invalid = F.col("event_id") % 211 == 0
    dead = invalid | (F.col("event_id") % 97 == 0)
    level = F.least(F.floor(F.col("value") / 2).cast("int"), cap)
    return e.select(
        station.cast("long").alias("station_id"),
        F.col("ts").alias("raw_ts"),
        F.when(invalid, 0).otherwise(cap).alias("docks_total"),
        F.when(dead, 0).otherwise(level).alias("bikes"),
        F.when(dead, 0).otherwise(cap - level).alias("docks_avail"),
    )


def snapshots(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    raw = raw_snapshots(spark, sf_dir, wide).withColumn("ts", tf.slot_start(F.col("raw_ts")))
    kept = last_per_slot(raw, ["station_id", "ts"], "raw_ts",
                         ["bikes", "docks_avail", "docks_total"])
    return kept.select("station_id", "ts", *[
        F.col(c).cast("short").alias(c) for c in ("bikes", "docks_avail", "docks_total")])


def _jitter(a: int, b: int, m: int) -> Column:
    s = F.col("station_id")
    return F.lit(1e-6) * ((s * s * a + s * b) % m).cast("double")


def describe_stations(spark: SparkSession, sf_dir: str, ids: DataFrame,
                      wide: bool = False) -> DataFrame:
    """Name, district and place for the station ids in ``ids``."""
    across = 40 if wide else 4
    s = F.col("station_id")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    names = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("_nation"), "n_name", "r_name")
    name = F.concat(F.col("n_name"), F.lit("_"), s) if wide else F.col("n_name")
    return (ids.withColumn("_nation", (s % 25).cast("int")).join(names, "_nation")
            .withColumn("name", name)
            .withColumn("district", F.when(s != 7, F.col("r_name")))
            .withColumn("lon", F.lit(121.4) + F.lit(0.004) * (s % across).cast("double")
                        + _jitter(277, 17, 991))
            .withColumn("lat", F.lit(25.0) + F.lit(0.004) * F.floor(s / across).cast("double")
                        + _jitter(389, 31, 997))
            .drop("_nation", "n_name", "r_name"))


def stations(spark: SparkSession, sf_dir: str, wide: bool = False,
             snaps: DataFrame | None = None) -> DataFrame:
    snaps = snapshots(spark, sf_dir, wide) if snaps is None else snaps
    ids = snaps.groupBy("station_id").agg(
        F.max("docks_total").cast("int").alias("capacity_docks"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.count("*").alias("n_snapshots"))
    return describe_stations(spark, sf_dir, ids, wide).select(
        "station_id", "name", "district", "lon", "lat", "capacity_docks",
        "first_ts", "last_ts", "n_snapshots",
        (F.col("station_id") == 13).alias("always_empty"))


def forecast_formula(df: DataFrame) -> DataFrame:
    """Closed-form stand-in for model output: one row per row and horizon.

    Needs bikes, docks_avail, docks_total and ratio.
    """
    per_h = F.explode(F.array(*[F.lit(h) for h in HORIZONS]))
    h = F.col("horizon")
    fade = F.lit(1.0) - h / F.lit(1000.0)
    return (df.withColumn("horizon", per_h)
            .withColumn("pred_ratio", F.col("ratio") + (F.lit(0.5) - F.col("ratio")) * h / F.lit(600.0))
            .withColumn("proba_empty", F.round(F.lit(3.0) / (F.lit(3.0) + F.col("bikes")) * fade, 6))
            .withColumn("proba_full", F.round(F.lit(3.0) / (F.lit(3.0) + F.col("docks_avail")) * fade, 6)))


def forecast(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    """Forecast table for each station's newest valid reading."""
    from dockwatch.operators.dedupe import latest_rows

    snaps = snapshots(spark, sf_dir, wide).filter(
        st.is_valid(F.col("bikes"), F.col("docks_avail"), F.col("docks_total")))
    now = latest_rows(snaps, ["station_id"], "ts", ["bikes", "docks_avail", "docks_total"])
    now = describe_stations(spark, sf_dir, now, wide).withColumn(
        "ratio", F.col("bikes") / F.col("docks_total"))
    f = forecast_formula(now)
    bikes = st.whole(st.clip01(F.col("pred_ratio")) * F.col("docks_total"))
    return f.select(
        "station_id", "name", "district", F.col("ts").alias("base_ts"), "horizon",
        F.col("bikes").cast("int").alias("now_bikes"),
        F.col("docks_avail").cast("int").alias("now_docks_avail"),
        F.col("docks_total").cast("int").alias("docks_total"),
        F.col("pred_ratio"),
        bikes.alias("pred_bikes"),
        F.greatest(F.col("docks_total").cast("int") - bikes, F.lit(0)).alias("pred_docks"),
        F.greatest(bikes - 2, F.lit(0)).alias("pred_bikes_lo"),
        F.least(bikes + 2, F.col("docks_total").cast("int")).alias("pred_bikes_hi"),
        "proba_empty", "proba_full",
        (F.col("proba_empty") >= STRICT_THRESHOLD).alias("alert_empty"),
        (F.col("proba_full") >= STRICT_THRESHOLD).alias("alert_full"),
        (F.col("proba_empty") >= WATCH_THRESHOLD).alias("watch_empty"),
        (F.col("proba_full") >= WATCH_THRESHOLD).alias("watch_full"),
        F.lit(WATCH_THRESHOLD).alias("thr_empty"), F.lit(WATCH_THRESHOLD).alias("thr_full"),
        F.lit(True).alias("is_live"))

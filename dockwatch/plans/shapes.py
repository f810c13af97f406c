"""Holiday detection and behaviour clusters (M2, M3)."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window, functions as F

from dockwatch.functions import timefn as tf
from dockwatch.operators.series import filled_shape, standardised
from dockwatch.schemas import CLUSTERS, HOLIDAY_REACH_DAYS, SEED
from dockwatch.session import stage


def day_shapes(obs: DataFrame) -> DataFrame:
    """Standardised hourly curve of every day that has all hours."""
    hourly = stage(obs.groupBy(F.col("ts").cast("date").alias("day"), F.hour("ts").alias("hour"))
                   .agg(F.avg("ratio").alias("r")), "hourly")
    hours = hourly.agg(F.countDistinct("hour")).scalar()
    whole = hourly.withColumn("_n", F.count("*").over(Window.partitionBy("day")))
    return standardised(whole.filter(F.col("_n") == hours).drop("_n"), ["day"], "r")


def day_distances(obs: DataFrame, reach: int = HOLIDAY_REACH_DAYS) -> DataFrame:
    """Distance of each working day to the local weekend and working-day curve.

    Local means +- ``reach`` days, the day itself left out. There are 24 rows
    per calendar day here, whatever the size of the history.
    """
    w = Window.partitionBy("hour").orderBy("_no").rangeBetween(-reach, reach)
    off = F.weekday("day") >= 5
    z = F.col("z")
    s = day_shapes(obs).withColumn("_no", F.unix_date("day")).withColumns({
        "n_end": F.count_if(off).over(w), "s_end": F.sum(F.when(off, z)).over(w),
        "n_day": F.count_if(~off).over(w) - 1, "s_day": F.sum(F.when(~off, z)).over(w) - z})
    s = s.filter(~off & (F.col("n_end") >= 4) & (F.col("n_day") >= 8))

    def gap(total: str, n: str):
        d = z - F.col(total) / F.col(n)
        return F.sqrt(F.sum(d * d))
    return s.groupBy("day").agg(gap("s_end", "n_end").alias("to_weekend"),
                                gap("s_day", "n_day").alias("to_workday"))


def holidays(obs: DataFrame) -> DataFrame:
    """Working days that move like a weekend (M2)."""
    return day_distances(obs).filter(F.col("to_weekend") < F.col("to_workday")).select("day")


def station_shapes(obs: DataFrame, until: str) -> DataFrame:
    """48 buckets (24 working-day and 24 weekend hours) per station, gap-filled
    and standardised; readings before ``until`` only."""
    ts = F.col("ts")
    bucket = F.when(tf.is_model_weekend(ts), 24).otherwise(0) + F.hour(ts)
    means = (obs.filter(ts < F.lit(until).cast("timestamp_ntz"))
             .groupBy("station_id", bucket.cast("int").alias("bucket"))
             .agg(F.avg("ratio").alias("level")))
    return standardised(filled_shape(means, "station_id", "bucket", "level", 48),
                        ["station_id"], "level")


def clusters(obs: DataFrame, until: str, k: int = CLUSTERS, seed: int = SEED) -> DataFrame:
    """Behaviour group per station by k-means on its shape (M3)."""
    rows = station_shapes(obs, until).groupBy("station_id").agg(
        F.array_sort(F.collect_list(F.struct("bucket", "z"))).alias("s"))
    vec = rows.select("station_id", array_to_vector(F.col("s.z")).alias("features"))
    # Repeated passes over one 48-value vector per station.
    vec = stage(vec, "shapes")
    model = KMeans(k=k, seed=seed, maxIter=50, featuresCol="features",
                   predictionCol="cluster_id").fit(vec)
    out = model.transform(vec).select("station_id", F.col("cluster_id").cast("int"))
    return out

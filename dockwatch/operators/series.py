"""Complete time grids and shape handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from dockwatch.functions import timefn as tf

SLOT_STEP = "interval 30 minutes"


def spanned(spans: DataFrame, start: str, end: str) -> DataFrame:
    """One row per half-hour of each row's span (I8); no range join involved.

    The spans are cut into four-week pieces and spread out first: they are few
    and tiny, so without that a handful of tasks would write the whole grid.
    """
    n = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = [x for x in spans.columns if x not in (start, end)]
    pieces = spans.withColumn("_from", F.explode(
        F.sequence(F.col(start), F.col(end), F.expr("interval 28 days"))))
    last = F.least(F.col(end), F.col("_from") + F.expr("interval 28 days") - F.expr(SLOT_STEP))
    pieces = pieces.withColumn("_to", last).repartition(n, *rest, "_from")
    return pieces.select(*rest, F.explode(
        F.sequence(F.col("_from"), F.col("_to"), F.expr(SLOT_STEP))).alias("ts"))


def complete_grid(obs: DataFrame) -> DataFrame:
    """Every slot between a station's first and last reading, gaps as NULL."""
    spans = obs.groupBy("station_id").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    return spanned(spans, "t0", "t1").join(
        obs.select("station_id", "ts", "bikes", "docks_avail", "docks_total", "ratio"),
        ["station_id", "ts"], "left")


def bridged_grid(stations: DataFrame, obs: DataFrame, bridge: DataFrame, base_ts: Column,
                 slots: int) -> DataFrame:
    """The last ``slots`` + 1 half-hours of every station; live readings first,
    otherwise the last one of the same weekday and half-hour (K10, D7-D9, J14)."""
    back = tf.plus_minutes(base_ts, -30 * slots)
    cells = spanned(stations.select("station_id", back.alias("t0"), base_ts.alias("t1")), "t0", "t1")
    values = ["bikes", "docks_avail", "docks_total", "ratio"]
    live = obs.select("station_id", "ts", *[F.col(c).alias(f"o_{c}") for c in values])
    usual = bridge.select("station_id", "dow", "slot_of_day",
                          *[F.col(c).alias(f"b_{c}") for c in values])
    ts = F.col("ts")
    return (cells.join(live, ["station_id", "ts"], "left")
            .withColumns({"dow": tf.sunday_weekday(ts), "slot_of_day": tf.slot_of_day(ts)})
            .join(usual, ["station_id", "dow", "slot_of_day"], "left")
            .select("station_id", "ts",
                    *[F.coalesce(f"o_{c}", f"b_{c}").alias(c) for c in values],
                    F.col("o_ratio").isNotNull().alias("is_live")))


def standardised(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``z``: deviation from the key's mean in population standard deviations.

    A key's rows are one shape (24 hours or 48 buckets), never its history.
    """
    w = Window.partitionBy(*keys)
    z = (F.col(value) - F.avg(value).over(w)) / (F.stddev_pop(value).over(w) + F.lit(1e-9))
    return df.withColumn("z", z)


def filled_shape(df: DataFrame, key: str, pos: str, value: str, size: int) -> DataFrame:
    """Positions 0..size-1 of each key; inner gaps on a straight line between their
    neighbours, outer gaps from the nearest known position, and keys without any known
    position at the mean of all known ones (F17)."""
    dense = (df.select(key).distinct()
             .withColumn(pos, F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
             .join(df.select(key, F.col(pos).cast("int").alias(pos), value), [key, pos], "left"))
    # ``size`` rows per key by construction.
    before = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(key).orderBy(pos).rowsBetween(0, Window.unboundedFollowing)
    here = F.when(F.col(value).isNotNull(), F.col(pos))
    d = dense.withColumns({
        "_p0": F.last(here, True).over(before), "_v0": F.last(value, True).over(before),
        "_p1": F.first(here, True).over(after), "_v1": F.first(value, True).over(after)})
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (
        (F.col(pos) - F.col("_p0")) / (F.col("_p1") - F.col("_p0")))
    inner = F.col("_p1") > F.col("_p0")
    everywhere = df.agg(F.avg(value)).scalar()
    return d.withColumn(value, F.when(inner, line).otherwise(
        F.coalesce("_v0", "_v1", everywhere))).drop("_p0", "_p1", "_v0", "_v1")

"""The one notification log: what a refresh sends and what readers page through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from dockwatch.sinks.log import fold, read_log, write_epoch

NOTIFICATION = T.StructType([
    T.StructField("station_id", T.LongType()), T.StructField("name", T.StringType()),
    T.StructField("district", T.StringType()), T.StructField("level", T.StringType()),
    T.StructField("prev_level", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("duration_min", T.IntegerType()), T.StructField("bikes", T.ShortType()),
    T.StructField("docks_avail", T.ShortType()), T.StructField("docks_total", T.ShortType()),
    T.StructField("ts", T.TimestampNTZType()), T.StructField("received_at", T.TimestampNTZType())])


def append_notifications(events: DataFrame, root: str, epoch: int, received_at: Column | None = None) -> None:
    """Write the events of one round; the same round again replaces itself."""
    at = F.localtimestamp() if received_at is None else received_at
    rows = events.withColumn("received_at", at)
    have = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns
            else F.lit(None).cast(f.dataType).alias(f.name) for f in NOTIFICATION.fields]
    write_epoch(rows.select(*have, F.col("received_at").cast("date").alias("day")), root, epoch)


def notification_log(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """Newest notifications first, all of them unless a page is asked for."""
    rows = read_log(spark, root, NOTIFICATION).drop("day", "epoch").orderBy(
        F.desc("received_at"), F.desc("ts"), "station_id")
    return rows if limit is None else rows.limit(limit)


def fold_notifications(spark: SparkSession, root: str, every: int = 1, keep_days: int | None = None,
                       now: str | None = None) -> int:
    """Fold the rounds written so far; with ``keep_days`` older days go."""
    return fold(spark, root, NOTIFICATION, every, keep_days, now)

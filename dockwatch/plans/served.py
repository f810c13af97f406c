"""Answers from the stored table, computed only if there is none that is new enough."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from dockwatch.plans import alerts as al, forecasts as fc, reports as rp
from dockwatch.schemas import FORECAST
from dockwatch.sinks.tables import publish, published_path, read_published
from dockwatch.streaming.scoring import forecast_summary

_AT = T.StructType([T.StructField("as_of", T.TimestampNTZType())])


def publish_at(df: DataFrame, root: str, as_of: Column) -> int:
    """Publish a table with the moment it speaks of."""
    n = publish(df, f"{root}/table")
    publish(df.sparkSession.range(1).select(as_of.cast("timestamp_ntz").alias("as_of")), f"{root}/at")
    return n


def stored_or(spark: SparkSession, root: str, schema: T.StructType | None, since: dt.datetime | None,
              compute: Callable[[], DataFrame]) -> DataFrame:
    """The published table if it speaks of ``since`` or later (any, if None), else what ``compute`` plans."""
    path = published_path(spark, f"{root}/table")
    if path is None:
        return compute()
    if since is not None:
        as_of = read_published(spark, f"{root}/at", _AT).first()
        if as_of is None or as_of[0] is None or as_of[0] < since:
            return compute()
    return spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)


def alerts_served(root: str, snapshots: DataFrame, stations: DataFrame, as_of: str | None = None,
                  since: dt.datetime | None = None, level: str | None = None,
                  district: str | None = None) -> DataFrame:
    """Alerts as stored by the refresh, else from the readings."""
    rows = stored_or(snapshots.sparkSession, root, None, since, lambda: al.alerts(snapshots, stations, as_of))
    if level is not None:
        rows = rows.filter(F.col("level") == F.lit(level))
    return rows if district is None else rows.filter(F.col("district") == F.lit(district))


def dispatch_served(root: str, stations: DataFrame, alert_rows: Callable[[], DataFrame], horizon: int = 60,
                    since: dt.datetime | None = None, district: str | None = None, max_km: float = 3.0,
                    limit: int | None = None) -> DataFrame:
    """Tasks from the stored forecast, or without one by the rule (L11); ``source`` tells which.

    Rule tasks have no partner, so what speaks of one is empty.
    """
    spark = stations.sparkSession
    shape = fc.dispatch(spark.createDataFrame([], FORECAST), stations.limit(0)).schema

    def by_rule() -> DataFrame:
        r = fc.dispatch_by_rule(alert_rows(), district, limit)
        given = {"to_station": "station_id", "to_name": "name", "district": "district", "now_bikes": "now_bikes",
                 "to_capacity": "docks_total", "need_bikes": "need_bikes", "move_bikes": "need_bikes"}
        return r.select(*[F.col(given[f.name]).cast(f.dataType).alias(f.name) if f.name in given
                          else F.lit(None).cast(f.dataType).alias(f.name) for f in shape.fields],
                        F.lit("rule").alias("source"))
    none = spark.createDataFrame([], FORECAST)
    forecast = stored_or(spark, root, FORECAST, since, lambda: none)
    if forecast is none:
        return by_rule()
    return fc.dispatch(forecast, stations, horizon, district, max_km, limit).withColumn("source", F.lit("forecast"))


def forecast_meta(forecast: DataFrame, metrics: DataFrame) -> DataFrame:
    """Facts about the newest forecast with the headline of the newest backtest (L14); one row."""
    one = F.lit(1).alias("_one")
    return (forecast_summary(forecast).select("*", one)
            .join(rp.headline(metrics).select("*", one), "_one").drop("_one"))


def model_report(spark: SparkSession, root: str, bands_root: str | None = None) -> DataFrame:
    """The newest stored metric table, with the section of bands when there is one."""
    return rp.stored_report(spark, root, bands_root)


def policy_report(coverage: DataFrame, preventable: DataFrame) -> DataFrame:
    """Coverage and preventable events of the policies as one metric table."""
    out = None
    for section, df in (("coverage", coverage), ("preventable", preventable)):
        keys = [c for c, t in df.dtypes if t == "string"]
        values = [c for c, t in df.dtypes if t != "string"]
        cells = F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value"))
                                    for v in values])).alias("m")
        name = F.concat_ws("/", *keys) if keys else F.lit("all")
        part = df.select(F.lit(section).alias("section"), name.alias("policy"), cells).select("section", "policy", "m.*")
        out = part if out is None else out.unionByName(part)
    return out

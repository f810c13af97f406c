"""Scoring of the newest slot after a refresh (K9)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from dockwatch.functions import timefn as tf
from dockwatch.plans import learn
from dockwatch.plans.scoring import live_features
from dockwatch.schemas import FORECAST, HORIZONS, SNAPSHOT, STRICT_THRESHOLD
from dockwatch.sinks.tables import publish, read_days, read_published
from dockwatch.sources.files import history
from dockwatch.streaming.refresh import Store

AUX = {
    "stations": ("station_id long, name string, district string, district_id int, lon double, "
                 "lat double, capacity int, cluster_id int"),
    "norms": ("station_id long, dow int, slot_of_day int, norm_ratio double, norm_empty_rate double, "
              "norm_full_rate double"),
    "neighbours": "station_id long, neighbour_id long, km double",
    "holidays": "day date",
}


@dataclass(frozen=True)
class ScoringInputs:
    """Tables published by the training job, and where the models are."""
    aux_root: str          # sinks.tables.export_tables with the names of AUX
    models_root: str       # learn.save
    history_root: str      # sinks.tables.export_months


def training_tables(stations: DataFrame, groups: DataFrame, norms: DataFrame,
                    neighbours: DataFrame, holidays: DataFrame) -> dict[str, DataFrame]:
    """What scoring needs from training (B6), for ``export_tables``."""
    return {"stations": stations.join(groups, "station_id"), "norms": norms,
            "neighbours": neighbours, "holidays": holidays}


def scorer(inputs: ScoringInputs, store: Store) -> Callable[[SparkSession, int], None]:
    """An ``after`` step for the refresh: forecasts once per new slot."""
    loaded: list[learn.Models] = []

    def run(spark: SparkSession, epoch: int) -> None:
        # A week of lags and the newest day; older days are not read.
        recent = read_days(spark, store.at("recent"), SNAPSHOT, newest=9)
        aux = {k: read_published(spark, f"{inputs.aux_root}/{k}", schema) for k, schema in AUX.items()}
        done = read_published(spark, store.at("forecast"), FORECAST).agg(F.max("base_ts")).first()[0]
        now = recent.agg(F.max("ts")).first()[0]
        if now is None or done == now:
            return
        if not loaded:
            loaded.append(learn.load(spark, inputs.models_root))
        past = history(spark, inputs.history_root, months=2)
        places = aux["stations"]
        live = live_features(recent, past, places.drop("cluster_id"),
                             places.select("station_id", "cluster_id"), aux["norms"],
                             aux["neighbours"], aux["holidays"])
        publish(learn.forecast_table(loaded[0], live), store.at("forecast"))

    return run


def forecast_summary(forecast: DataFrame, horizon: int = 60) -> DataFrame:
    """Facts about the newest forecast for its readers."""
    at = F.col("horizon") == horizon
    return forecast.agg(
        F.max("base_ts").alias("base_ts"), F.count("*").alias("n_rows"),
        F.countDistinct("station_id").alias("n_stations"),
        F.lit(list(HORIZONS)).alias("horizons"), F.lit(STRICT_THRESHOLD).alias("alert_threshold"),
        *[F.count_if(at & F.col(x)).alias(f"n_{x}") for x in
          ("alert_empty", "alert_full", "watch_empty", "watch_full")],
        F.max(tf.plus_minutes(F.col("base_ts"), F.col("horizon"))).alias("last_target"))

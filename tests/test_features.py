import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from dockwatch.plans import features as fe, profiles as pr, scoring as sc
from dockwatch.schemas import FEATURES, SNAPSHOT

T0 = dt.datetime(2024, 1, 1)
OBS = "station_id long, ts timestamp_ntz, bikes int, docks_avail int, docks_total int, ratio double"


def series(n, stations=3, keep=0.8, seed=3):
    rng = random.Random(seed)
    return [(s, T0 + dt.timedelta(minutes=30 * i), b, 20 - b, 20, b / 20)
            for s in range(stations) for i in range(n) if rng.random() < keep for b in [rng.randint(0, 20)]]


def test_windows_equal_a_complete_grid_across_chunks(spark):
    rows = series(3000, stations=1)            # more than two chunks long
    obs = spark.createDataFrame(rows, OBS)
    got = fe.rolling(obs).join(fe.lags(obs).drop("bikes", "docks_avail", "docks_total", "ratio"), ["station_id", "ts"]).toPandas()
    got = got.join(fe.leads(obs).toPandas().set_index("ts")[["y_ratio_180", "bl_lastweek_60"]], on="ts").sort_values("ts").set_index("ts")
    p = pd.DataFrame(rows, columns=["s", "ts", "b", "d", "n", "r"]).set_index("ts")
    grid = p.reindex(pd.date_range(p.index.min(), p.index.max(), freq="30min"))
    want = pd.DataFrame({
        "ratio_lag1": grid.r.shift(1), "ratio_lag336": grid.r.shift(336), "roll_mean_48": grid.r.rolling(48, 1).mean(),
        "roll_std_12": grid.r.rolling(12, 2).std(), "roll_min_48": grid.r.rolling(48, 1).min(),
        "empty_streak": (grid.b <= 1).astype(int).rolling(6, 1).sum(),
        "y_ratio_180": grid.r.shift(-6), "bl_lastweek_60": grid.r.shift(334)}).loc[got.index]
    assert len(got) == len(rows)
    for x in want.columns:
        pd.testing.assert_series_equal(got[x].astype(float), want[x].astype(float), check_names=False, check_freq=False)


@pytest.fixture(scope="module")
def world(spark):
    rows = series(48 * 21, stations=6)
    obs = spark.createDataFrame(rows, OBS).cache()
    stations = spark.createDataFrame(
        [(s, f"S{s}", "AB"[s % 2], s % 2, 121.0 + s * 0.003, 25.0, 20) for s in range(6)],
        "station_id long, name string, district string, district_id int, lon double, lat double, capacity int")
    groups = stations.select("station_id", (F.col("station_id") % 3).cast("int").alias("cluster_id"))
    days_off = spark.createDataFrame([(dt.date(2024, 1, 15),)], "day date")
    return obs, stations, groups, pr.norms(obs, "2024-01-15"), fe.neighbours(stations), days_off


def frame_at(df, when):
    return df.filter(F.col("ts") == F.lit(when).cast("timestamp_ntz")).orderBy("station_id").toPandas()


def test_live_features_equal_training_features(spark, world):
    obs, stations, groups, norm, edges, days_off = world
    when = dt.datetime(2024, 1, 15, 8, 0)
    train = frame_at(fe.feature_matrix(obs, stations, groups, norm, edges, days_off), when)
    live = fe.feature_matrix(obs, stations, groups, norm, edges, days_off, only_at=F.lit(when).cast("timestamp_ntz"))
    live = live.orderBy("station_id").toPandas()
    assert len(train) > 3 and list(live.columns) == ["station_id", "ts", *FEATURES]
    pd.testing.assert_frame_equal(train[FEATURES], live[FEATURES], check_dtype=False)


def test_no_leakage(spark, world):
    obs, stations, groups, norm, edges, days_off = world
    when = dt.datetime(2024, 1, 16, 10, 30)
    past = obs.filter(F.col("ts") <= F.lit(when).cast("timestamp_ntz"))
    a = frame_at(fe.feature_matrix(obs, stations, groups, norm, edges, days_off, targets=False), when)
    b = frame_at(fe.feature_matrix(past, stations, groups, norm, edges, days_off, targets=False), when)
    pd.testing.assert_frame_equal(a, b)


def test_live_scoring_frame_bridges(spark, world):
    obs, stations, groups, norm, edges, days_off = world
    snaps = obs.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in SNAPSHOT.fields])
    last = F.lit(T0 + dt.timedelta(days=21, minutes=-30)).cast("timestamp_ntz")
    recent = snaps.filter(F.col("ts") >= last - F.expr("interval 2 hours"))
    live = sc.live_features(recent, snaps, stations, groups, norm, edges, days_off).toPandas()
    assert live.station_id.nunique() == len(live) and live.ratio_lag336.notna().any()
    assert {"name", "district", "is_live", "docks_avail"} <= set(live.columns)


def test_split_keeps_whole_targets(spark):
    obs = spark.createDataFrame(series(400, stations=1, keep=1.0), OBS)
    leads = fe.leads(obs)
    out = fe.split(leads, "2024-01-08", "2024-01-09")
    assert out.count() == 400 - 6 - 336

import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from dockwatch.plans import evaluate as ev, features as fe, learn as le, profiles as pr

T0 = dt.datetime(2024, 1, 1)
DAYS = 16


@pytest.fixture(scope="module")
def trained(spark):
    """A series that always falls back to its mean, so persistence is beatable."""
    rng, rows = random.Random(9), []
    for s in range(6):
        x = 10.0
        for i in range(48 * DAYS):
            x = 10 + 0.5 * (x - 10) + rng.gauss(0, 5)
            b = max(0, min(20, round(x)))
            rows.append((s, T0 + dt.timedelta(minutes=30 * i), b, 20 - b, 20, b / 20))
    obs = spark.createDataFrame(rows, "station_id long, ts timestamp_ntz, bikes int, docks_avail int, docks_total int, ratio double")
    st = spark.createDataFrame([(s, f"S{s}", "D", 0, 121.0 + s * 0.003, 25.0, 20) for s in range(6)],
                               "station_id long, name string, district string, district_id int, lon double, lat double, capacity int")
    groups = st.select("station_id", F.lit(0).alias("cluster_id"))
    off = spark.createDataFrame([], "day date")
    f = le.stage(fe.feature_matrix(obs, st, groups, pr.norms(obs, "2024-01-12"), fe.neighbours(st), off, keep=["docks_avail"]), "f")
    tr, va = fe.split(f, "2024-01-01", "2024-01-10"), fe.split(f, "2024-01-11", "2024-01-13")
    s = le.Settings(rounds=4, depth=3, min_rows=5)
    return f, st, le.train(tr, va, s)


def test_beats_persistence_and_bands_hold_the_point(spark, trained):
    f, _, m = trained
    test = le.judge(m, le.model_frame(fe.split(f, "2024-01-14", "2024-01-16"))).cache()
    e = test.filter("horizon = 120").agg(F.avg(F.abs(F.col("y_ratio") - F.col("pred_ratio"))),
                                         F.avg(F.abs(F.col("y_ratio") - F.col("ratio")))).first()
    assert e[0] < e[1]
    band = le.with_band(test, m.bands)
    assert band.filter("lo > pred_ratio OR hi < pred_ratio OR lo < 0 OR hi > 1").count() == 0
    cover = {r["horizon"]: r["coverage"] for r in ev.interval_report(band).collect()}
    assert all(0.5 < v < 1.0 for v in cover.values())
    assert set(m.thresholds) == {(k, h) for k in ("empty", "full") for h in (30, 60, 120, 180)}


def test_forecast_table_and_round_trip(spark, trained):
    f, st, m = trained
    live = (f.filter(F.col("ts") == F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"))
            .withColumn("is_live", F.lit(True)).join(st.select("station_id", "name", "district"), "station_id"))
    out = le.forecast_table(m, live).orderBy("station_id", "horizon").collect()
    assert len(out) == 6 * 4
    for r in out:
        assert r["pred_bikes_lo"] <= r["pred_bikes"] <= r["pred_bikes_hi"]
        assert r["pred_docks"] == r["docks_total"] - r["pred_bikes"]
        assert r["watch_empty"] == (r["proba_empty"] >= r["thr_empty"])
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    le.save(m, root)
    again = le.forecast_table(le.load(spark, root), live).orderBy("station_id", "horizon").collect()
    assert again == out
    imp = le.importance(spark, m, 5)
    assert imp.count() == 20


def test_hash_sample_is_stable(spark):
    df = spark.range(20000).select(F.col("id").alias("station_id"), F.lit(T0).cast("timestamp_ntz").alias("ts"))
    a, b = le.hash_sample(df, 0.22), le.hash_sample(df.repartition(7), 0.22)
    assert a.exceptAll(b).count() == 0 and abs(a.count() / 20000 - 0.22) < 0.02


def test_scorer_publishes_once_per_slot(spark, trained):
    from dockwatch.schemas import FORECAST, SNAPSHOT
    from dockwatch.sinks import tables as tb
    from dockwatch.streaming.refresh import Store
    from dockwatch.streaming import scoring as ss

    f, st, m = trained
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    store = Store(root + "/store")
    groups = st.select("station_id", F.lit(0).alias("cluster_id"))
    tables = ss.training_tables(st, groups, f.select("station_id", "dow", "slot_of_day", "norm_ratio", "norm_empty_rate",
                                                     "norm_full_rate").distinct(), fe.neighbours(st),
                                spark.createDataFrame([], "day date"))
    tb.export_tables(tables, root + "/aux")
    le.save(m, root + "/models")
    snaps = f.select("station_id", "ts", "bikes", "docks_avail", "docks_total").select(
        *[F.col(x.name).cast(x.dataType).alias(x.name) for x in SNAPSHOT.fields])
    last = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    tb.export_months(snaps.filter(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")), root + "/history")
    recent = snaps.filter((F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")) & (F.col("ts") <= last))
    tb.publish_days(recent.withColumn("day", F.col("ts").cast("date")), store.at("recent"))
    run = ss.scorer(ss.ScoringInputs(root + "/aux", root + "/models", root + "/history"), store)
    run(spark, 0)
    out = tb.read_published(spark, store.at("forecast"), FORECAST)
    first = tb.published_path(spark, store.at("forecast"))
    assert out.count() == 24 and {r[0] for r in out.select("base_ts").distinct().collect()} == {dt.datetime(2024, 1, 15, 12)}
    run(spark, 1)
    assert tb.published_path(spark, store.at("forecast")) == first
    info = ss.forecast_summary(out).first()
    assert info["n_stations"] == 6 and info["last_target"] == dt.datetime(2024, 1, 15, 15)

"""Spatial search, numbering, frames and grids against brute force."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from dockwatch.operators import dedupe, ordering, series, spatial


def km(a, b):
    return 111.0 * math.sqrt((a[1] - b[1]) ** 2 + ((a[2] - b[2]) * math.cos(math.radians(a[1]))) ** 2)


def brute(points, others, k, reach):
    out = {}
    for a in points:
        near = sorted((round(km(a, b), 9), b[0]) for b in others if b[0] != a[0] and km(a, b) <= reach)
        out[a[0]] = [i for _, i in near[:k]]
    return {k_: v for k_, v in out.items() if v}


def layout(kind):
    rng = random.Random(7)
    if kind == "spread":
        return [(i, 25 + rng.random() * 0.1, 121 + rng.random() * 0.1) for i in range(300)]
    if kind == "north":
        return [(i, -64 + rng.random() * 0.1, -20 + rng.random() * 0.2) for i in range(300)]
    # a third of all points on one spot, a third in a tight cluster, the rest around
    pts = [(i, 25.0, 121.0) for i in range(100)]
    pts += [(100 + i, 25.003 + rng.random() * 1e-4, 121.0 + rng.random() * 1e-4) for i in range(100)]
    return pts + [(200 + i, 25 + rng.random() * 0.03, 121 + rng.random() * 0.03) for i in range(100)]


@pytest.mark.parametrize("kind", ["spread", "north", "crowded"])
def test_nearest_is_exact(spark, kind):
    pts = layout(kind)
    df = spark.createDataFrame(pts, "id long, lat double, lon double")
    got = {}
    for r in spatial.nearest(df, df, 5, 1.0).orderBy("left_id", "rank").collect():
        got.setdefault(r["left_id"], []).append(r["right_id"])
    assert got == brute(pts, pts, 5, 1.0)


def test_nearest_between_two_sets(spark):
    pts = layout("spread")
    a, b = pts[:50], pts[50:]
    df = spark.createDataFrame(pts, "id long, lat double, lon double")
    got = {r["left_id"]: [r["right_id"]] for r in spatial.nearest(
        df.filter("id < 50"), df.filter("id >= 50"), 1, 3.0).collect()}
    assert got == brute(a, b, 1, 3.0)


@pytest.mark.parametrize("lat", [25.0, -0.001, -63.0])
def test_nearest_between_two_crowds(spark, lat):
    """No partner nearby, a crowd half the radius away."""
    rng = random.Random(11)
    a = [(i, lat + rng.random() * 1e-3, 121 + rng.random() * 1e-3) for i in range(150)]
    b = [(1000 + i, lat + 5e-3 + rng.random() * 1e-3, 121.003 + rng.random() * 1e-3) for i in range(150)]
    schema = "id long, lat double, lon double"
    got = {}
    for r in spatial.nearest(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 3, 1.0).orderBy(
            "left_id", "rank").collect():
        got.setdefault(r["left_id"], []).append(r["right_id"])
    assert got == brute(a, b, 3, 1.0)


def test_pairs_within_has_no_nested_loop(spark):
    pts = layout("spread")
    df = spark.createDataFrame(pts, "id long, lat double, lon double")
    out = spatial.pairs_within(df, df, 1.0)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == sum(1 for p in pts for q in pts if p[0] != q[0] and km(p, q) <= 1.0)


def test_numbered_equals_a_global_window(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 5), rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, g int, v int")
    out = ordering.numbered(df, [F.desc("g"), F.asc("id")], "n", {"s": "v"}, partitions=7).collect()
    total, want = 0, {}
    for n, (i, g, v) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        total += v
        want[i] = (n, total)
    assert {r["id"]: (r["n"], r["s"]) for r in out} == want


@pytest.mark.parametrize("partitions", [1, 7])
def test_running_by_key_equals_windows(spark, partitions):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, "a", "a", "a", "b", "c"]), rng.randint(0, 9)) for i in range(600)] + [(999, "z", 4)]
    df = spark.createDataFrame(rows, "id int, g string, v int")
    got = ordering.running_by_key(df, ["g"], [F.desc("id")], {"run": "v"}, {"whole": "v"}, partitions)
    total, want = {}, {}
    for i, g, v in sorted(rows, reverse=True, key=lambda r: r[0]):
        total[g] = total.get(g, 0) + v
        want[i] = (g, v, total[g])
    assert {r["id"]: (r["g"], r["v"], r["run"]) for r in got.collect()} == want
    assert all(r["whole"] == total[r["g"]] for r in got.collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange rangepartitioning") == 0


def test_nearest_work_is_linear_in_the_points(spark):
    """Two crowds half the radius apart: points meet a bounded number of others, however many there are."""
    rng = random.Random(3)
    schema = "id long, lat double, lon double"

    def crowds(n):
        a = [(i, 25 + rng.random() * 2e-3, 121 + rng.random() * 2e-3) for i in range(n)]
        b = [(10_000 + i, 25.006 + rng.random() * 2e-3, 121.001 + rng.random() * 2e-3) for i in range(n)]
        return [spark.createDataFrame(x, schema).repartition(4) for x in (a, b)]

    def met(a, b):
        return spatial.candidate_pairs(a, b, 3, 1.0).count(), spatial.candidate_pairs(a.union(b), a.union(b), 3, 1.0).count()
    for n in (1250, 5000):
        assert max(met(*crowds(n))) < 200 * 2 * n


def test_last_per_slot_with_one_hot_station(spark):
    df = (spark.range(30000).withColumn("station_id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50 + 2))
          .withColumn("t", F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz")
                      + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("id").cast("decimal(18,6)") * 3))
          .withColumn("ts", F.window("t", "30 minutes").start).withColumn("v", F.col("id").cast("int")))
    got = dedupe.last_per_slot(df, ["station_id", "ts"], "t", ["v"])
    want = df.groupBy("station_id", "ts").agg(F.max("v").alias("v"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_grid_size_and_bridge(spark):
    t = dt.datetime(2024, 1, 8)
    rows = [(1, t, 1, 9, 10, 0.1), (1, t + dt.timedelta(minutes=90), 2, 8, 10, 0.2), (2, t, 3, 7, 10, 0.3)]
    obs = spark.createDataFrame(rows, "station_id long, ts timestamp_ntz, bikes int, docks_avail int, docks_total int, ratio double")
    g = series.complete_grid(obs)
    assert g.count() == 4 + 1 and g.filter("ratio IS NULL").count() == 2
    usual = spark.createDataFrame([(1, 1, 1, 7, 3, 10, 0.7)],
                                  "station_id long, dow int, slot_of_day int, bikes int, docks_avail int, docks_total int, ratio double")
    b = series.bridged_grid(obs.select("station_id").distinct(), obs, usual, F.lit(t + dt.timedelta(minutes=90)), 3)
    got = {r["ts"]: (r["ratio"], r["is_live"]) for r in b.filter("station_id = 1").collect()}
    assert got[t + dt.timedelta(minutes=30)] == (0.7, False) and got[t] == (0.1, True)
    assert got[t + dt.timedelta(minutes=60)] == (None, False) and b.count() == 8


def test_filled_shape(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 3, 6.0), (1, 4, 1.0)], "k int, p int, v double")
    out = {r["p"]: r["v"] for r in series.filled_shape(df, "k", "p", "v", 6).collect()}
    assert out == {0: 2.0, 1: 2.0, 2: 4.0, 3: 6.0, 4: 1.0, 5: 1.0}
    some = spark.createDataFrame([(1, 1, 2.0), (1, 2, 4.0), (2, 0, None)], "k int, p int, v double")
    assert {r["v"] for r in series.filled_shape(some, "k", "p", "v", 3).filter("k = 2").collect()} == {3.0}

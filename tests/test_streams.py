import datetime as dt
import json
import os
import tempfile

from pyspark.sql import functions as F

from dockwatch.plans import alerts as al, serve as sv
from dockwatch.schemas import LATEST, SNAPSHOT, STATION
from dockwatch.sinks import notifications as nt
from dockwatch.sinks.log import fold, open_epochs, read_log, write_epoch
from dockwatch.sinks.tables import publish, read_days, read_published
from dockwatch.streaming import episodes as ep, ingest as ing, refresh as rf


def record(name, bikes, docks, lon="121.5", **more):
    return {"sno": "1", "sna": f"P_{name}", "sarea": "D", "tot_quantity": str(int(bikes or 0) + int(docks or 0))
            if str(bikes).isdigit() else "9", "sbi_quantity": str(bikes), "bemp": str(docks), "lng": lon,
            "lat": "25.0", "act": "1", "yb2_quantity": str(bikes), "eyb_quantity": "", "mday": "x", **more}


def drop(folder, stamp, records):
    """Land one file whole, as a fetch would."""
    path = f"{folder}/snap_{stamp}.json"
    with open(path + ".part", "w") as f:
        f.write("\n".join(json.dumps(r) for r in records))
    os.rename(path + ".part", path)


def known(spark):
    t = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(7, "A", "D", 121.5, 25.0, 9, t, t, 1, False)], STATION)


def run(spark, src, store):
    q = rf.refresh_stream(spark, src, store, store.at("checkpoint"), "P_", every=None, files_per_trigger=1,
                          now="2024-01-01")
    q.awaitTermination()


def test_refresh_over_time(spark):
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    src, store = d + "/in", rf.Store(d + "/store")
    os.mkdir(src)
    publish(known(spark), store.at("registry"))

    def events():
        return {(r["station_id"], r["level"], r["prev_level"], r["epoch"])
                for r in read_log(spark, store.at("events"), nt.NOTIFICATION).collect()}

    drop(src, "20240101T0000", [record("A", 0, 9), record("C", 4, 5), record("B", 4, 5), record("", 1, 1),
                                record("X", "many", 2)])
    run(spark, src, store)
    reg = {r["name"]: r["station_id"] for r in read_published(spark, store.at("registry"), STATION).collect()}
    assert reg == {"A": 7, "B": 900000, "C": 900001}
    assert events() == set()                                   # the first round only records
    assert {(r["epoch"], r["reason"], r["n"]) for r in rf.reject_counts(spark, store).collect()} == {(0, "unreadable", 2)}

    drop(src, "20240101T0040", [record("A", 0, 9), record("C", 0, 9), record("B", 4, 5, lon="0")])
    run(spark, src, store)                                     # a restart from the checkpoint
    assert events() == {(900001, "warning", None, 1)}
    drop(src, "20240101T0110", [record("A", 0, 9), record("C", 0, 9), record("E", 3, 3)])
    run(spark, src, store)
    assert (7, "critical", "warning", 2) in events() and (900001, "critical", "warning", 2) in events()

    drop(src, "20240101T0020", [record("B", 1, 8)])            # late, newer than what the slot held
    run(spark, src, store)
    recent = {(r["station_id"], r["ts"]): r["bikes"]
              for r in read_days(spark, store.at("recent"), SNAPSHOT).collect()}
    assert recent[900000, dt.datetime(2024, 1, 1)] == 1
    latest = {r["station_id"]: r for r in read_published(spark, store.at("latest"), LATEST).collect()}
    assert latest[900000]["bikes"] == 4 and latest[900000]["lon"] is None
    assert latest[900002]["name"] == "E" and len(latest) == 4
    assert latest[7]["fetched_at"] == dt.datetime(2024, 1, 1, 1, 10)

    raw = spark.read.parquet(store.at("raw"))
    n, kept = raw.count(), {(r["station_id"], r["level"]) for r in spark.read.parquet(store.at("seen")).filter("epoch = 3 AND level IS NOT NULL").collect()}
    batch = spark.read.schema(ing.LANDED).json(src + "/snap_20240101T0020.json").withColumn(
        "fetched_at", F.lit("2024-01-01 00:20:00"))
    rf.refresh_batch(store, "P_", now="2024-01-01")(batch, 3)                    # the same batch once more
    assert spark.read.parquet(store.at("raw")).count() == n
    assert {(r["station_id"], r["level"]) for r in spark.read.parquet(store.at("seen")).filter("epoch = 3 AND level IS NOT NULL").collect()} == kept


def test_clocks_ahead_and_late_files(spark):
    """A reading a day ahead hides no alert; what is too old or too far ahead is listed with its reason."""
    store = rf.Store(tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/store")
    publish(known(spark), store.at("registry"))

    def batch(epoch, *rows):
        df = spark.read.schema(ing.LANDED).json(spark.sparkContext.parallelize(
            [json.dumps(record(*r[1:]) | {"fetched_at": r[0]}) for r in rows]))
        rf.refresh_batch(store, "P_", keep_days=3, now="2024-01-05")(df, epoch)
        return {r["station_id"] for r in read_published(spark, store.at("alerts"), spark.read.parquet(
            f"{store.at('alerts')}/v-*").schema).collect()}
    assert batch(0, ("2024-01-05 09:00:00", "A", 0, 9), ("2024-01-04 23:00:00", "A", 0, 9)) == {7}
    assert batch(1, ("2024-01-06 09:00:00", "B", 4, 5), ("2024-01-05 09:30:00", "A", 0, 9)) == {7}
    assert batch(2, ("2024-01-01 09:00:00", "C", 4, 5), ("2024-01-09 09:00:00", "A", 4, 5), ("never", "A", 4, 5),
                 ("2024-01-05 10:00:00", "A", 0, 9)) == {7}
    assert {(r["epoch"], r["reason"], r["n"]) for r in rf.reject_counts(spark, store).collect()} == {
        (2, "late", 1), (2, "ahead", 1), (2, "unreadable", 1)}
    assert {json.loads(r["record"])["name"] for r in rf.rejected(spark, store).filter("reason = 'late'").collect()} == {"C"}


def test_log_is_folded_and_repeats_change_nothing(spark):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/log"
    schema = spark.createDataFrame([], "v int").schema

    def write(epoch, n):
        write_epoch(spark.range(n).select(F.col("id").cast("int").alias("v"), F.lit(f"2024-01-0{1 + epoch // 5}").cast(
            "date").alias("day")).coalesce(1), root, epoch)
        fold(spark, root, schema, every=4)
    for e in range(11):
        write(e, e % 3)
        assert len(open_epochs(spark, root)) < 4
    whole = sorted((r["epoch"], r["v"]) for r in read_log(spark, root, schema).collect())
    assert whole == sorted((e, v) for e in range(11) for v in range(e % 3))
    write_epoch(spark.createDataFrame([(9, dt.date(2024, 1, 1))], "v int, day date"), root, 2)       # an old batch once more
    assert sorted(r["v"] for r in read_log(spark, root, schema).filter("epoch = 2").collect()) == [9]
    fold(spark, root, schema, every=1)
    assert open_epochs(spark, root) == [] and read_log(spark, root, schema).count() == len(whole) - 1


def test_scoring_runs_after_a_batch(spark):
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    src, store, seen = d + "/in", rf.Store(d + "/store"), []
    os.mkdir(src)
    drop(src, "20240101T0000", [record("A", 0, 9)])
    q = rf.refresh_stream(spark, src, store, store.at("checkpoint"), "P_", every=None, now="2024-01-01",
                          after=lambda s, epoch: seen.append((epoch, s.read.parquet(store.at("raw")).count())))
    q.awaitTermination()
    assert seen == [(0, 1)]


def test_watermarked_slots(spark):
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    schema = "name string, fetched_at timestamp_ntz, bikes int, docks_avail int, docks_total int"

    def land(i, rows):
        spark.createDataFrame([(n, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m), b, 9 - b, 9) for n, m, b in rows],
                              schema).coalesce(1).write.mode("append").parquet(f"{d}/in")
    os.mkdir(f"{d}/in")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/in")

    def start():
        return (ing.slot_winners(src).writeStream.format("parquet").option("path", f"{d}/out")
                .option("checkpointLocation", f"{d}/cp").trigger(availableNow=True).start())
    land(0, [("A", 5, 1), ("A", 25, 2), ("B", 10, 3)])
    start().awaitTermination()
    land(1, [("A", 40, 4), ("A", 20, 9)])                       # a late one, still in time
    start().awaitTermination()
    land(2, [("A", 200, 5)])
    start().awaitTermination()
    land(3, [("A", 29, 7), ("A", 400, 1)])                      # too late for its slot
    q = start()
    q.awaitTermination()
    assert ing.dropped_late(q) == 1
    got = {(r["name"], r["ts"].strftime("%H:%M")): r["bikes"] for r in spark.read.parquet(f"{d}/out").collect()}
    assert got == {("A", "00:00"): 2, ("B", "00:00"): 3, ("A", "00:30"): 4, ("A", "03:00"): 5}


def test_episode_state_equals_batch(spark):
    import random
    rng = random.Random(4)
    t = dt.datetime(2024, 1, 1)
    rows = [(s, t + dt.timedelta(minutes=30 * i), b, (9 - b) if rng.random() < 0.95 else 0, 9)
            for i in range(150) for s in range(4) if rng.random() < 0.8 for b in [rng.choice([0, 0, 0, 4, 9, 9])]]
    from dockwatch.functions import timefn as tf
    df = spark.createDataFrame(rows, SNAPSHOT)
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    os.mkdir(f"{d}/in")
    src = spark.readStream.schema(SNAPSHOT).option("maxFilesPerTrigger", 1).parquet(f"{d}/in")
    # Six files in shuffled order; a reading comes at most 50 slots after a newer one.
    part = F.floor((tf.slot_index(F.col("ts")) - tf.slot_index(F.lit(t).cast("timestamp_ntz"))) / 25)
    for k in (1, 0, 3, 2, 5, 4):
        df.filter(part == k).coalesce(1).write.mode("append").parquet(f"{d}/in")
        q = (ep.episode_stream(src, late_hours=48).writeStream.format("parquet").option("path", f"{d}/out")
             .option("checkpointLocation", f"{d}/cp").trigger(availableNow=True).start())
        q.awaitTermination()
    want = {(r["station_id"], r["s"], r["kind"], r["duration_min"], r["duration_capped"]) for r in
            al.episodes(df).withColumn("s", tf.slot_index(F.col("ts"))).collect()}
    out = spark.read.schema(ep.OUT).parquet(f"{d}/out")
    got = [tuple(r) for r in ep.current(out).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 100
    assert out.count() > len(want) and ep.late_counts(out).count() == 0           # some were corrected, none lost


class FakeState:
    def __init__(self):
        self.exists, self.get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def test_episode_state_stays_small_and_says_what_came_too_late():
    import pandas as pd
    state, run = FakeState(), ep._advance(8)
    step = lambda *rows: pd.concat(run((1,), iter([pd.DataFrame(rows, columns=["slot", "bikes", "docks_avail"])]), state))
    sizes = []
    for i in range(50):
        out = step((1000 + 2 * i, 0, 9), (1001 + 2 * i, 0, 9))
        assert len(out) == 2 and not out.late.any()
        sizes.append(len(state.get[1]))
    assert max(sizes) <= 8 + ep.REACH and sizes[-1] == sizes[20]
    out = step((1097, 4, 5))                                     # a replacement: one word back, two later ones shortened
    assert out[["slot", "kind", "duration_min", "duration_capped"]].values.tolist() == [
        [1097, None, 0, False], [1098, "empty", 30, False], [1099, "empty", 60, False]]
    out = step((1000, 3, 3), (1099, 0, 9))
    assert out[["slot", "late"]].values.tolist() == [[1000, True]]


def test_upsert_latest(spark):
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    t = dt.datetime(2024, 1, 1)
    run_ = rf.upsert_latest(d + "/latest")
    run_(spark.createDataFrame([(1, t, 1, 8, 9), (2, t, 2, 7, 9)], SNAPSHOT), 0)
    run_(spark.createDataFrame([(1, t + dt.timedelta(minutes=30), 5, 4, 9), (2, t - dt.timedelta(minutes=30), 9, 0, 9)], SNAPSHOT), 1)
    out = {r["station_id"]: r["bikes"] for r in read_published(spark, d + "/latest", SNAPSHOT).collect()}
    assert out == {1: 5, 2: 2}
    assert sv.freshness(read_published(spark, d + "/latest", SNAPSHOT).withColumn("fetched_at", F.col("ts"))).first()["n_stations"] == 2

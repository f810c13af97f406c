import datetime as dt
import glob
import json
import os
import tempfile

from pyspark.sql import functions as F

from dockwatch.plans import alerts as al, serve as sv
from dockwatch.schemas import SNAPSHOT, STATION
from dockwatch.sinks import notifications as nt, tables as tb
from dockwatch.sources import files as fi


def fresh():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def snaps(spark, n=200):
    t = dt.datetime(2024, 1, 31)
    return spark.createDataFrame([(i % 4, t + dt.timedelta(minutes=30 * (i // 4)), i % 9, 9 - i % 9, 9) for i in range(n)], SNAPSHOT)


def test_months_export_and_pruned_read(spark):
    root, s = fresh() + "/history", snaps(spark)
    assert tb.export_months(s, root) == 200
    assert sorted(os.path.basename(p) for p in glob.glob(root + "/month=*")) == ["month=202401", "month=202402"]
    assert fi.history(spark, root).exceptAll(s).count() == 0
    last = fi.history(spark, root, months=1)
    assert last.filter(F.col("ts") < F.lit("2024-02-01").cast("timestamp_ntz")).count() == 0 and last.count() == 8
    assert "PartitionFilters: [isnotnull(month" in last._jdf.queryExecution().executedPlan().toString()
    one = spark.read.parquet(glob.glob(root + "/month=202401/*.parquet")[0]).select("station_id", "ts").collect()
    assert one == sorted(one)
    files = sv.file_coverage(spark.read.parquet(root)).collect()
    assert sum(r["n_rows"] for r in files) == 200 and all(r["bytes"] > 0 for r in files)


def test_recent_joins_history(spark):
    d = fresh()
    tb.export_months(snaps(spark, 8), d + "/history")
    tb.publish(snaps(spark, 4), d + "/recent")
    assert fi.history(spark, d + "/history", tb.published_path(spark, d + "/recent")).count() == 12


def test_publish_swaps_whole_versions(spark):
    root = fresh() + "/t"
    assert tb.read_published(spark, root, SNAPSHOT).count() == 0
    assert tb.publish(snaps(spark, 8), root) == 8
    before = tb.read_published(spark, root, SNAPSHOT)
    assert tb.publish(snaps(spark, 12), root) == 12
    assert before.count() == 8 and tb.read_published(spark, root, SNAPSHOT).count() == 12
    for n in range(6):
        tb.publish(snaps(spark, 4), root)
    assert len(glob.glob(root + "/v-*")) == 8            # readers may still hold any of them
    for mark in glob.glob(root + "/_retired/v-*"):
        os.utime(mark, (0, 0))
    for crc in glob.glob(root + "/_retired/.*.crc"):
        os.utime(crc, (0, 0))
    tb.publish(snaps(spark, 4), root)
    assert len(glob.glob(root + "/v-*")) == 2            # the current one, and the one just retired
    assert tb.read_published(spark, root, SNAPSHOT).count() == 4


def test_csv_append(spark):
    root = fresh() + "/csv"
    rows = spark.createDataFrame([("2024-01-31 23:40:00", "C", "D", "N", 9, 4, 5, 1.0, 2.0),
                                  ("2024/2/01 00:10", "C", "D", "N", 9, 3, 6, 1.0, 2.0)],
                                 "raw_time string, city string, district string, name string, docks_total int, bikes int, docks_avail int, lon double, lat double")
    assert tb.append_csv(rows, root) == 2 and tb.append_csv(rows, root) == 2
    back = fi.history_csv(spark, root + "/month=202401/*.csv")
    assert [r["bikes"] for r in back.collect()] == [4, 4]
    assert len(glob.glob(root + "/month=202402/*.csv")) == 2


def test_backfill_ledger(spark):
    root = fresh()
    rows = spark.createDataFrame([(dt.date(2024, 1, d), d) for d in (1, 2, 2)], "day date, v int")
    assert tb.backfill(rows, "day", root + "/t", root + "/done") == 3
    more = spark.createDataFrame([(dt.date(2024, 1, d), 9) for d in (2, 3)], "day date, v int")
    assert tb.backfill(more, "day", root + "/t", root + "/done") == 1
    assert sorted(r["v"] for r in spark.read.parquet(root + "/t").collect()) == [1, 2, 2, 9]
    assert spark.read.parquet(root + "/done").count() == 3
    # A day left by a run that died before its entry is not booked by another run.
    spark.createDataFrame([(7, dt.date(2024, 1, 5))], "v int, day date").write.mode("append").partitionBy("day").parquet(root + "/t")
    assert tb.backfill(spark.createDataFrame([(dt.date(2024, 1, 6), 6)], "day date, v int"), "day", root + "/t", root + "/done") == 1
    full = spark.createDataFrame([(dt.date(2024, 1, 5), v) for v in (1, 2)], "day date, v int")
    assert tb.backfill(full, "day", root + "/t", root + "/done") == 2


def test_retention(spark):
    root = fresh() + "/raw"
    rows = spark.createDataFrame([(dt.date(2024, 1, d), d) for d in (1, 10, 20)], "day date, v int")
    rows.write.partitionBy("day").parquet(root)
    assert tb.drop_expired_days(spark, root, "2024-01-20", 14) == 1
    assert sorted(r["v"] for r in spark.read.parquet(root).collect()) == [10, 20]


def test_backfill_books_days_without_rows(spark):
    root = fresh()
    rows = spark.createDataFrame([(dt.date(2024, 1, d), d) for d in (1, 2, 9)], "day date, v int")
    days = ["2024-01-01", "2024-01-02", "2024-01-03"]
    assert tb.missing_days(spark, root + "/done", days) == days
    assert tb.backfill(rows, "day", root + "/t", root + "/done", days) == 2
    assert {(str(r["day"]), r["n"]) for r in tb.read_ledger(spark, root + "/done").collect()} == {
        ("2024-01-01", 1), ("2024-01-02", 1), ("2024-01-03", 0)}
    assert tb.missing_days(spark, root + "/done", days) == []
    assert tb.backfill(rows, "day", root + "/t", root + "/done", days) == 0
    assert tb.read_ledger(spark, root + "/done").count() == 3


def test_notification_log(spark):
    root = fresh() + "/log"
    for i in range(3):
        ev = spark.createDataFrame([(s, dt.datetime(2024, 1, 1, i)) for s in range(4)], "station_id long, ts timestamp_ntz")
        nt.append_notifications(ev, root, i, F.lit(dt.datetime(2024, 1, 1, i)).cast("timestamp_ntz"))
    newest = nt.notification_log(spark, root, 5).collect()
    assert [r["ts"].hour for r in newest] == [2, 2, 2, 2, 1]
    assert nt.fold_notifications(spark, root) == 3 and nt.notification_log(spark, root).count() == 12
    nt.append_notifications(ev, root, 2, F.lit(dt.datetime(2024, 1, 1, 2)).cast("timestamp_ntz"))     # the round once more
    assert nt.notification_log(spark, root).count() == 12
    assert nt.fold_notifications(spark, root, 1, 1, "2024-01-09") == 1 and nt.notification_log(spark, root).count() == 0


def test_report_and_tables(spark):
    root = fresh()
    tb.write_report(spark.sql("SELECT 1 AS a, named_struct('b', CAST(NULL AS INT)) AS c"), root + "/r")
    body = json.loads(spark.read.text(root + "/r").first()[0])
    assert body == {"a": 1, "c": {"b": None}}
    n = tb.export_splits({"train": snaps(spark, 8), "test": snaps(spark, 4)}, root + "/f")
    assert n == {"train": 8, "test": 4} and spark.read.parquet(root + "/f").select("split").distinct().count() == 2
    assert tb.export_tables({"a": snaps(spark, 8)}, root + "/s") == {"a": 8}


def test_days_are_replaced_one_by_one(spark):
    root = fresh() + "/recent"
    s = snaps(spark).withColumn("day", F.col("ts").cast("date"))
    assert tb.publish_days(s, root) == 200
    assert tb.read_days(spark, root, SNAPSHOT).exceptAll(snaps(spark)).count() == 0
    one = s.filter("day = DATE '2024-02-01'").withColumn("bikes", F.lit(99).cast("short"))
    assert tb.publish_days(one, root) == 8
    back = tb.read_days(spark, root, SNAPSHOT)
    assert back.count() == 200 and back.filter("bikes = 99").count() == 8
    assert tb.read_days(spark, root, SNAPSHOT, newest=1).count() == 8
    late = s.withColumns({"day": F.date_add("day", 20), "ts": F.col("ts") + F.expr("interval 20 days")})
    tb.publish_days(late, root, keep_days=14, now="2024-02-22")
    assert tb.read_days(spark, root, SNAPSHOT).count() == 200
    odd = one.withColumns({"day": F.lit("2030-01-01").cast("date"), "ts": F.lit("2030-01-01").cast("timestamp_ntz")})
    tb.publish_days(odd, root, keep_days=14, now="2024-02-22")     # a reading from the future lets no day go
    assert tb.read_days(spark, root, SNAPSHOT).count() == 208


def test_time_filters_skip_months(spark):
    root = fresh() + "/history"
    t = dt.datetime(2024, 1, 31)
    s = spark.createDataFrame([(i % 4, t + dt.timedelta(minutes=30 * (i // 4)), i % 9, 9 - i % 9, 9) for i in range(800)], SNAPSHOT)
    tb.export_months(s, root)
    stations = spark.createDataFrame([(i, "N", "D", 121.5, 25.0, 9, t, t, 1, False) for i in range(4)], STATION)
    known, plain = fi.history(spark, root, with_month=True), fi.history(spark, root)
    for ask in (lambda h: sv.replay(h, stations, "2024-02-01 10:00:00"), lambda h: sv.pulse(h, stations),
                lambda h: sv.pulse(h, stations, "2024-01-31"), lambda h: sv.station_history(h, 2, 1),
                lambda h: sv.station_history(h, 2, 2, "2024-02-01 00:00:00"),
                lambda h: sv.latest_slot(h, stations), lambda h: al.alerts(h, stations),
                lambda h: al.alerts(h, stations, "2024-01-31 20:00:00")):
        got = ask(known)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(month" in plan
        assert got.columns == ask(plain).columns
        assert sorted(map(str, got.collect())) == sorted(map(str, ask(plain).collect()))
        assert got.count() > 0

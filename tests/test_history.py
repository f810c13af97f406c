import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from dockwatch.plans import history as hi, serve as sv
from dockwatch.sources import files as fi


def test_two_sources_name_fix_and_ids(spark):
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    head = "a,b,c,d,e,f,g,h,i\n"
    with open(f"{d}/a1.csv", "w") as f:
        f.write(head + "2024/01/01 00:05,C, ,N?1,10,4,6,1.0,2.0\n2024/01/01 00:25,C,D1, N?1 ,10,3,7,1.0,2.0\n"
                       "2024/01/01 00:40,C,D2,B,8,0,8,1.5,2.5\n")
    with open(f"{d}/b1.csv", "w") as f:
        f.write(head + "2024-01-02 00:10:00,C,D1,N_1,12,5,7,1.0,2.1\n2024-01-01 00:10:00,C,D2,A,8,0,8,1.5,2.5\n")
    raw = [fi.history_csv(spark, f"{d}/a*.csv"), fi.history_csv(spark, f"{d}/b*.csv")]
    fixes = spark.createDataFrame([("N?1", "N_1")], "old_name string, new_name string")
    snaps, stations = hi.build_history(raw, fixes)
    st = {r["name"]: r for r in stations.collect()}
    assert {k: v["station_id"] for k, v in st.items()} == {"A": 1, "N_1": 2, "B": 3}
    n = st["N_1"]
    assert (n["district"], n["capacity_docks"], n["n_snapshots"], n["n_coord_variants"]) == ("D1", 12, 2, 2)
    assert st["B"]["always_empty"] and not n["always_empty"]
    rows = {(r["station_id"], r["ts"]): r["bikes"] for r in snaps.collect()}
    assert rows[2, dt.datetime(2024, 1, 1)] == 3           # the later of two in one slot
    assert len(rows) == 4


def test_mode_ties_and_null_coordinates(spark):
    rows = [("X", "B", 1.0, 2.0), ("X", "A", 3.0, 2.0), ("X", "A", 1.0, None), ("X", "B", 3.0, None), ("X", "", None, None)]
    df = spark.createDataFrame(rows, "name string, district string, lon double, lat double").withColumns({
        "bikes": F.lit(1), "docks_avail": F.lit(1), "docks_total": F.lit(2),
        "ts": F.lit("2024-01-01").cast("timestamp_ntz")})
    r = hi.station_master(df).first()
    assert (r["district"], r["lon"], r["lat"], r["n_coord_variants"]) == ("A", 1.0, 2.0, 5)


def test_registry_append(spark):
    cols = "station_id long, name string, district string, lon double, lat double, docks_total int, bikes int, ts timestamp_ntz"
    t = dt.datetime(2024, 1, 1)
    raw = spark.createDataFrame([(1, "a", None, None, None, 5, 0, t), (1, "a", "D", 1.0, 2.0, 7, 0, t),
                                 (2, "b", "E", 1.0, 2.0, 9, 0, t)], cols)
    known = hi.registry_rows(raw.filter("station_id = 1"))
    out = {r["station_id"]: r for r in hi.append_unseen(known, raw).collect()}
    assert out[1]["district"] == "D" and out[1]["capacity_docks"] == 7 and out[1]["always_empty"]
    assert out[2]["always_empty"] is False


def test_missing_sources_are_empty(spark):
    from dockwatch.schemas import SNAPSHOT
    empty = fi.parquet_or_empty(spark, "/tmp/there-is-nothing-here", SNAPSHOT)
    assert empty.count() == 0 and empty.schema == SNAPSHOT
    assert sv.coverage(empty).first()["n_rows"] == 0
    assert fi.history(spark, "/tmp/there-is-nothing-here", months=1).count() == 0


def test_file_names_choose_raw_snapshots(spark):
    from dockwatch.schemas import RAW_SNAPSHOT
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    row = spark.createDataFrame([(1,) + (None,) * (len(RAW_SNAPSHOT) - 1)], RAW_SNAPSHOT).toPandas()
    import pyarrow as pa
    import pyarrow.parquet as pq
    for name in ("snap_20240101T0000", "snap_20240120T0010", "snap_bad"):
        pq.write_table(pa.Table.from_pandas(row[["station_id"]]), f"{d}/{name}.parquet")
    assert os.listdir(d)
    assert fi.raw_snapshots(spark, d, now="2024-01-21 00:00:00").count() == 1


def test_nested_records(spark):
    from dockwatch.schemas import HISTORICAL_JSON, STATION_JSON
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    with open(f"{d}/s.json", "w") as f:
        f.write('{"StationUID":"P1","StationName":{"Zh_tw":"X_N"},"StationAddress":{"Zh_tw":"City East district 5"},'
                '"StationPosition":{"PositionLon":1.5,"PositionLat":2.5}}\n{"StationUID":"P2","StationName":{"Zh_tw":"X_M"}}\n')
    with open(f"{d}/h.json", "w") as f:
        f.write('{"StationUID":"P1","SrcUpdateTime":"2024-01-01T00:10:00+08:00","AvailableRentBikes":1,"AvailableReturnBikes":2}\n'
                '{"StationUID":"P1","SrcUpdateTime":"2024-01-01T00:20:00+08:00","AvailableRentBikes":3,"AvailableReturnBikes":4}\n'
                '{"StationUID":"P9","SrcUpdateTime":"2024-01-01T00:20:00+08:00","AvailableRentBikes":3,"AvailableReturnBikes":4}\n')
    st = fi.nested_stations(spark.read.schema(STATION_JSON).json(f"{d}/s.json"), "P", "X_", r"City (\S+) district")
    assert {(r["sno"], r["name"], r["district"]) for r in st.collect()} == {("1", "N", "East"), ("2", "M", "")}
    day = fi.historical_day(spark.read.schema(HISTORICAL_JSON).json(f"{d}/h.json"), "P")
    rows, unknown = fi.backfill_rows(day, st, "City")
    assert [(r["raw_time"], r["docks_total"], r["name"]) for r in rows.collect()] == [("2024-01-01 00:20:00", 7, "N")]
    assert [r[0] for r in unknown.collect()] == ["9"]

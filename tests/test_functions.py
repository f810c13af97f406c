import datetime as dt

import pytest
from pyspark.sql import functions as F

from dockwatch.functions import status as st, textfn as tx, timefn as tf


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()[0]


@pytest.mark.parametrize("row, want", [
    ((5, 5, None), "offline"), ((0, 0, 0), "offline"), ((0, 0, 20), "offline"), ((0, 9, 9), "empty"),
    ((9, 0, 9), "full"), ((2, 2, 4), "near_empty"), ((9, 2, 11), "near_full"), ((5, 5, 10), "normal")])
def test_status_ladder(spark, row, want):
    df = spark.createDataFrame([row], "b int, d int, t int")
    assert df.select(st.status(F.col("b"), F.col("d"), F.col("t"))).first()[0] == want


@pytest.mark.parametrize("minutes, capped, want", [
    (0, False, "-"), (0, True, "just seen"), (30, False, "30 m"), (60, False, "1 h"),
    (90, False, "1 h 30 m"), (330, True, "≥ 5 h 30 m")])
def test_duration_text(spark, minutes, capped, want):
    assert one(spark, tf.duration_text(F.col("m"), F.col("c")), m=minutes, c=capped) == want


@pytest.mark.parametrize("text, want", [
    ("2024/01/03 05:30", dt.datetime(2024, 1, 3, 5, 30)),
    (" 2024-01-03 05:30:07", dt.datetime(2024, 1, 3, 5, 30, 7)), ("soon", None), ("2024/13/03 05:30", None)])
def test_two_clock_formats(spark, text, want):
    assert one(spark, tf.parse_wall_clock(F.col("t")), t=text) == want


def test_slots_ignore_the_session_zone(spark):
    keep = spark.conf.get("spark.sql.session.timeZone")
    try:
        # 02:47 does not exist in this zone on that day.
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        df = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-31 02:47:12.5' AS t")
        got = df.select(tf.slot_start(F.col("t")), tf.slot_of_day(F.col("t")), tf.minute_of_day(F.col("t"))).first()
        assert tuple(got) == (dt.datetime(2024, 3, 31, 2, 30), 5, 167)
    finally:
        spark.conf.set("spark.sql.session.timeZone", keep)


def test_weekday_systems(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-07 00:00:00' AS t")     # a Sunday
    assert tuple(df.select(tf.iso_weekday(F.col("t")), tf.sunday_weekday(F.col("t")),
                           tf.is_model_weekend(F.col("t"))).first()) == (7, 0, True)


def test_minutes_count_boundaries(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 00:00:59' a, TIMESTAMP_NTZ '2024-01-01 00:01:01' b")
    assert df.select(tf.minutes_between(F.col("a"), F.col("b"))).first()[0] == 1


@pytest.mark.parametrize("x, want", [(0.5, 0), (1.5, 2), (2.5, 2), (2.51, 3)])
def test_whole_is_half_even(spark, x, want):
    assert one(spark, st.whole(F.col("x")), x=x) == want


def test_fields(spark):
    df = spark.createDataFrame([("7",), ("",), (None,), ("x",), (" 3 ",)], "t string")
    assert [r[0] for r in df.select(tx.count_field(F.col("t"))).collect()] == [7, 0, 0, None, 3]
    df = spark.createDataFrame([("121.5",), ("0",), ("",), ("x",)], "t string")
    assert [r[0] for r in df.select(tx.degree_field(F.col("t"))).collect()] == [121.5, None, None, None]
    assert one(spark, tx.strip_prefix(F.col("t"), "A.B_"), t="A.B_Name ") == "Name"
    assert one(spark, tx.relabel(F.col("t"), {"old": "new"}), t="old") == "new"
    assert one(spark, tx.relabel(F.col("t"), {"old": "new"}), t="other") == "other"


def test_steady_round(spark):
    df = spark.createDataFrame([(0.29375,), (0.29374999999999996,), (0.29375000000000001,)], "x double")
    assert {r[0] for r in df.select(st.steady_round(F.col("x"), 4)).collect()} == {0.2938}

"""Wall-clock time arithmetic.

All of it works on TIMESTAMP_NTZ without touching the session zone, so a
daylight-saving change of the session can never move a slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dockwatch.schemas import SLOT_MINUTES


def slot_start(ts: Column, minutes: int = SLOT_MINUTES) -> Column:
    """Floor to the slot (I2); ``minutes`` must divide 60."""
    into = F.make_dt_interval(
        F.lit(0), F.lit(0), F.minute(ts) % F.lit(minutes), F.date_part(F.lit("SECOND"), ts))
    return ts - into


def minute_index(ts: Column) -> Column:
    """Whole minutes since 1970-01-01 on the wall clock."""
    return (F.unix_date(ts.cast("date")).cast("long") * F.lit(1440)
            + F.hour(ts) * F.lit(60) + F.minute(ts))


def minutes_between(start: Column, end: Column) -> Column:
    """Minute boundaries crossed from start to end."""
    return minute_index(end) - minute_index(start)


def slot_index(ts: Column) -> Column:
    """Running number of the slot; consecutive slots differ by one."""
    return F.floor(minute_index(ts) / F.lit(SLOT_MINUTES)).cast("long")


def slot_of_day(ts: Column) -> Column:
    """Half-hour of the day, 0..47."""
    return (F.hour(ts) * F.lit(2) + (F.minute(ts) >= F.lit(SLOT_MINUTES)).cast("int")).cast("int")


def iso_weekday(ts: Column) -> Column:
    """Monday 1 .. Sunday 7; the weekday system of profiles (I4)."""
    return (F.weekday(ts) + F.lit(1)).cast("int")


def sunday_weekday(ts: Column) -> Column:
    """Sunday 0 .. Saturday 6; the weekday system of the model (I4)."""
    return (F.dayofweek(ts) - F.lit(1)).cast("int")


def is_model_weekend(ts: Column) -> Column:
    return sunday_weekday(ts).isin(0, 6)


def minute_of_day(ts: Column) -> Column:
    return (F.hour(ts) * F.lit(60) + F.minute(ts)).cast("int")


def plus_minutes(ts: Column, minutes: Column | int) -> Column:
    """Shift by a signed number of minutes."""
    m = F.lit(minutes) if isinstance(minutes, int) else minutes
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), m.cast("int"))


def month_label(ts: Column, pattern: str = "yyyy-MM") -> Column:
    return F.date_format(ts, pattern)


def in_months(df: DataFrame, first: Column | None, last: Column | None = None) -> DataFrame:
    """Rows of the months from that of ``first`` to that of ``last``, by the partition column.

    A filter on ``ts`` alone opens the files of every month. A table without a
    ``month`` column stays as it is; the column is dropped.
    """
    if "month" not in df.columns:
        return df
    if first is not None:
        df = df.filter(F.col("month") >= month_label(first, "yyyyMM"))
    if last is not None:
        df = df.filter(F.col("month") <= month_label(last, "yyyyMM"))
    return df.drop("month")


def parse_wall_clock(text: Column) -> Column:
    """Read 'yyyy/MM/dd HH:mm' or 'yyyy-MM-dd HH:mm:ss' (I1).

    Unreadable text is NULL; no session zone takes part.
    """
    iso = F.regexp_replace(F.trim(text), r"^(\d{4})/(\d{1,2})/(\d{1,2})", "$1-$2-$3")
    return iso.try_cast("timestamp_ntz")


def slot_label(slot: Column) -> Column:
    """'HH:MM' of a half-hour slot number."""
    return F.format_string("%02d:%02d", F.floor(slot / F.lit(2)).cast("int"),
                           (slot % F.lit(2) * F.lit(30)).cast("int"))


def duration_text(minutes: Column, capped: Column) -> Column:
    """Human duration (I11): '2 h 5 m', '≥ 6 h' when the start was out of sight."""
    h = F.floor(minutes / F.lit(60)).cast("int")
    m = (minutes % F.lit(60)).cast("int")
    body = (F.when((h > 0) & (m > 0), F.format_string("%d h %d m", h, m))
            .when(h > 0, F.format_string("%d h", h))
            .otherwise(F.format_string("%d m", m)))
    started = F.when(capped, F.concat(F.lit("≥ "), body)).otherwise(body)
    return (F.when((minutes <= 0) & capped, F.lit("just seen"))
            .when(minutes <= 0, F.lit("-"))
            .otherwise(started))

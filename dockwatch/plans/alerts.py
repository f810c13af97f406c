"""Rule alerts with episode durations (L9, D15, E21, K6 batch form)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dockwatch.functions.cols import c
from dockwatch.functions import status as st, timefn as tf
from dockwatch.operators.frames import frame, own_rows, with_halo
from dockwatch.plans.serve import as_time, newest
from dockwatch.schemas import (ALERT_WINDOW_HOURS, CRITICAL_MINUTES, LEVEL_RANK, NEAR_LIMIT)



def kind_of(bikes: Column, docks: Column) -> Column:
    """Which limit a valid reading is at or near; near_empty goes first."""
    return (F.when(bikes == 0, "empty").when(docks == 0, "full")
            .when(bikes <= NEAR_LIMIT, "near_empty").when(docks <= NEAR_LIMIT, "near_full"))


def level_of(kind: Column, minutes: Column) -> Column:
    return (F.when(~kind.isin("empty", "full"), "notice")
            .when(minutes >= CRITICAL_MINUTES, "critical").otherwise("warning"))


def alerts(snapshots: DataFrame, stations: DataFrame, as_of: str | None = None,
           level: str | None = None, district: str | None = None) -> DataFrame:
    """Stations at or near a limit in the newest slot, with how long they have been.

    One conditional aggregation per station replaces a look-back join: the
    last reading outside the state is the max over readings outside it.
    """
    src = snapshots if as_of is None else snapshots.filter(F.col("ts") <= as_time(as_of))
    top = newest(src)
    since = top - F.make_dt_interval(F.lit(0), F.lit(ALERT_WINDOW_HOURS))
    win = tf.in_months(src, since, top).filter(F.col("ts") > since).filter(st.is_valid(c.bikes, c.docks, c.total))
    ts = F.col("ts")
    per = win.groupBy("station_id").agg(
        F.max("ts").alias("ts"), F.min("ts").alias("seen_from"),
        *[F.max_by(x, "ts").alias(x) for x in ("bikes", "docks_avail", "docks_total")],
        F.max(F.when(c.bikes != 0, ts)).alias("not_empty"), F.max(F.when(c.docks != 0, ts)).alias("not_full"))
    hit = (per.filter(ts == newest(win)).withColumn("kind", kind_of(c.bikes, c.docks))
           .filter(F.col("kind").isNotNull()))
    kind = F.col("kind")
    out_of_state = F.when(kind == "empty", F.col("not_empty")).when(kind == "full", F.col("not_full"))
    lasting = kind.isin("empty", "full")
    hit = hit.withColumns({
        "duration_min": F.when(lasting, tf.minutes_between(
            F.coalesce(out_of_state, F.col("seen_from")), ts)).otherwise(0).cast("int"),
        "duration_capped": lasting & out_of_state.isNull()})
    dims = stations.filter(st.active(F.col("always_empty"))).select(
        "station_id", "name", "district", "lon", "lat", "capacity_docks")
    out = hit.join(dims, "station_id").withColumn(
        "level", level_of(kind, F.col("duration_min")))
    if level is not None:
        out = out.filter(F.col("level") == F.lit(level))
    if district is not None:
        out = out.filter(F.col("district") == F.lit(district))
    return out.select(
        "station_id", "name", "district", "lon", "lat", "capacity_docks", "ts", "bikes",
        "docks_avail", "docks_total", "kind", "duration_min", "duration_capped", "level"
    ).orderBy(st.severity(F.col("level")), F.desc("duration_min"), "station_id")


def episodes(snapshots: DataFrame) -> DataFrame:
    """The look-back of ``alerts`` for every empty or full reading of the history."""
    reach = ALERT_WINDOW_HOURS * 2 - 1
    rows = with_halo(snapshots.filter(st.is_valid(c.bikes, c.docks, c.total)), tf.slot_index(F.col("ts")), reach, 0)
    w = frame(["station_id"], -reach, 0)
    ts = F.col("ts")
    rows = own_rows(rows.withColumns({
        "seen_from": F.min("ts").over(w), "not_empty": F.max(F.when(c.bikes != 0, ts)).over(w),
        "not_full": F.max(F.when(c.docks != 0, ts)).over(w)}))
    kind = F.when(c.bikes == 0, "empty").otherwise("full")
    last_ok = F.when(c.bikes == 0, F.col("not_empty")).otherwise(F.col("not_full"))
    return rows.filter((c.bikes == 0) | (c.docks == 0)).select(
        "station_id", "ts", kind.alias("kind"),
        tf.minutes_between(F.coalesce(last_ok, F.col("seen_from")), ts).cast("int").alias("duration_min"),
        last_ok.isNull().alias("duration_capped"))


def alert_counts(alert_rows: DataFrame) -> DataFrame:
    """Alerts per level and kind."""
    return alert_rows.groupBy("level", "kind").agg(F.count("*").alias("n"))


def escalations(alert_rows: DataFrame, seen: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(events to send, state to keep) of one alert round.

    Every station that rose is sent, however many there are: the state books
    all of them as seen. A page size is the reader's business.

    ``seen`` holds (station_id, level) of the round before, None on the very
    first round, which only records. Stations no longer alerting leave the
    state; a level that fell is remembered at the lower level.
    """
    now = alert_rows.filter(F.col("level").isin("warning", "critical"))
    state = now.select("station_id", "level")
    if seen is None:
        events = now.withColumn("prev_level", F.lit(None).cast("string")).limit(0)
    else:
        prev = seen.select("station_id", F.col("level").alias("prev_level"))
        rank, was = st.level_rank(F.col("level")), st.level_rank(F.col("prev_level"))
        events = now.join(prev, "station_id", "left").filter(
            F.col("prev_level").isNull() | (rank > F.coalesce(was, F.lit(0))))
    events = events.select(
        "station_id", "name", "district", "level", "prev_level", "kind", "duration_min",
        "bikes", "docks_avail", "docks_total", "ts")
    order = [st.severity(F.col("level")), F.desc("duration_min"), "station_id"]
    return events.orderBy(*order), state


assert set(LEVEL_RANK) == {"notice", "warning", "critical"}

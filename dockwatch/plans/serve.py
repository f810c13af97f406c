"""Read-side questions over snapshots, stations and latest state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dockwatch.functions.cols import c
from dockwatch.functions import status as st, timefn as tf
from dockwatch.operators.dedupe import latest_rows

PLACE = ["name", "district", "lon", "lat"]
COUNTS = ["bikes", "docks_avail", "docks_total"]


def as_time(value: str | Column) -> Column:
    return F.lit(value).cast("timestamp_ntz") if isinstance(value, str) else value


def newest(df: DataFrame, column: str = "ts") -> Column:
    """max(column) as a scalar subquery, from the newest month alone if months are known."""
    if "month" in df.columns:
        df = df.filter(F.col("month") == df.agg(F.max("month")).scalar())
    return df.agg(F.max(column)).scalar()


def active_stations(stations: DataFrame, district: str | None = None,
                    columns: list[str] | None = None) -> DataFrame:
    """Stations that take part, optionally of one district."""
    out = stations.filter(st.active(F.col("always_empty")))
    if district is not None:
        out = out.filter(F.col("district") == F.lit(district))
    return out.select("station_id", *(columns or []))


def latest(snapshots: DataFrame) -> DataFrame:
    """Newest reading of every station (F2)."""
    return latest_rows(snapshots, ["station_id"], "ts", COUNTS)


def latest_slot(snapshots: DataFrame, stations: DataFrame) -> DataFrame:
    """All readings of the newest slot with station attributes."""
    top = newest(snapshots)
    now = tf.in_months(snapshots, top, top).filter(F.col("ts") == top)
    return now.join(stations.select("station_id", *PLACE), "station_id").select(
        "station_id", "ts", *COUNTS, *PLACE, F.col("ts").alias("fetched_at"))


def station_list(stations: DataFrame, latest: DataFrame | None, district: str | None = None,
                 status: str | None = None, include_inactive: bool = False) -> DataFrame:
    """Every station with its current state, also those without data."""
    dims = stations.select("station_id", *PLACE, "capacity_docks", "always_empty")
    if latest is None:
        out = dims.withColumns({
            "ts": F.lit(None).cast("timestamp_ntz"),
            **{x: F.lit(None).cast("short") for x in COUNTS},
            "occ_rate": F.lit(None).cast("double"), "status": F.lit("unknown")})
    else:
        out = dims.join(latest.select("station_id", "ts", *COUNTS), "station_id", "left").withColumns({
            "occ_rate": st.occupancy(c.bikes, c.total), "status": st.status(c.bikes, c.docks, c.total)})
    if not include_inactive:
        out = out.filter(st.active(F.col("always_empty")))
    if district is not None:
        out = out.filter(F.col("district") == F.lit(district))
    if status is not None:
        out = out.filter(F.col("status") == F.lit(status))
    return out.orderBy("station_id")


def mappable(stations: DataFrame) -> DataFrame:
    """Only rows a map can place (C14)."""
    return stations.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull()
                           & (F.col("lon") != 0) & (F.col("lat") != 0))


def _level_stats() -> list[Column]:
    return [
        F.count("*").alias("n_snapshots"),
        st.steady_round(F.avg("bikes"), 2).alias("bikes_mean"),
        st.steady_round(st.share(c.bikes == 0), 4).alias("empty_rate"),
        st.steady_round(st.share(c.docks == 0), 4).alias("full_rate"),
        st.steady_round(F.avg(st.safe_ratio(c.bikes, c.total)), 4).alias("occ_rate")]


def station_stats(snapshots: DataFrame, station_id: int) -> DataFrame:
    """Long-run figures of one station."""
    return snapshots.filter(F.col("station_id") == F.lit(station_id)).agg(*_level_stats())


def all_station_stats(snapshots: DataFrame) -> DataFrame:
    """E11 for every station in one aggregation."""
    return snapshots.groupBy("station_id").agg(*_level_stats())


def station_detail(stations: DataFrame, latest: DataFrame, snapshots: DataFrame,
                   station_id: int) -> DataFrame:
    """Master row, current state and long-run figures of one station (L3)."""
    me = F.col("station_id") == F.lit(station_id)
    now = latest.filter(me).select(
        "station_id", F.struct("ts", *COUNTS, st.status(c.bikes, c.docks, c.total).alias("status")).alias("current"))
    stats = (snapshots.filter(me).groupBy("station_id").agg(*_level_stats()))
    stats = stats.select("station_id", F.struct(*stats.columns[1:]).alias("stats"))
    return (stations.filter(me).join(now, "station_id", "left").join(stats, "station_id", "left"))


def station_history(snapshots: DataFrame, station_id: int, days: int = 7,
                    end: str | None = None) -> DataFrame:
    """Readings of one station over the last ``days``."""
    stop = as_time(end) if end is not None else newest(snapshots)
    start = stop - F.make_dt_interval(F.lit(days))
    return (tf.in_months(snapshots, start, stop).filter(F.col("station_id") == F.lit(station_id))
            .filter((F.col("ts") > stop - F.make_dt_interval(F.lit(days)))
                    & (F.col("ts") <= stop))
            .select("ts", *COUNTS, st.occupancy(c.bikes, c.total).alias("occ_rate"))
            .orderBy("ts"))


def replay(snapshots: DataFrame, stations: DataFrame, ts: str | Column) -> DataFrame:
    """State of the whole city at one moment."""
    # A literal moment keeps the filter a plain comparison the scan can prune on.
    slot = tf.slot_start(as_time(ts))
    return (tf.in_months(snapshots, slot, slot).filter(F.col("ts") == slot)
            .join(active_stations(stations, columns=PLACE), "station_id")
            .select("station_id", *PLACE, "ts", *COUNTS,
                    st.occupancy(c.bikes, c.total).alias("occ_rate"), st.status(c.bikes, c.docks, c.total).alias("status"))
            .orderBy("station_id"))


def status_histogram(rows: DataFrame) -> DataFrame:
    """Stations per status."""
    return rows.groupBy("status").agg(F.count("*").alias("n_stations"))


def replay_days(snapshots: DataFrame, min_slots: int = 0) -> DataFrame:
    """Rows and distinct slots per day; a player wants well-filled days."""
    return (snapshots.groupBy(F.col("ts").cast("date").alias("day"))
            .agg(F.count("*").alias("n_rows"), F.countDistinct("ts").alias("n_slots"))
            .filter(F.col("n_slots") >= min_slots).orderBy("day"))


def day_filter(day: str | Column) -> Column:
    """A calendar day as a half-open range, so files and row groups prune."""
    start = as_time(day)
    return (F.col("ts") >= start) & (F.col("ts") < start + F.make_dt_interval(F.lit(1)))


def pulse(snapshots: DataFrame, stations: DataFrame, day: str | None = None,
          every_day: bool = False) -> DataFrame:
    """Empty / full / risk station counts per slot.

    Of one day, by default the newest, or of the whole history.
    """
    if every_day:
        rows = snapshots
    else:
        start = as_time(day) if day is not None else newest(snapshots).cast("date").cast("timestamp_ntz")
        rows = tf.in_months(snapshots, start, start).filter(day_filter(start))
    return (rows.join(active_stations(stations), "station_id")
            .groupBy("ts").agg(
                F.count("*").alias("n_stations"),
                st.tally(st.only_empty(c.bikes, c.docks)).alias("n_empty"),
                st.tally(st.only_full(c.bikes, c.docks)).alias("n_full"),
                st.tally(st.at_risk(c.bikes, c.docks)).alias("n_risk"),
                F.sum("bikes").alias("bikes"),
                st.steady_round(st.safe_ratio(F.sum("bikes"), F.sum("docks_total")), 4).alias("occ_rate"))
            .select("ts", tf.slot_of_day(F.col("ts")).alias("slot"), "n_stations", "n_empty",
                    "n_full", "n_risk", "bikes", "occ_rate")
            .orderBy("ts"))


def pulse_baseline(profile: DataFrame, stations: DataFrame, isodow: int | Column) -> DataFrame:
    """Expected empty / full counts of a weekday: the rates of all stations added up."""
    dow = F.lit(isodow) if isinstance(isodow, int) else isodow
    return (profile.filter(F.col("isodow") == dow)
            .join(active_stations(stations), "station_id")
            .groupBy("slot").agg(st.steady_round(F.sum("empty_rate"), 1).alias("n_empty"),
                                 st.steady_round(F.sum("full_rate"), 1).alias("n_full"))
            .orderBy("slot"))


def pulse_against_baseline(day: DataFrame, base: DataFrame, floor: float = 10.0) -> DataFrame:
    """Both curves on one slot axis with a common scale (D20); at most 48 rows."""
    d = day.select("slot", F.col("n_empty").cast("double").alias("n_empty"),
                   F.col("n_full").cast("double").alias("n_full"))
    b = base.select("slot", F.col("n_empty").alias("base_empty"), F.col("n_full").alias("base_full"))
    both = d.join(b, "slot", "full")
    peak = F.greatest(F.lit(floor), *[F.max(x) for x in
                                      ("n_empty", "n_full", "base_empty", "base_full")])
    scale = both.agg(peak).scalar()
    return both.withColumn("scale_max", scale).withColumns({
        f"{x}_scaled": st.steady_round(F.col(x) / F.col("scale_max"), 6)
        for x in ("n_empty", "n_full", "base_empty", "base_full")}).orderBy("slot")


def _state_counts() -> list[Column]:
    return [
        st.tally(st.only_empty(c.bikes, c.docks)).alias("n_empty"),
        st.tally(st.only_full(c.bikes, c.docks)).alias("n_full"),
        st.tally(st.is_offline(c.bikes, c.docks)).alias("n_offline")]


def districts(stations: DataFrame, latest: DataFrame | None) -> DataFrame:
    """Current figures per district, worst first."""
    if latest is None:
        return (active_stations(stations, columns=["district", "capacity_docks"])
                .groupBy("district")
                .agg(F.count("*").alias("n_stations"), F.sum("capacity_docks").alias("capacity"))
                .orderBy(F.desc("n_stations"), F.asc_nulls_last("district")))
    dims = active_stations(stations, columns=["district"]).filter(F.col("district").isNotNull())
    return (latest.join(dims, "station_id").groupBy("district").agg(
        F.count("*").alias("n_stations"),
        *[F.sum(x).alias(x) for x in ("docks_total", "bikes", "docks_avail")],
        st.steady_round(st.safe_ratio(F.sum("bikes"), F.sum("docks_total")), 4).alias("occ_rate"),
        *_state_counts(),
        st.tally((c.bikes <= 2) & (c.bikes > 0)).alias("n_near_empty"),
        st.tally((c.docks <= 2) & (c.docks > 0)).alias("n_near_full"))
        .orderBy(F.desc(F.col("n_empty") + F.col("n_full")), F.desc("n_stations"), "district"))


def problem_bars(district_rows: DataFrame) -> DataFrame:
    """Problem count of a district relative to the worst one."""
    n = F.col("n_empty") + F.col("n_full")
    worst = district_rows.agg(F.greatest(F.lit(1), F.max(n))).scalar()
    return district_rows.select("district", n.alias("n_problem"),
                                st.steady_round(n / worst, 6).alias("bar"))


def district_list(stations: DataFrame) -> DataFrame:
    """Known districts in order."""
    return (stations.select("district").filter(F.col("district").isNotNull())
            .distinct().orderBy("district"))


def overview_now(stations: DataFrame, latest: DataFrame) -> DataFrame:
    """City figures of this moment."""
    return latest.join(active_stations(stations), "station_id").agg(
        F.max("ts").alias("as_of"), F.count("*").alias("n_stations"),
        F.sum("bikes").alias("bikes"), F.sum("docks_total").alias("docks_total"),
        st.steady_round(st.safe_ratio(F.sum("bikes"), F.sum("docks_total")), 4).alias("occ_rate"),
        *_state_counts(), st.tally(st.at_risk(c.bikes, c.docks)).alias("n_risk"))


def overview_history(stations: DataFrame, snapshots: DataFrame) -> DataFrame:
    """City figures of the whole history (E9); offline rows count here."""
    return snapshots.join(active_stations(stations), "station_id").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_rows"),
        F.countDistinct("station_id").alias("n_stations"),
        st.steady_round(st.share(c.bikes == 0), 4).alias("empty_rate"),
        st.steady_round(st.share(c.docks == 0), 4).alias("full_rate"))


def worst_stations(snapshots: DataFrame, stations: DataFrame, metric: str = "empty",
                   limit: int = 20, min_rows: int = 100) -> DataFrame:
    """Stations most often empty or full.

    The facts are reduced to one row per station before they meet the
    dimension.
    """
    by = "empty_rate" if metric == "empty" else "full_rate"
    rates = snapshots.groupBy("station_id").agg(
        F.count("*").alias("n"), st.steady_round(st.share(c.bikes == 0), 4).alias("empty_rate"),
        st.steady_round(st.share(c.docks == 0), 4).alias("full_rate")).filter(F.col("n") > min_rows)
    dims = active_stations(stations, columns=["name", "district", "capacity_docks"])
    return (rates.join(dims, "station_id")
            .select("station_id", "name", "district", "capacity_docks", "n", "empty_rate", "full_rate")
            .orderBy(F.desc(by), "station_id").limit(limit))


def coverage(snapshots: DataFrame) -> DataFrame:
    """Span and size of the history."""
    return snapshots.agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_rows"),
        F.countDistinct("station_id").alias("n_stations"))


def freshness(latest: DataFrame) -> DataFrame:
    """How current the newest state is."""
    return latest.agg(F.max("ts").alias("last_ts"), F.max("fetched_at").alias("fetched_at"),
                      F.count("*").alias("n_stations"))


def file_coverage(df: DataFrame) -> DataFrame:
    """Size and age of the files behind a file-backed DataFrame."""
    m = F.col("_metadata")
    return (df.select(m.file_path.alias("file"), m.file_size.alias("bytes"),
                      m.file_modification_time.alias("modified"))
            .groupBy("file").agg(F.max("bytes").alias("bytes"), F.max("modified").alias("modified"),
                                 F.count("*").alias("n_rows")))

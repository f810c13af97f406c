"""History build and quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dockwatch.functions import status as st, textfn as tx, timefn as tf
from dockwatch.operators.dedupe import latest_records
from dockwatch.operators.ordering import numbered
from dockwatch.session import stage


def clean_rows(raw: DataFrame, fixes: DataFrame | None = None) -> DataFrame:
    """Typed history rows: parsed time, trimmed texts, corrected names.

    ``raw`` follows schemas.HISTORY_CSV; ``fixes`` has (old_name, new_name)
    and is small enough for Spark to choose its own join.
    """
    rows = raw.select(
        tf.parse_wall_clock(F.col("raw_time")).alias("raw_ts"),
        F.trim("district").alias("district"), F.trim("name").alias("name"),
        "docks_total", "bikes", "docks_avail", "lon", "lat")
    if fixes is None:
        return rows
    return (rows.join(fixes, rows["name"] == fixes["old_name"], "left")
            .withColumn("name", F.coalesce("new_name", "name")).drop("old_name", "new_name"))


def one_row_per_slot(rows: DataFrame) -> DataFrame:
    """Newest raw reading per station name and slot."""
    slotted = rows.withColumn("ts", tf.slot_start(F.col("raw_ts")))
    return latest_records(slotted, ["name", "ts"], [
        "raw_ts", "bikes", "docks_avail", "docks_total"]).drop("raw_ts")


def _most_frequent(value: str, chosen: Column) -> Column:
    """Value with the highest count; equal counts go to the smaller value."""
    use = chosen & F.col(value).isNotNull()
    return F.min_by(F.when(use, F.col(value)), F.when(use, F.struct(-F.col("n"), F.col(value))))


def station_master(slot_rows: DataFrame) -> DataFrame:
    """One row per name with a dense id in order of first appearance.

    Grouping sets count every district, lon, lat and (lon, lat) of a name in
    one pass; all later work runs on those few counted rows.
    """
    name, dist, lon, lat = (F.col(c) for c in ("name", "district", "lon", "lat"))
    src = slot_rows.withColumn("district", tx.blank_to_null(dist))
    counted = src.groupingSets(
        [[name, dist], [name, lon], [name, lat], [name, lon, lat]], name, dist, lon, lat
    ).agg(F.grouping_id().alias("g"), F.count("*").alias("n"),
          F.max("docks_total").alias("mx_total"), F.max("bikes").alias("mx_bikes"),
          F.min("ts").alias("mn_ts"), F.max("ts").alias("mx_ts"))
    # grouping_id bits, high to low: name district lon lat; 1 = not grouped.
    by_dist, by_lon, by_lat, by_place = (F.col("g") == g for g in (0b0011, 0b0101, 0b0110, 0b0100))
    master = counted.groupBy("name").agg(
        _most_frequent("district", by_dist).alias("district"),
        _most_frequent("lon", by_lon).alias("lon"),
        _most_frequent("lat", by_lat).alias("lat"),
        F.max("mx_total").cast("int").alias("capacity_docks"),
        F.min("mn_ts").alias("first_ts"), F.max("mx_ts").alias("last_ts"),
        F.sum(F.when(by_place, F.col("n"))).alias("n_snapshots"),
        (F.max("mx_bikes") == 0).alias("always_empty"),
        F.count_if(by_place).alias("n_coord_variants"))
    ordered = numbered(master, [F.col("first_ts").asc_nulls_last(), F.col("name").asc_nulls_last()],
                       "station_id")
    return ordered.select(
        "station_id", "name", "district", "lon", "lat", "capacity_docks", "first_ts", "last_ts",
        "n_snapshots", "always_empty", "n_coord_variants")


def facts(slot_rows: DataFrame, stations: DataFrame) -> DataFrame:
    """Snapshot fact table keyed by station id."""
    return slot_rows.join(stations.select("station_id", "name"), "name").select(
        "station_id", "ts",
        *[F.col(c).cast("short").alias(c) for c in ("bikes", "docks_avail", "docks_total")])


def build_history(sources: list[DataFrame], fixes: DataFrame | None = None
                  ) -> tuple[DataFrame, DataFrame]:
    """(snapshots, stations) from any number of raw sources (L1)."""
    raw = sources[0]
    for more in sources[1:]:
        raw = raw.unionByName(more)
    slot_rows = stage(one_row_per_slot(clean_rows(raw, fixes)), "slot_rows")
    stations = stage(station_master(slot_rows), "stations")
    return facts(slot_rows, stations), stations


def enriched(snapshots: DataFrame, stations: DataFrame) -> DataFrame:
    """Analysis view: calendar parts, flags and occupancy per reading."""
    ts = F.col("ts")
    dims = stations.select("station_id", "name", "district", "lon", "lat", "always_empty")
    return snapshots.join(dims, "station_id").select(
        "station_id", "name", "district", "ts",
        ts.cast("date").alias("date"), F.hour(ts).cast("int").alias("hour"),
        tf.iso_weekday(ts).alias("isodow"), (tf.iso_weekday(ts) >= 6).alias("is_weekend"),
        "bikes", "docks_avail", "docks_total",
        (F.col("bikes") == 0).alias("is_empty"), (F.col("docks_avail") == 0).alias("is_full"),
        st.occupancy(F.col("bikes"), F.col("docks_total")).alias("occ_rate"),
        "lon", "lat", "always_empty")


def registry_rows(raw: DataFrame) -> DataFrame:
    """Station rows as first seen in raw readings (E2); one per (id, name)."""
    def some(c: str) -> Column:
        return F.min(c).alias(c)
    return raw.groupBy("station_id", "name").agg(
        some("district"), some("lon"), some("lat"),
        F.max("docks_total").cast("int").alias("capacity_docks"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.count("*").alias("n_snapshots"), (F.max("bikes") == 0).alias("always_empty"))


def append_unseen(existing: DataFrame, raw: DataFrame) -> DataFrame:
    """Existing registry plus the ids it lacks (D5, H2); new ones start as active."""
    unseen = raw.join(existing.select("station_id"), "station_id", "left_anti")
    fresh = registry_rows(unseen).withColumn("always_empty", F.lit(False))
    return existing.unionByName(fresh)


def merge_masters(primary: DataFrame, secondary: DataFrame, key: str) -> DataFrame:
    """All of primary, and from secondary only the keys primary lacks."""
    return primary.unionByName(secondary.join(primary.select(key), key, "left_anti"))


def month_quality(snapshots: DataFrame) -> DataFrame:
    """Rows, stations and empty / full share per month."""
    return snapshots.groupBy(tf.month_label(F.col("ts")).alias("month")).agg(
        F.count("*").alias("n_rows"), F.countDistinct("station_id").alias("n_stations"),
        st.steady_round(F.lit(100.0) * st.share(F.col("bikes") == 0), 2).alias("empty_pct"),
        st.steady_round(F.lit(100.0) * st.share(F.col("docks_avail") == 0), 2).alias("full_pct"))


def station_quality(stations: DataFrame) -> DataFrame:
    """Counts of suspicious stations (E15); needs n_coord_variants."""
    return stations.agg(
        F.count("*").alias("n_stations"),
        F.count_if("always_empty").alias("n_always_empty"),
        F.count_if(F.col("district").isNull()).alias("n_no_district"),
        F.count_if(tx.damaged_name(F.col("name"))).alias("n_damaged_name"),
        F.count_if(F.col("n_coord_variants") > 1).alias("n_moved"))


def misaligned_rows(snapshots: DataFrame) -> DataFrame:
    """How many readings are off the half-hour raster."""
    return snapshots.agg(F.count_if(~F.minute("ts").isin(0, 30)).alias("n_misaligned"))

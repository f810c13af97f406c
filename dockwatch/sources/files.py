"""Readers of landed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from dockwatch import schemas as sc
from dockwatch.functions import textfn as tx, timefn as tf
from dockwatch.operators.dedupe import latest_rows


def _exists(spark: SparkSession, path: str) -> bool:
    """True if the path or pattern matches anything, on any file system Spark can reach."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def empty(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


def parquet_or_empty(spark: SparkSession, paths: str | list[str], schema: T.StructType | str) -> DataFrame:
    """Parquet files as one table; no rows where a path does not exist yet (A2, A3, A10)."""
    wanted = [paths] if isinstance(paths, str) else paths
    there = [p for p in wanted if _exists(spark, p)]
    if not there:
        return empty(spark, schema)
    return spark.read.schema(schema).parquet(*there)


def history_csv(spark: SparkSession, glob: str, encoding: str = "UTF-8") -> DataFrame:
    """Raw history CSV with a header line; columns go by position (A1)."""
    return (spark.read.schema(sc.HISTORY_CSV).option("header", True).option("encoding", encoding)
            .csv(glob))


def history(spark: SparkSession, root: str, recent: str | None = None,
            months: int | None = None, with_month: bool = False) -> DataFrame:
    """Monthly history plus the recent table as one snapshot table (A2, A4).

    ``root`` is partitioned by month=yyyyMM. With ``months`` only the newest
    partitions are listed and read. ``with_month`` keeps the partition column,
    by which time filters of the serving questions skip whole months.
    """
    cols = [f.name for f in sc.SNAPSHOT.fields]
    schema = T.StructType(sc.SNAPSHOT.fields + [T.StructField("month", T.StringType())])
    hist = parquet_or_empty(spark, root, schema)
    newest = sorted(set(_partition_values(spark, root, "month")))[-months:] if months is not None else []
    if newest:
        hist = hist.filter(F.col("month").isin(newest))
    out = hist.select(*cols, "month")
    if recent is not None:
        fresh = parquet_or_empty(spark, recent, sc.SNAPSHOT)
        out = out.unionByName(fresh.withColumn("month", tf.month_label(F.col("ts"), "yyyyMM")))
    return out if with_month else out.drop("month")


def _partition_values(spark: SparkSession, root: str, column: str) -> list[str]:
    """Values of a partition column from the folder names alone."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{root}/{column}=*")
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) or []
    return [s.getPath().getName().split("=", 1)[1] for s in found]


def raw_snapshots(spark: SparkSession, root: str, now: str | None = None,
                  days: int = sc.RAW_KEEP_DAYS) -> DataFrame:
    """Raw snapshot files of the last ``days``, chosen by the time in their
    names (snap_yyyyMMddTHHmm.parquet); other names are skipped (A5)."""
    path = f"{root}/snap_*.parquet"
    if not _exists(spark, path):
        return empty(spark, sc.RAW_SNAPSHOT)
    stamp = F.regexp_extract(F.col("_metadata.file_name"),
                             r"^snap_(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})\.parquet$", 0)
    iso = F.regexp_replace(stamp, r"^snap_(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2}).*", "$1-$2-$3 $4:$5:00")
    named = spark.read.schema(sc.RAW_SNAPSHOT).parquet(path).withColumn(
        "_file_ts", iso.try_cast("timestamp_ntz"))
    end = F.localtimestamp() if now is None else F.lit(now).cast("timestamp_ntz")
    keep = F.col("_file_ts") >= end - F.make_dt_interval(F.lit(days))
    return named.filter(keep).drop("_file_ts")


def realtime_rows(records: DataFrame, fetched_at, prefix: str = "",
                  fixes: dict[str, str] | None = None) -> DataFrame:
    """Typed rows from realtime records (A6, J1-J7); unusable ones are left out."""
    ok, _ = split_realtime(records, fetched_at, prefix, fixes)
    return ok


def split_realtime(records: DataFrame, fetched_at, prefix: str = "",
                   fixes: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(usable typed rows, rejected raw records)."""
    name = tx.relabel(tx.strip_prefix(F.coalesce("sna", F.lit("")), prefix), fixes or {})
    ints = ["sbi_quantity", "bemp", "tot_quantity", "yb2_quantity", "eyb_quantity"]
    usable = name != ""
    for x in ints:
        usable = usable & tx.is_number_or_blank(F.col(x), "int")
    for x in ("lng", "lat"):
        usable = usable & tx.is_number_or_blank(F.col(x), "double")
    rows = records.filter(usable).select(
        name.alias("name"), tx.blank_to_null(F.col("sarea")).alias("district"),
        tx.count_field(F.col("sbi_quantity")).alias("bikes"),
        tx.count_field(F.col("bemp")).alias("docks_avail"),
        tx.count_field(F.col("tot_quantity")).alias("docks_total"),
        tx.degree_field(F.col("lng")).alias("lon"), tx.degree_field(F.col("lat")).alias("lat"),
        F.coalesce("sno", F.lit("")).alias("sno"),
        F.coalesce(F.col("act") == "1", F.lit(False)).alias("act"),
        tx.count_field(F.col("yb2_quantity")).alias("bikes_yb2"),
        tx.count_field(F.col("eyb_quantity")).alias("bikes_eyb"),
        F.coalesce("mday", F.lit("")).alias("mday"), fetched_at.alias("fetched_at"))
    return rows, records.filter(~usable)


def historical_day(records: DataFrame, uid_prefix: str = "") -> DataFrame:
    """Newest record per station number and slot of historical records.

    The time is the wall clock as written; a zone suffix is dropped.
    """
    wall = F.regexp_replace(F.col("SrcUpdateTime"), r"(Z|[+-]\d{2}:?\d{2})$", "").try_cast("timestamp_ntz")
    rows = records.select(
        tx.strip_prefix(F.col("StationUID"), uid_prefix).alias("sno"), wall.alias("raw_ts"),
        F.col("AvailableRentBikes").alias("bikes"), F.col("AvailableReturnBikes").alias("docks_avail")
    ).withColumn("slot", tf.slot_start(F.col("raw_ts")))
    return latest_rows(rows, ["sno", "slot"], "raw_ts", ["bikes", "docks_avail"])


def nested_stations(records: DataFrame, uid_prefix: str = "", name_prefix: str = "",
                    district_pattern: str = r"(\S+)") -> DataFrame:
    """Station master from nested records (J5, J6); schemas.STATION_JSON."""
    return records.select(
        tx.strip_prefix(F.col("StationUID"), uid_prefix).alias("sno"),
        tx.capture(F.col("StationAddress.Zh_tw"), district_pattern).alias("district"),
        tx.strip_prefix(F.col("StationName.Zh_tw"), name_prefix).alias("name"),
        F.col("StationPosition.PositionLon").alias("lon"),
        F.col("StationPosition.PositionLat").alias("lat"))


def backfill_rows(day_rows: DataFrame, masters: DataFrame, city: str
                  ) -> tuple[DataFrame, DataFrame]:
    """(history CSV rows, station numbers no master knows) of one historical day."""
    known = day_rows.join(masters, "sno")
    unknown = day_rows.join(masters.select("sno"), "sno", "left_anti").select("sno").distinct()
    rows = known.select(
        F.date_format("raw_ts", "yyyy-MM-dd HH:mm:ss").alias("raw_time"), F.lit(city).alias("city"),
        "district", "name", (F.col("bikes") + F.col("docks_avail")).alias("docks_total"), "bikes",
        "docks_avail", "lon", "lat")
    return rows, unknown


def name_lookup(spark: SparkSession, stations_path: str) -> DataFrame:
    """(name, station_id): only these two columns are read."""
    return parquet_or_empty(spark, stations_path, sc.STATION).select("name", "station_id")

"""Durable outputs."""

from __future__ import annotations

import datetime as dt
import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from dockwatch.functions import textfn as tx, timefn as tf
from dockwatch.schemas import RAW_KEEP_DAYS
from dockwatch.session import stage

POINTER = "CURRENT"      # file readers skip names that start with _ or .
RETIRED = "_retired"     # one empty file for each version that is no longer current
KEPT_HOURS = 24          # so long a reader may still use a version after the flip


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_counted(df: DataFrame, write) -> int:
    """Run ``write(df)`` and return its row count without reading back."""
    seen = Observation(f"rows-{uuid.uuid4().hex}")
    write(df.observe(seen, F.count("*").alias("n")))
    return int(seen.get["n"])


def export_months(snapshots: DataFrame, root: str) -> int:
    """History partitioned by month, clustered by station and time.

    Range partitioning on the full sort key gives files of similar size with
    narrow station ranges; neither a large month nor a large station ends up
    in one task. Only the months present are replaced.
    """
    out = (snapshots.withColumn("month", tf.month_label(F.col("ts"), "yyyyMM"))
           .repartitionByRange("month", "station_id", "ts")
           .sortWithinPartitions("month", "station_id", "ts"))
    return write_counted(out, lambda d: (
        d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd").partitionBy("month").parquet(root)))


def children(spark: SparkSession, root: str, pattern: str) -> list[str]:
    """Names in a folder that match a pattern; none if there is no such folder."""
    fs, path = _fs(spark, f"{root}/{pattern}")
    return [s.getPath().getName() for s in fs.globStatus(path) or []]


def drop_path(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _flip(spark: SparkSession, root: str, text: str) -> None:
    """Replace the pointer file in one rename."""
    fs, path = _fs(spark, f"{root}/{POINTER}-{uuid.uuid4().hex}")
    out = fs.create(path, True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        path.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    opts = spark.sparkContext._gateway.new_array(rename, 1)
    opts[0] = rename.OVERWRITE
    context.rename(path, jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTER}"), opts)


def _pointer(spark: SparkSession, root: str) -> list[str]:
    """Lines of the pointer file, none before the first publish."""
    fs, path = _fs(spark, f"{root}/{POINTER}")
    if not fs.exists(path):
        return []
    return [r[0] for r in spark.read.text(f"{root}/{POINTER}").collect()]


def publish(df: DataFrame, root: str) -> int:
    """Replace a whole table so that readers see the old or the new one (B2).

    Data go to a fresh version folder; the small pointer file is flipped last.
    """
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    n = write_counted(df, lambda d: d.write.option("compression", "zstd").parquet(f"{root}/{version}"))
    _flip(spark, root, version)
    _drop_old_versions(spark, root, {version})
    return n


def publish_days(df: DataFrame, root: str, keep_days: int | None = None, now: str | None = None,
                 spread: str = "station_id") -> int:
    """Replace only the days present in ``df`` (column ``day``), all at once (B2).

    The pointer lists one version per day, so untouched days are neither read
    nor written. With ``keep_days`` days that far behind ``now`` (a date, today
    if none is given) are let go; what the data say about time plays no part.
    """
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    n = write_counted(df.repartition("day", F.pmod(F.xxhash64(spread), F.lit(8))), lambda d: (
        d.write.option("compression", "zstd").partitionBy("day").parquet(f"{root}/{version}")))
    fs, pattern = _fs(spark, f"{root}/{version}/day=*")
    current = dict(line.split(" ") for line in _pointer(spark, root))
    current |= {s.getPath().getName().split("=", 1)[1]: version for s in fs.globStatus(pattern) or []}
    if keep_days is not None and current:
        edge = _day(now) - dt.timedelta(days=keep_days)
        current = {d: v for d, v in current.items() if dt.date.fromisoformat(d) >= edge}
    _flip(spark, root, "\n".join(f"{d} {v}" for d, v in sorted(current.items())))
    _drop_old_versions(spark, root, set(current.values()))
    return n


def _day(now: str | None) -> dt.date:
    return dt.date.fromisoformat(now[:10]) if now else dt.date.today()


def read_days(spark: SparkSession, root: str, schema: T.StructType, newest: int | None = None,
              upto: str | None = None) -> DataFrame:
    """The published days as one table, or only the newest few, none of them after ``upto`` (a date)."""
    lines = [line.split(" ") for line in _pointer(spark, root)]
    if upto is not None:
        lines = [x for x in lines if x[0] <= upto[:10]]
    if newest is not None:
        lines = lines[-newest:]
    if not lines:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/{v}/day={d}" for d, v in lines])


def _drop_old_versions(spark: SparkSession, root: str, current: set[str]) -> None:
    """Remove versions that stopped being current more than KEPT_HOURS ago."""
    fs, pattern = _fs(spark, f"{root}/v-*")
    edge = (time.time() - KEPT_HOURS * 3600) * 1000
    for s in fs.globStatus(pattern) or []:
        name = s.getPath().getName()
        if name in current:
            continue
        _, mark = _fs(spark, f"{root}/{RETIRED}/{name}")
        if not fs.exists(mark):
            fs.create(mark, True).close()
        elif fs.getFileStatus(mark).getModificationTime() < edge:
            fs.delete(s.getPath(), True)
            fs.delete(mark, False)


def published_path(spark: SparkSession, root: str) -> str | None:
    """Folder of the current version, None before the first publish."""
    lines = _pointer(spark, root)
    return f"{root}/{lines[0]}" if lines else None


def read_published(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    path = published_path(spark, root)
    return spark.createDataFrame([], schema) if path is None else spark.read.schema(schema).parquet(path)


def append_csv(rows: DataFrame, root: str) -> int:
    """Append history rows as CSV with header, one folder per month."""
    month = tf.month_label(tf.parse_wall_clock(F.col("raw_time")), "yyyyMM")
    return write_counted(rows.withColumn("month", month), lambda d: (
        d.write.mode("append").option("header", True).partitionBy("month").csv(root)))


def export_splits(splits: dict[str, DataFrame], root: str) -> dict[str, int]:
    """Feature sets by split, ordered by time and station inside the files."""
    return {name: write_counted(
        df.repartitionByRange("ts", "station_id").sortWithinPartitions("ts", "station_id"),
        lambda d, name=name: d.write.mode("overwrite").option("compression", "zstd")
        .parquet(f"{root}/split={name}")) for name, df in splits.items()}


def export_tables(tables: dict[str, DataFrame], root: str) -> dict[str, int]:
    """Small tables that scoring needs, each published whole."""
    return {name: publish(df, f"{root}/{name}") for name, df in tables.items()}


def write_report(report: DataFrame, path: str) -> None:
    """One JSON document per report row."""
    report.select(tx.as_json(*report.columns).alias("value")).write.mode("overwrite").text(path)


def drop_expired_days(spark: SparkSession, root: str, now: str, days: int = RAW_KEEP_DAYS) -> int:
    """Delete day=yyyy-MM-dd partitions older than ``days`` before ``now``."""
    edge = _day(now) - dt.timedelta(days=days)
    fs, pattern = _fs(spark, f"{root}/day=*")
    gone = 0
    for s in fs.globStatus(pattern) or []:
        try:
            day = dt.date.fromisoformat(s.getPath().getName().split("=", 1)[1])
        except ValueError:
            continue
        if day < edge:
            gone += bool(fs.delete(s.getPath(), True))
    return gone


LEDGER = "day date, n long"


def backfill(rows: DataFrame, day_column: str, root: str, ledger: str, days: list[str] | None = None) -> int:
    """Write only the days the ledger does not list, then list them with their number of rows.

    ``days`` are the days that were asked for: one without rows is listed too, with 0, and
    not asked for again. Without it the days of the rows are meant. A day is replaced as a
    whole, so a run that died before the ledger entry is simply repeated; what a dead run
    left in the target is not looked at.
    """
    spark = rows.sparkSession
    todo = rows
    if days is not None:
        todo = todo.filter(F.col(day_column).cast("string").isin(days))
    done = read_ledger(spark, ledger)
    todo = stage(todo.join(done.select(F.col("day").alias(day_column)), day_column, "left_anti"), "backfill")
    n = write_counted(todo, lambda d: (
        d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(day_column).parquet(root)))
    entries = todo.groupBy(F.col(day_column).cast("date").alias("day")).agg(F.count("*").alias("n"))
    if days is not None:
        asked = spark.createDataFrame([(d,) for d in days], "day string").select(F.col("day").cast("date")).distinct()
        entries = asked.join(entries, "day", "left").join(done, "day", "left_anti").select(
            "day", F.coalesce("n", F.lit(0)).alias("n"))
    entries.coalesce(1).write.mode("append").parquet(ledger)
    return n


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    fs, path = _fs(spark, ledger)
    return spark.read.schema(LEDGER).parquet(ledger) if fs.exists(path) else spark.createDataFrame([], LEDGER)


def missing_days(spark: SparkSession, ledger: str, days: list[str]) -> list[str]:
    """Which of ``days`` are still to be fetched."""
    have = {str(r[0]) for r in read_ledger(spark, ledger).select("day").collect()}
    return [d for d in days if d not in have]

"""Landed snapshot files as a stream.

Streams use TIMESTAMP for event time because watermarks require it; run them
under session zone UTC so that it equals the wall clock of the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from dockwatch.schemas import REALTIME_JSON
from dockwatch.sources.files import split_realtime

LANDED = T.StructType(REALTIME_JSON.fields + [T.StructField("fetched_at", T.StringType())])


def landed_files(spark: SparkSession, root: str, files_per_trigger: int | None = None) -> DataFrame:
    """Realtime JSON records as they arrive.

    The fetch time is the record's ``fetched_at`` when it has one, otherwise
    the time in the file name (snap_yyyyMMddTHHmm).
    """
    reader = spark.readStream.schema(LANDED)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    named = F.regexp_replace(
        F.regexp_extract("_metadata.file_name", r"(\d{8}T\d{4})", 1),
        r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})$", "$1-$2-$3 $4:$5:00")
    return reader.json(root).withColumn("fetched_at", F.coalesce("fetched_at", named))


def typed(records: DataFrame, prefix: str = "", fixes: dict[str, str] | None = None,
          before: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(usable rows, rejected records).

    Rejected are records without a readable time, and those from ``before`` (a
    date) on, which the clock has not reached yet.
    """
    at = F.col("fetched_at").try_cast("timestamp_ntz")
    timed = at.isNotNull()
    if before is not None:
        timed = timed & (at < F.lit(before[:10]).cast("timestamp_ntz"))
    timed = F.coalesce(timed, F.lit(False))
    ok, bad = split_realtime(records.filter(timed), at, prefix, fixes)
    return ok, bad.unionByName(records.filter(~timed))


def slot_winners(rows: DataFrame, key: str = "name", delay: str = "30 minutes") -> DataFrame:
    """Newest reading per station and closed 30-minute slot (K2).

    A slot is emitted once the watermark has passed its end; readings that
    come later than ``delay`` are dropped and counted by the query (K4).
    """
    seen = rows.withColumn("seen_at", F.col("fetched_at").cast("timestamp")).withWatermark("seen_at", delay)
    fields = ("bikes", "docks_avail", "docks_total")
    won = seen.groupBy(F.window("seen_at", "30 minutes"), key).agg(
        *[F.max_by(x, "seen_at").alias(x) for x in fields], F.max("seen_at").alias("last_seen"))
    return won.select(key, F.col("window.start").cast("timestamp_ntz").alias("ts"), *fields,
                      F.col("last_seen").cast("timestamp_ntz").alias("fetched_at"))


def dropped_late(query: StreamingQuery) -> int:
    """Rows the watermark has shut out so far, from the kept progress reports."""
    return sum(op.numRowsDroppedByWatermark
               for p in query.recentProgress for op in p.stateOperators)

"""Pages: a station's readings of one calendar chunk, the unit that windows and joins share.

Facts lie in buckets of (station, chunk). What a reading needs from elsewhere comes to
its page, one row per station and chunk: attributes, and levels by position in arrays.
So facts meet everything else on (station, chunk), where they already are, and a station
with a third of all rows spreads over its chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dockwatch.functions import timefn as tf
from dockwatch.operators.frames import CHUNK_SLOTS

PAGE = ["station_id", "_chunk"]


def chunk_of(slot: Column) -> Column:
    return F.floor(slot / F.lit(CHUNK_SLOTS))


def with_chunk(rows: DataFrame) -> DataFrame:
    """Add ``_slot`` and the ``_chunk`` a reading belongs to."""
    return rows.withColumn("_slot", tf.slot_index(F.col("ts"))).withColumn("_chunk", chunk_of(F.col("_slot")))


def own(rows: DataFrame) -> DataFrame:
    """Rows of their own chunk, without the copies that frames.with_halo made."""
    return rows.filter(F.col("_chunk") == chunk_of(F.col("_slot")))


def pages_of(rows: DataFrame, dimension: DataFrame) -> DataFrame:
    """One row per page of ``rows`` with the station's attributes."""
    return rows.select(*PAGE).distinct().join(dimension, "station_id")


def dense(rows: DataFrame, keys: list[str], position: Column, size: int, value: Column, name: str) -> DataFrame:
    """One array per key with a value for each position 0..size-1, null where there is none."""
    filled = rows.select(*keys, position.cast("int").alias("_at"), value.alias("_v"))
    empty = rows.select(*keys).distinct().select(
        *keys, F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("_at")).withColumn(
            "_v", F.lit(None).cast(filled.schema["_v"].dataType))
    per = filled.unionByName(empty).groupBy(*keys, "_at").agg(F.max("_v").alias("_v"))
    return per.groupBy(*keys).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_at", "_v"))), lambda x: x["_v"]).alias(name))

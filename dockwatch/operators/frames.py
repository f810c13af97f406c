"""Time-offset windows over sparse series.

A lag of k slots on a complete grid is the value exactly k slots earlier, so a
RANGE frame on the running slot number gives the same answer on the observed
rows alone. No grid is built and nothing is joined to fill it.

Windows are cut into chunks of the calendar. Each row is copied to the
neighbouring chunks whose frames can reach it, so every frame is still whole,
while one station's history spreads over many tasks and no sort ever holds
more than ``chunk + back + ahead`` rows of a station.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

CHUNK_SLOTS = 28 * 48


def with_halo(df: DataFrame, slot: Column, back: int, ahead: int,
              chunk: int = CHUNK_SLOTS) -> DataFrame:
    """Add ``_slot`` and ``_chunk``; rows near an edge appear in both chunks."""
    first = F.floor((F.col("_slot") - F.lit(ahead)) / F.lit(chunk))
    last = F.floor((F.col("_slot") + F.lit(back)) / F.lit(chunk))
    return (df.withColumn("_slot", slot)
            .withColumn("_chunk", F.explode(F.sequence(first, last))))


def frame(keys: list[str], lo: int, hi: int) -> WindowSpec:
    """Slots lo..hi relative to the current one, for data from with_halo."""
    return (Window.partitionBy(*keys, "_chunk").orderBy("_slot").rangeBetween(lo, hi))


def own_rows(df: DataFrame, chunk: int = CHUNK_SLOTS) -> DataFrame:
    """Drop the copies again."""
    return df.filter(F.col("_chunk") == F.floor(F.col("_slot") / F.lit(chunk))).drop("_chunk", "_slot")

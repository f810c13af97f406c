"""The row before and after, without sorting a whole key in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from dockwatch.functions import timefn as tf
from dockwatch.operators.frames import CHUNK_SLOTS


def with_adjacent(df: DataFrame, key: str, flags: list[str], chunk: int = CHUNK_SLOTS) -> DataFrame:
    """Add <flag>_prev and <flag>_next: the flag on the key's neighbouring rows
    by ``ts``, False where there is none.

    Rows may be any distance apart, so a halo of fixed width would not do.
    Rows are compared inside calendar chunks; the first and last row of a
    chunk look at the ends of the nearest chunks that have rows. Those ends
    are one row per key and chunk, found by partial aggregation.
    """
    rows = df.withColumn("_chunk", F.floor(tf.slot_index(F.col("ts")) / F.lit(chunk)))
    ends = rows.groupBy(key, "_chunk").agg(
        *[F.min_by(x, "ts").alias(f"_first_{x}") for x in flags],
        *[F.max_by(x, "ts").alias(f"_last_{x}") for x in flags])
    chunks = Window.partitionBy(key).orderBy("_chunk")
    ends = ends.select(key, "_chunk",
                       *[F.lag(f"_last_{x}").over(chunks).alias(f"_before_{x}") for x in flags],
                       *[F.lead(f"_first_{x}").over(chunks).alias(f"_after_{x}") for x in flags])
    w = Window.partitionBy(key, "_chunk").orderBy("ts")
    inside = rows.withColumns({
        **{f"{x}_prev": F.lag(x).over(w) for x in flags},
        **{f"{x}_next": F.lead(x).over(w) for x in flags}})
    joined = inside.join(ends, [key, "_chunk"])
    no = F.lit(False)
    return joined.select(*df.columns, *[F.coalesce(f"{x}_prev", f"_before_{x}", no).alias(f"{x}_prev") for x in flags],
                         *[F.coalesce(f"{x}_next", f"_after_{x}", no).alias(f"{x}_next") for x in flags])

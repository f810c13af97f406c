"""Keep-latest selection without sorting (F1, F2, H6).

Everything is a hash aggregate with partial aggregation before the shuffle: a
key that owns a third of the input is reduced to one row per task first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dockwatch.functions import timefn as tf


def _rank_in_slot(order: str, payload: list[str]) -> Column:
    """Total order inside one slot as a single long.

    High bits: microseconds since the slot began (below 2^31 for 30 minutes).
    Low bits: a content hash, so equal times resolve the same way on every
    retry. A plain long keeps the aggregation buffer fixed-width, which is
    what lets Spark use its hash aggregate instead of a sort.
    """
    t = F.col(order)
    micros = (F.date_part(F.lit("SECOND"), t) * F.lit(1_000_000)).cast("long")
    offset = (F.minute(t) % F.lit(30)).cast("long") * F.lit(60_000_000) + micros
    tie = F.xxhash64(*[F.col(c) for c in payload]).bitwiseAND(F.lit(0x7FFFFFFF))
    return F.shiftleft(offset, 31) + tie


def last_per_slot(df: DataFrame, keys: list[str], order: str, payload: list[str]) -> DataFrame:
    """Newest row by ``order`` per key, where the keys fix a 30-minute slot."""
    rank = _rank_in_slot(order, payload)
    ranked = df.select(*keys, *payload, rank.alias("_rank"))
    return ranked.groupBy(*keys).agg(*[F.max_by(c, "_rank").alias(c) for c in payload])


def latest_rows(df: DataFrame, keys: list[str], order: str, payload: list[str]) -> DataFrame:
    """Newest row per key; ``order`` must be unique inside a key."""
    return df.groupBy(*keys).agg(
        F.max(order).alias(order), *[F.max_by(c, order).alias(c) for c in payload])


def latest_records(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest whole record per key, any column types, ties broken by ``order``.

    Reduces per task before the shuffle like the other two, but records with
    strings make the buffer variable-width, so prefer ``latest_rows`` where
    the payload is numeric.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.max_by(F.struct(*[F.col(c) for c in order + rest]),
                    F.struct(*[F.col(c) for c in order])).alias("_r")
    return (df.groupBy(*keys).agg(best)
            .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in order + rest])
            .select(*df.columns))

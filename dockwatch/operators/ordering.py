"""Global row numbers and running sums without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from dockwatch.session import stage


def numbered(df: DataFrame, order: list[Column], name: str = "row_number",
             running: dict[str, str] | None = None, partitions: int | None = None) -> DataFrame:
    """Rows numbered 1.. in a total order, plus running sums of given columns.

    Range partitioning puts the rows into ordered parts of similar size, each
    part is numbered on its own, and the totals of the parts before it are
    added. Only one total per part meets in one place, never the rows. The
    parts are staged because range bounds come from sampling: they must not
    move between the two passes.
    """
    spark = df.sparkSession
    running = running or {}
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = stage(df.repartitionByRange(n, *order)
                  .withColumn("_part", F.spark_partition_id()), "numbered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("_part").agg(
        F.count("*").alias("_n"), *[F.sum(c).alias(f"_t_{out}") for out, c in running.items()])
    offsets = totals.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        *[F.coalesce(F.sum(f"_t_{out}").over(before), F.lit(0)).alias(f"_b_{out}")
          for out in running])
    upto = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # One row per range part, so never more than ``partitions`` rows.
    out = parts.join(F.broadcast(offsets), "_part")
    out = out.withColumn(name, (F.row_number().over(Window.partitionBy("_part").orderBy(*order))
                                + F.col("_before")).cast("long"))
    for o, c in running.items():
        out = out.withColumn(o, F.sum(c).over(upto) + F.col(f"_b_{o}"))
    return out.drop("_part", "_before", *[f"_b_{o}" for o in running])


def running_by_key(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, str],
                   totals: dict[str, str] | None = None, partitions: int | None = None) -> DataFrame:
    """Running sums inside each key, and whole sums of it (``totals``): a segmented prefix scan.

    Rows are range-partitioned by key and order, so a key lies in consecutive parts and a
    hot key in many. Each (part, key) is summed; what a key has in the parts before, and
    in all parts, is added to one running sum per (part, key). ``keys`` stand for a short
    list of groups: parts plus keys rows are broadcast, never more. ``order`` must be total
    inside a key. The parts are staged because range bounds come from sampling.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = stage(df.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()), "running")
    totals = totals or {}
    per = parts.groupBy("_part", *keys).agg(
        *[F.sum(c).alias(f"_s_{o}") for o, c in sums.items()], *[F.sum(c).alias(f"_t_{o}") for o, c in totals.items()])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        "_part", *keys, *[F.coalesce(F.sum(f"_s_{o}").over(earlier), F.lit(0)).alias(f"_b_{o}") for o in sums],
        *[F.sum(f"_t_{o}").over(Window.partitionBy(*keys)).alias(o) for o in totals])
    # Keys may be null, so the join compares them null-safely.
    on = [parts["_part"] == per["_part"], *[parts[k].eqNullSafe(per[k]) for k in keys]]
    both = parts.join(F.broadcast(per), on).select(
        parts["*"], *[per[f"_b_{o}"] for o in sums], *[per[o] for o in totals])
    upto = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumns({o: F.sum(c).over(upto) + F.col(f"_b_{o}") for o, c in sums.items()})
    return out.drop("_part", *[f"_b_{o}" for o in sums])


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int,
                  name: str = "rank") -> DataFrame:
    """The k first rows of each group.

    Spark turns the filtered row_number into a per-task group limit ahead of
    the shuffle, so a hot group sends at most k rows from each task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)

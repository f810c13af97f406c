"""Dispatch policies under limited capacity, and where shortage concentrates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dockwatch.functions.cols import c
from dockwatch.functions import status as st, timefn as tf
from dockwatch.operators.ordering import numbered, top_per_group
from dockwatch.plans.evaluate import event_starts
from dockwatch.schemas import (COVER_SLOTS, MODEL_EMPTY_MAX, POLICY_CAPACITIES, SLOT_MINUTES)

PREVENT_LEAD, RULE_LEAD = 2, 1     # slots until the bikes arrive


def ranked_picks(rows: DataFrame, capacity: int = max(POLICY_CAPACITIES)) -> DataFrame:
    """Up to ``capacity`` stations per slot and queue, best first.

    'prevent' takes stations that are not empty yet by predicted risk, 'rule'
    those already empty by how long they have been; equal scores go to the
    smaller station id.
    """
    queue = F.when(c.model_empty, "rule").otherwise("prevent")
    score = F.when(c.model_empty, F.col("empty_streak").cast("double")).otherwise(F.col("proba"))
    pool = rows.select("station_id", "ts", queue.alias("queue"), score.alias("score"))
    return top_per_group(pool, ["ts", "queue"], [F.desc("score"), F.asc("station_id")], capacity)


def covered_slots(picks: DataFrame) -> DataFrame:
    """Slots each pick keeps supplied, with the best rank per queue (H5).

    Keeping the smallest rank answers every capacity at once: a slot is
    covered at capacity k if some pick of rank <= k covers it.
    """
    lead = F.when(F.col("queue") == "prevent", PREVENT_LEAD).otherwise(RULE_LEAD)
    slots = F.explode(F.sequence(lead, lead + COVER_SLOTS - 1))
    at = picks.withColumn("_k", slots).withColumn(
        "ts", tf.plus_minutes(F.col("ts"), F.col("_k") * SLOT_MINUTES))
    return at.groupBy("station_id", "ts").agg(
        *[F.min(F.when(F.col("queue") == q, F.col("rank"))).alias(f"{q}_rank")
          for q in ("prevent", "rule")])


def policy_coverage(rows: DataFrame, capacities: tuple[int, ...] = POLICY_CAPACITIES) -> DataFrame:
    """Empty station-slots each policy would have avoided, per capacity."""
    reach = covered_slots(ranked_picks(rows, max(capacities)))
    empty = rows.filter(c.model_empty).select("station_id", "ts").join(reach, ["station_id", "ts"], "left")
    pr, rr = F.col("prevent_rank"), F.col("rule_rank")

    def row(k: int) -> Column:
        half = max(k // 2, 1)
        return F.struct(
            F.lit(k).alias("capacity"),
            F.count_if(pr <= k).alias("prevent_slots"), F.count_if(rr <= k).alias("rule_slots"),
            F.count_if((pr <= half) | (rr <= half)).alias("hybrid_slots"))
    one = empty.agg(F.count("*").alias("empty_slots"),
                    F.array(*[row(k) for k in capacities]).alias("per"))
    long = one.select("empty_slots", F.explode("per").alias("p")).select("empty_slots", "p.*")
    pct = {f"{p}_pct": st.steady_round(F.lit(100.0) * F.col(f"{p}_slots") /
                               F.nullif(F.col("empty_slots"), F.lit(0)), 2)
           for p in ("prevent", "rule", "hybrid")}
    return long.withColumns(pct).withColumns({
        "dispatches_per_day": F.col("capacity") * (1440 // SLOT_MINUTES),
        "prevent_station_hours": st.steady_round(F.col("prevent_slots") * (SLOT_MINUTES / 60), 1),
        "hybrid_station_hours": st.steady_round(F.col("hybrid_slots") * (SLOT_MINUTES / 60), 1),
        "uplift_vs_rule": st.steady_round(F.lit(100.0) * (F.col("hybrid_slots") - F.col("rule_slots")) /
                                  F.nullif(F.col("empty_slots"), F.lit(0)), 2)})


def events_preventable(rows: DataFrame, capacities: tuple[int, ...] = POLICY_CAPACITIES) -> DataFrame:
    """Empty events whose station was among the first k an hour before."""
    events = event_starts(rows.withColumn("docks_total", F.lit(0)), "empty")
    ranks = ranked_picks(rows, max(capacities)).filter(F.col("queue") == "prevent").select(
        "station_id", tf.plus_minutes(F.col("ts"), PREVENT_LEAD * SLOT_MINUTES).alias("ts"), "rank")
    x = events.join(ranks, ["station_id", "ts"], "left")

    def row(k: int) -> Column:
        half = max(k // 2, 1)
        return F.struct(F.lit(k).alias("capacity"),
                        F.count_if(F.col("rank") <= k).alias("prevented"),
                        F.count_if(F.col("rank") <= half).alias("prevented_hybrid"))
    one = x.agg(F.count("*").alias("n_events"), F.array(*[row(k) for k in capacities]).alias("per"))
    long = one.select("n_events", F.explode("per").alias("p")).select("n_events", "p.*")
    n = F.greatest(F.col("n_events"), F.lit(1))
    return long.withColumns({
        f"{x}_pct": st.steady_round(F.lit(100.0) * F.col(x) / n, 2) for x in ("prevented", "prevented_hybrid")})


def concentration(rows: DataFrame, share: float = 0.05) -> DataFrame:
    """Part of all empty time held by the top 5 % of stations."""
    per = rows.groupBy("station_id").agg(F.count_if(c.model_empty).alias("n_empty"), F.count("*").alias("n"))
    ranked = numbered(per, [F.desc("n_empty"), F.asc("station_id")], "place")
    size = ranked.agg(F.greatest(F.floor(F.count("*") * F.lit(share)), F.lit(1))).scalar()
    r = ranked.withColumn("top_n", size)
    top = F.col("place") <= F.col("top_n")
    return r.agg(
        F.max("top_n").alias("top_stations"),
        st.steady_round(F.sum(F.when(top, F.col("n_empty"))) / F.nullif(F.sum("n_empty"), F.lit(0)), 4)
        .alias("top_share"),
        F.count_if(F.col("n_empty") / F.col("n") > 0.5).alias("mostly_empty_stations"),
        F.sum("n_empty").alias("empty_slots"))

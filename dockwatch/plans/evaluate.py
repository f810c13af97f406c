"""Forecast quality: pointwise, per threshold, per event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dockwatch.functions import status as st, timefn as tf
from dockwatch.operators.adjacent import with_adjacent
from dockwatch.operators.ordering import running_by_key
from dockwatch.schemas import (HORIZONS, MODEL_EMPTY_MAX, MODEL_FULL_MAX, STRICT_THRESHOLD)
from dockwatch.session import stage

THRESHOLDS = [round(0.05 * i, 2) for i in range(1, 20)]


def truth(kind: str) -> Column:
    """Did the event hold at the target time (long rows of features.by_horizon)."""
    return (F.col("y_bikes") <= MODEL_EMPTY_MAX if kind == "empty"
            else F.col("y_docks") <= MODEL_FULL_MAX)


def level_errors(pred: str, cap: str = "docks_total") -> list[Column]:
    """MAE and RMSE of the ratio, MAE in bikes; NULL predictions are left out."""
    y, p = F.col("y_ratio"), F.col(pred)
    e, c = y - p, F.col(cap)
    return [F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae_ratio"),
            F.sqrt(F.avg(e * e)).alias("rmse_ratio"), F.avg(F.abs(e) * c).alias("mae_bikes")]


def confusion(hit: Column, fact: Column) -> list[Column]:
    return [F.count_if(fact & hit).alias("tp"), F.count_if(~fact & hit).alias("fp"),
            F.count_if(fact & ~hit).alias("fn")]


def with_prf(counts: DataFrame) -> DataFrame:
    """precision, recall and F1 of tp / fp / fn, 0 where undefined."""
    def part(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = counts.withColumns({"precision": part(tp, tp + fp), "recall": part(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", part(2 * p * r, p + r))


def long_baselines(rows: DataFrame) -> DataFrame:
    """One row per reading, horizon and baseline (M14); unknown predictions dropped."""
    both = F.explode(F.array(
        F.struct(F.lit("persistence").alias("model"), F.col("ratio").alias("pred")),
        F.struct(F.lit("lastweek").alias("model"), F.col("lastweek").alias("pred")))).alias("b")
    return rows.select("*", both).select("*", "b.*").drop("b").filter(F.col("pred").isNotNull())


def implied_event(kind: str, ratio: Column, cap: Column) -> Column:
    """The event a level forecast stands for."""
    return (ratio * cap <= MODEL_EMPTY_MAX if kind == "empty"
            else (F.lit(1.0) - ratio) * cap <= MODEL_FULL_MAX)


def baseline_metrics(rows: DataFrame) -> DataFrame:
    """Errors of both baselines per horizon, and the last one's gap to the first."""
    return long_baselines(rows).groupBy("horizon", "model").agg(*level_errors("pred"))


def baseline_events(rows: DataFrame) -> DataFrame:
    """Precision and recall of the events the baselines imply."""
    kinds = F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), truth(k).alias("fact"),
                 implied_event(k, F.col("pred"), F.col("docks_total")).alias("hit"))
        for k in ("empty", "full")])).alias("k")
    rows = long_baselines(rows).select("horizon", "model", kinds).select("horizon", "model", "k.*")
    return with_prf(rows.groupBy("horizon", "model", "kind")
                    .agg(*confusion(F.col("hit"), F.col("fact"))))


def improvement(metrics: DataFrame, model: str, base: str) -> DataFrame:
    """How much smaller the MAE in bikes is than a baseline's, in percent."""
    def of(m: str) -> Column:
        return F.max(F.when(F.col("model") == m, F.col("mae_bikes")))
    return metrics.groupBy("horizon").agg(
        (F.lit(100.0) * (of(base) - of(model)) / of(base)).alias("improve_pct"))


def scored(rows: DataFrame) -> DataFrame:
    """One row per reading, horizon and kind with its probability and the fact."""
    per = F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(f"proba_{k}").alias("proba"), truth(k).alias("fact"))
        for k in ("empty", "full")])).alias("k")
    return rows.select("horizon", per).select("horizon", "k.*")


def threshold_table(score_rows: DataFrame) -> DataFrame:
    """tp / fp / fn for every threshold on the 0.05 raster.

    Rows are first reduced to one per raster step; the 19 thresholds are then
    sums over at most 20 steps, so no row is ever multiplied by 19.
    """
    step = F.lit(0)
    for t in THRESHOLDS:
        step = step + (F.col("proba") >= t).cast("int")
    steps = score_rows.groupBy("horizon", "kind", step.alias("step")).agg(
        F.count_if("fact").alias("pos"), F.count_if(~F.col("fact")).alias("neg"))

    def fired(x: str, i: int) -> Column:
        return F.sum(F.when(F.col("step") >= i, F.col(x)).otherwise(0))
    per = F.array(*[F.struct(F.lit(t).alias("threshold"), fired("pos", i).alias("tp"),
                             fired("neg", i).alias("fp"),
                             (F.sum("pos") - fired("pos", i)).alias("fn"))
                    for i, t in enumerate(THRESHOLDS, 1)])
    return (steps.groupBy("horizon", "kind").agg(per.alias("per"))
            .select("horizon", "kind", F.explode("per").alias("p")).select("horizon", "kind", "p.*"))


def best_threshold(score_rows: DataFrame) -> DataFrame:
    """Threshold with the highest F1, the lowest one among equals."""
    t = with_prf(threshold_table(score_rows))
    best = F.max_by(F.struct("threshold", "precision", "recall", "f1", "tp", "fp", "fn"),
                    F.struct(F.col("f1"), -F.col("threshold"))).alias("b")
    return t.groupBy("horizon", "kind").agg(best).select("horizon", "kind", "b.*")


def ranking_quality(score_rows: DataFrame) -> DataFrame:
    """Step-wise average precision and ROC area per horizon and kind.

    Equal scores are merged before any ordering; the ordering itself is a segmented
    prefix scan, as there may be as many scores as rows.
    """
    keys = ["horizon", "kind"]
    merged = stage(score_rows.groupBy(*keys, "proba").agg(
        F.count_if("fact").alias("pos"), F.count_if(~F.col("fact")).alias("neg")), "scores")
    r = running_by_key(merged, keys, [F.desc("proba")], {"tp": "pos", "fp": "neg"}, {"p_all": "pos", "n_all": "neg"})
    ap = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / F.lit(2.0)))
    return r.groupBy(*keys).agg(
        F.max("p_all").alias("n_pos"), F.max("n_all").alias("n_neg"),
        (ap / F.nullif(F.max("p_all"), F.lit(0))).alias("average_precision"),
        (area / F.nullif(F.max("p_all") * F.max("n_all"), F.lit(0))).alias("roc_auc"))


def interval_report(rows: DataFrame) -> DataFrame:
    """How often and how widely a band holds the truth (M13); needs lo, hi in ratio."""
    y = F.col("y_ratio")
    lo, hi = F.least("lo", "hi"), F.greatest("lo", "hi")
    return rows.groupBy("horizon").agg(
        F.avg((y.between(lo, hi)).cast("double")).alias("coverage"),
        F.avg((hi - lo) * F.col("docks_total")).alias("mean_width_bikes"),
        F.avg((F.col("lo") > F.col("hi")).cast("double")).alias("crossed_rate"),
        F.lit(0.8).alias("target_coverage"))


# --------------------------------------------------------------------- events

def _states() -> dict[str, Column]:
    return {"empty": F.col("bikes") <= MODEL_EMPTY_MAX,
            "full": F.col("docks_total") - F.col("bikes") <= MODEL_FULL_MAX}


def _starts(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """A start is in the state with the next row, while the row before is not.

    Neighbouring means the next row present, not the next half-hour (F14).
    """
    states = _states()
    x = with_adjacent(rows.select("station_id", "ts", *[states[k].alias(k) for k in kinds]),
                      "station_id", kinds)
    started = {k: F.col(k) & ~F.col(f"{k}_prev") & F.col(f"{k}_next") for k in kinds}
    names = F.array(*[F.when(started[k], F.lit(k)) for k in kinds])
    return x.select("station_id", "ts", F.explode(F.array_compact(names)).alias("kind"))


def event_starts(rows: DataFrame, kind: str) -> DataFrame:
    """First row of each stay in the state that lasts at least two rows."""
    return _starts(rows, [kind])


def both_event_starts(rows: DataFrame) -> DataFrame:
    """Starts of both kinds from one pass over the rows."""
    return _starts(rows, ["empty", "full"])


def threshold_column(thresholds: float | dict[tuple[str, int], float]) -> Column:
    """One threshold for all, or one per (kind, horizon)."""
    if not isinstance(thresholds, dict):
        return F.lit(float(thresholds))
    out = F.when(F.lit(False), F.lit(0.0))
    for (kind, h), t in sorted(thresholds.items()):
        out = out.when((F.col("kind") == kind) & (F.col("horizon") == h), F.lit(float(t)))
    return out.otherwise(F.lit(STRICT_THRESHOLD))


def event_leads(events: DataFrame, probabilities: DataFrame,
                thresholds: float | dict = STRICT_THRESHOLD) -> DataFrame:
    """Earliest warning per event in minutes, 0 when none came.

    ``probabilities``: station_id, ts, horizon, kind, proba. Each forecast is
    moved forward to the moment it speaks of and joined there once, for all
    horizons together.
    """
    fired = (probabilities.filter(F.col("proba") >= threshold_column(thresholds))
             .select("station_id", "kind", "horizon",
                     tf.plus_minutes(F.col("ts"), F.col("horizon")).alias("ts"))
             .groupBy("station_id", "kind", "ts").agg(F.max("horizon").alias("lead")))
    return events.join(fired, ["station_id", "kind", "ts"], "left").withColumn(
        "lead", F.coalesce("lead", F.lit(0)))


def event_report(leads: DataFrame, score_rows: DataFrame, n_stations: Column | int, n_days: Column | int,
                 thresholds: float | dict = STRICT_THRESHOLD) -> DataFrame:
    """Coverage, lead times and false alarms per kind."""
    hit = F.col("lead") > 0
    lead = F.when(hit, F.col("lead"))
    per_event = leads.groupBy("kind").agg(
        F.count("*").alias("n_events"), F.count_if(hit).alias("detected"),
        st.share(hit).alias("coverage"),
        F.coalesce(F.avg(lead), F.lit(0.0)).alias("mean_lead_minutes"),
        F.coalesce(F.percentile(lead, F.lit(0.5)), F.lit(0.0)).alias("median_lead_minutes"),
        F.avg("lead").alias("mean_lead_minutes_all_events"),
        *[F.count_if(F.col("lead") == h).alias(f"lead_{h}") for h in HORIZONS],
        F.count_if(~hit).alias("missed"))
    fired = F.col("proba") >= threshold_column(thresholds)
    n_st = F.lit(n_stations) if isinstance(n_stations, int) else n_stations
    per_alert = score_rows.groupBy("kind").agg(
        F.count_if(fired).alias("alerts_fired"),
        F.count_if(fired & ~F.col("fact")).alias("false_alarms"))
    per_alert = per_alert.withColumns({
        "false_alarm_rate": F.when(F.col("alerts_fired") > 0,
                                   F.col("false_alarms") / F.col("alerts_fired")).otherwise(0.0),
        "alerts_per_station_per_day": F.col("alerts_fired") / F.greatest(n_st * n_days, F.lit(1))})
    return per_event.join(per_alert, "kind")

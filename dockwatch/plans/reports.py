"""Report tables and documents.

A report is a long metric table (section, model, kind, horizon, metric,
value); the JSON document is made from it. Both have a few hundred rows at
most, whatever the size of the data behind them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dockwatch.functions.cols import c
from dockwatch.plans import evaluate as ev
from dockwatch.schemas import HORIZONS, STRICT_THRESHOLD
from dockwatch.session import stage
from dockwatch.sinks.tables import read_published

LONG = "section string, model string, kind string, horizon int, metric string, value double"
KEYS = ("model", "kind", "horizon")


def long_metrics(df: DataFrame, section: str) -> DataFrame:
    """Every column of df that is no key as one (metric, value) row."""
    metrics = [x for x in df.columns if x not in KEYS]
    keys = [F.col(k).cast("int" if k == "horizon" else "string").alias(k) if k in df.columns
            else F.lit(None).cast("int" if k == "horizon" else "string").alias(k) for k in KEYS]
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                                for m in metrics])).alias("m")
    return df.select(F.lit(section).alias("section"), *keys, cells).select(
        "section", *KEYS, "m.metric", "m.value")


def level_section(judged: DataFrame) -> DataFrame:
    """Errors of the model and both baselines, and the model's gain over each."""
    preds = F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(x).alias("pred"))
        for m, x in (("model", "pred_ratio"), ("persistence", "ratio"), ("lastweek", "lastweek"))])).alias("p")
    errors = (judged.select("horizon", "y_ratio", "docks_total", preds)
              .select("horizon", "y_ratio", "docks_total", "p.*").filter(F.col("pred").isNotNull())
              .groupBy("horizon", "model").agg(*ev.level_errors("pred")))
    errors = stage(errors, "errors")
    out = long_metrics(errors, "level")
    for base in ("persistence", "lastweek"):
        gain = ev.improvement(errors, "model", base).withColumnRenamed("improve_pct", f"improve_vs_{base}_pct")
        out = out.unionByName(long_metrics(gain.withColumn("model", F.lit("model")), "level"))
    return out


def event_class_section(judged: DataFrame, thresholds: dict[tuple[str, int], float]) -> DataFrame:
    """Ranking quality and precision / recall at both thresholds and of the rule."""
    score = ev.scored(judged)
    out = long_metrics(ev.ranking_quality(score), "ranking")
    rate = score.groupBy("horizon", "kind").agg(F.avg(F.col("fact").cast("double")).alias("pos_rate"))
    out = out.unionByName(long_metrics(rate, "ranking"))
    for section, t in (("strict", STRICT_THRESHOLD), ("operational", thresholds)):
        hits = score.groupBy("horizon", "kind").agg(
            *ev.confusion(F.col("proba") >= ev.threshold_column(t), F.col("fact")))
        out = out.unionByName(long_metrics(ev.with_prf(hits), section))
    rule = F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), ev.truth(k).alias("fact"),
                 ev.implied_event(k, c.ratio, c.total).alias("hit")) for k in ("empty", "full")])).alias("r")
    ruled = judged.select("horizon", rule).select("horizon", "r.*").groupBy("horizon", "kind").agg(
        *ev.confusion(F.col("hit"), F.col("fact")))
    return out.unionByName(long_metrics(ev.with_prf(ruled), "rule"))


def early_warning_section(judged: DataFrame, n_days: Column | int,
                          thresholds: dict[tuple[str, int], float]) -> DataFrame:
    """Event-level coverage, lead and false alarms at both thresholds."""
    per = F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(f"proba_{k}").alias("proba"), ev.truth(k).alias("fact"))
        for k in ("empty", "full")])).alias("k")
    probs = judged.select("station_id", "ts", "horizon", per).select("station_id", "ts", "horizon", "k.*")
    rows = judged.filter(F.col("horizon") == HORIZONS[0]).select("station_id", "ts", "bikes", "docks_total")
    events = stage(ev.both_event_starts(rows), "events")
    n = rows.agg(F.countDistinct("station_id")).scalar()
    out = None
    for section, t in (("events_strict", STRICT_THRESHOLD), ("events_operational", thresholds)):
        part = long_metrics(ev.event_report(ev.event_leads(events, probs, t), probs, n, n_days, t), section)
        out = part if out is None else out.unionByName(part)
    return out


def backtest_metrics(judged: DataFrame, n_days: Column | int, thresholds: dict[tuple[str, int], float]) -> DataFrame:
    """The whole backtest as one metric table.

    ``judged``: station_id, ts, horizon, ratio, bikes, docks_total, lastweek,
    pred_ratio, proba_*, y_*; read by several sections, so stage it.
    """
    return (level_section(judged).unionByName(event_class_section(judged, thresholds))
            .unionByName(early_warning_section(judged, n_days, thresholds)))


def document(metrics: DataFrame, **facts: str | int | float) -> DataFrame:
    """One row: the metric table nested by section, with facts about the run."""
    row = F.struct("model", "kind", "horizon", "metric", "value")
    per = metrics.groupBy("section").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    nested = per.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("section", "rows")))).alias("sections"))
    return nested.select(*[F.lit(v).alias(k) for k, v in facts.items()], "sections")


def headline(metrics: DataFrame) -> DataFrame:
    """The handful of numbers a front page shows."""
    def pick(section: str, metric: str, kind: str | None = None, model: str | None = None,
             horizon: int | None = None):
        cond = (F.col("section") == section) & (F.col("metric") == metric)
        for name, v in (("kind", kind), ("model", model), ("horizon", horizon)):
            if v is not None:
                cond = cond & (F.col(name) == v)
        return F.max(F.when(cond, F.col("value")))
    op, strict = "events_operational", "events_strict"
    return metrics.agg(
        F.round(pick("level", "mae_bikes", model="model", horizon=60), 3).alias("mae_bikes_60min"),
        F.round(pick("level", "mae_bikes", model="persistence", horizon=60), 3).alias("mae_bikes_60min_persistence"),
        F.round(pick("level", "improve_vs_persistence_pct", horizon=60), 1).alias("improve_vs_persistence_pct_60min"),
        F.round(pick(op, "coverage", "empty"), 4).alias("empty_event_coverage"),
        F.round(pick(op, "mean_lead_minutes", "empty"), 1).alias("empty_event_mean_lead_minutes"),
        F.round(pick(op, "false_alarm_rate", "empty"), 4).alias("empty_event_false_alarm_rate"),
        F.round(pick("operational", "f1", "empty", horizon=60), 3).alias("empty_f1_60min"),
        F.round(pick(op, "coverage", "full"), 4).alias("full_event_coverage"),
        F.round(pick(op, "mean_lead_minutes", "full"), 1).alias("full_event_mean_lead_minutes"),
        pick(op, "n_events", "empty").cast("long").alias("n_empty_events"),
        pick(op, "n_events", "full").cast("long").alias("n_full_events"),
        F.round(pick(strict, "coverage", "empty"), 4).alias("strict_empty_event_coverage"),
        F.round(pick(strict, "false_alarm_rate", "empty"), 4).alias("strict_empty_event_false_alarm_rate"))


def stored_report(spark: SparkSession, root: str, bands_root: str | None = None) -> DataFrame:
    """The newest published metrics, with the band section when one exists."""
    out = read_published(spark, root, LONG)
    if bands_root is not None:
        out = out.unionByName(read_published(spark, bands_root, LONG))
    return out

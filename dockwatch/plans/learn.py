"""Training, scoring and prediction bands with pyspark.ml.

Boosted trees per horizon: one for the level, one each for empty and full.
MLlib trees have no quantile objective, so the band comes from the residuals
of held-out rows, per horizon and fill of the station (split conformal regression).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dockwatch.functions import status as st
from dockwatch.plans import evaluate as ev
from dockwatch.schemas import (CATEGORICAL, FEATURES, HORIZONS, MODEL_EMPTY_MAX, MODEL_FULL_MAX,
                               SEED, STRICT_THRESHOLD)
from dockwatch.session import stage

KINDS = ("empty", "full")
MISSING = -1.0


@dataclass
class Settings:
    rounds: int = 60
    depth: int = 6
    step: float = 0.1
    subsample: float = 0.8
    feature_share: str = "0.85"
    min_rows: int = 200
    max_bins: int = 64          # at least the largest category domain
    train_share: float = 1.0    # below 1 the trees fit a sample; thresholds and bands never do
    seed: int = SEED


@dataclass
class Models:
    """Fitted pipelines and what scoring needs besides them."""
    levels: dict[int, PipelineModel] = field(default_factory=dict)
    events: dict[tuple[str, int], PipelineModel] = field(default_factory=dict)
    thresholds: dict[tuple[str, int], float] = field(default_factory=dict)
    bands: DataFrame | None = None      # (horizon, grp, n, lo_shift, hi_shift)


def hash_sample(df: DataFrame, share: float, seed: int = SEED) -> DataFrame:
    """A share of the readings chosen by a hash of their key.

    The same rows are chosen on every retry and under any partitioning.
    """
    if share >= 1.0:
        return df
    bucket = F.pmod(F.xxhash64(F.lit(seed), "station_id", "ts"), F.lit(1_000_000))
    return df.filter(bucket < F.lit(int(share * 1_000_000)))


def model_frame(features: DataFrame) -> DataFrame:
    """Model inputs as floats; unknown numbers get a value no real one has.

    Category codes keep their numbers: their domains are fixed, nothing is fitted to the
    values that happen to be present. A code outside its domain, or none, is the one code
    after the last, so trees can be asked about it. The columns carry the domains, which
    makes the trees split them by sets of codes and not by order.
    """
    out = features.withColumns({
        x: F.coalesce(F.col(x).cast("float"), F.lit(MISSING).cast("float")) for x in FEATURES if x not in CATEGORICAL})
    codes = {x: F.when((F.col(x) >= 0) & (F.col(x) < n), F.col(x)).otherwise(F.lit(n)).cast("float")
             for x, n in CATEGORICAL.items()}
    return out.withColumns(codes)


def _with_domains(rows: DataFrame) -> DataFrame:
    """The same columns with the attributes that the assembler passes on to the trees."""
    return rows.select(*[
        F.col(x).alias(x, metadata={"ml_attr": {"type": "nominal", "name": x, "vals": [str(i) for i in range(n + 1)]}})
        if (n := CATEGORICAL.get(x)) else F.col(x) for x in rows.columns])


def _assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=FEATURES, outputCol="inputs")


def _fit(rows: DataFrame, valid: DataFrame, label: Column, estimator) -> PipelineModel:
    """Boost on the training rows, stop early on the validation rows (M9)."""
    a = rows.select(*FEATURES, label.alias("label"), F.lit(False).alias("held_out"))
    b = valid.select(*FEATURES, label.alias("label"), F.lit(True).alias("held_out"))
    est = estimator.setFeaturesCol("inputs").setLabelCol("label").setValidationIndicatorCol("held_out")
    return Pipeline(stages=[_assembler(), est]).fit(_with_domains(a.unionByName(b)))


def _tree(cls, s: Settings, **more):
    return cls(maxIter=s.rounds, maxDepth=s.depth, stepSize=s.step, subsamplingRate=s.subsample,
               featureSubsetStrategy=s.feature_share, minInstancesPerNode=s.min_rows,
               maxBins=s.max_bins, seed=s.seed, **more)


def train(train_rows: DataFrame, valid_rows: DataFrame, s: Settings | None = None) -> Models:
    """Four level models and eight event models, thresholds and bands.

    One half of the validation rows stops the boosting and chooses thresholds, the other,
    which no choice has seen, sets the bands.
    """
    s = s or Settings()
    tr = stage(model_frame(hash_sample(train_rows, s.train_share, s.seed)), "train_rows")
    half = F.pmod(F.xxhash64(F.lit(s.seed), F.lit("bands"), "station_id", "ts"), F.lit(2))
    va = stage(model_frame(valid_rows.filter(half == 0)), "valid_rows")
    own = model_frame(valid_rows.filter(half == 1))
    m = Models()
    for h in HORIZONS:
        m.levels[h] = _fit(tr, va, F.col(f"y_ratio_{h}"),
                           _tree(GBTRegressor, s, lossType="absolute"))
        for kind, col, top in (("empty", f"y_bikes_{h}", MODEL_EMPTY_MAX),
                               ("full", f"y_docks_{h}", MODEL_FULL_MAX)):
            m.events[kind, h] = _fit(tr, va, (F.col(col) <= top).cast("double"),
                                     _tree(GBTClassifier, s))
    judged = stage(judge(m, va), "judged")
    best = ev.best_threshold(scored_rows(judged)).select("horizon", "kind", "threshold").collect()
    m.thresholds = {(r["kind"], r["horizon"]): r["threshold"] for r in best}   # at most 8 rows
    m.bands = stage(conformal_bands(residual_counts(judge(m, own))), "bands")
    return m


def _raw_scores(m: Models, rows: DataFrame) -> DataFrame:
    """All twelve model outputs as columns of one pass over the rows."""
    out = _assembler().transform(rows)
    for h in HORIZONS:
        level = m.levels[h].stages[-1].setPredictionCol(f"level_{h}")
        out = level.transform(out).withColumn(f"level_{h}", st.clip01(F.col(f"level_{h}")))
        for kind in KINDS:
            model = m.events[kind, h].stages[-1]
            model.setPredictionCol("_p").setRawPredictionCol("_raw").setProbabilityCol("_prob")
            out = (model.transform(out)
                   .withColumn(f"proba_{kind}_{h}", vector_to_array("_prob")[1])
                   .drop("_p", "_raw", "_prob"))
    return out.drop("inputs")


def judge(m: Models, rows: DataFrame) -> DataFrame:
    """Predictions next to the truth, one row per reading and horizon."""
    per = F.explode(F.array(*[F.struct(
        F.lit(h).alias("horizon"), F.col(f"level_{h}").alias("pred_ratio"),
        F.col(f"proba_empty_{h}").alias("proba_empty"), F.col(f"proba_full_{h}").alias("proba_full"),
        F.col(f"y_ratio_{h}").alias("y_ratio"), F.col(f"y_bikes_{h}").alias("y_bikes"),
        F.col(f"y_docks_{h}").alias("y_docks"), F.col(f"bl_lastweek_{h}").alias("lastweek"))
        for h in HORIZONS])).alias("t")
    return _raw_scores(m, rows).select("station_id", "ts", "ratio", "bikes", "docks_total", per).select(
        "station_id", "ts", "ratio", "bikes", "docks_total", "t.*")


def scored_rows(judged: DataFrame) -> DataFrame:
    return ev.scored(judged)


#: Steps of a residual histogram for one unit of the ratio.
STEPS = 10_000
#: A group with fewer held-out rows takes the band of its horizon.
MIN_BAND_ROWS = 200


def band_group(ratio: Column) -> Column:
    """0 nearly empty, 1 between, 2 nearly full: errors are lopsided at both ends."""
    return F.when(ratio < 1 / 3, 0).when(ratio < 2 / 3, 1).otherwise(2)


def residual_counts(judged: DataFrame) -> DataFrame:
    """Histograms of the residuals: horizon, grp, step, n.

    Counts of several days or runs can be added up, and are a few thousand rows however
    many residuals they stand for.
    """
    step = F.floor((F.col("y_ratio") - F.col("pred_ratio")) * F.lit(float(STEPS)) + F.lit(0.5)).cast("int")
    return judged.groupBy("horizon", band_group(F.col("ratio")).alias("grp"), step.alias("step")).agg(
        F.count("*").alias("n"))


def conformal_bands(counts: DataFrame, lo: float = 0.1, hi: float = 0.9, least: int = MIN_BAND_ROWS) -> DataFrame:
    """Residual quantiles per horizon and group, from histograms (M12): horizon, grp, n, lo_shift, hi_shift."""
    q = F.percentile(F.col("step"), F.array(F.lit(lo), F.lit(hi)), F.col("n"))
    # At most a few thousand steps per group; a horizon has three groups.
    per = counts.groupBy("horizon", "grp").agg(q.alias("q"), F.sum("n").alias("n"))
    whole = counts.groupBy("horizon").agg(q.alias("qw"))
    use = F.when(F.col("n") >= least, F.col("q")).otherwise(F.col("qw"))
    groups = whole.withColumn("grp", F.explode(F.array(*[F.lit(g) for g in range(3)])))
    out = groups.join(per, ["horizon", "grp"], "left").withColumn("_u", use)
    return out.select("horizon", "grp", F.coalesce("n", F.lit(0)).alias("n"),
                      (F.col("_u")[0] / F.lit(float(STEPS))).alias("lo_shift"),
                      (F.col("_u")[1] / F.lit(float(STEPS))).alias("hi_shift"))


def with_band(rows: DataFrame, bands: DataFrame) -> DataFrame:
    """lo and hi in ratio, clipped, in order and holding the point (M12); rows have ratio and pred_ratio."""
    p = F.col("pred_ratio")
    a, b = st.clip01(p + F.col("lo_shift")), st.clip01(p + F.col("hi_shift"))
    rows = rows.withColumn("grp", band_group(F.col("ratio")))
    return (rows.join(F.broadcast(bands.drop("n")), ["horizon", "grp"])        # three rows per horizon
            .withColumns({"lo": F.least(a, b, p), "hi": F.greatest(a, b, p)})
            .drop("lo_shift", "hi_shift", "grp"))


def forecast_table(m: Models, live: DataFrame) -> DataFrame:
    """Forecast rows for the readings of one slot.

    ``live`` has the features plus name, district, docks_avail and is_live.
    """
    keep = live.select("station_id", "ts", "name", "district", "is_live",
                       F.col("bikes").cast("int").alias("now_bikes"),
                       F.col("docks_avail").cast("int").alias("now_docks_avail"))
    per = F.explode(F.array(*[F.struct(
        F.lit(h).alias("horizon"), F.col(f"level_{h}").alias("pred_ratio"),
        F.col(f"proba_empty_{h}").alias("proba_empty"), F.col(f"proba_full_{h}").alias("proba_full"))
        for h in HORIZONS])).alias("t")
    long = _raw_scores(m, model_frame(live)).select(
        "station_id", "ts", "ratio", "docks_total", per).select("station_id", "ts", "ratio", "docks_total", "t.*")
    if m.bands is not None:
        long = with_band(long, m.bands)
    else:
        long = long.withColumns({"lo": F.col("pred_ratio"), "hi": F.col("pred_ratio")})
    thr = {k: F.lit(STRICT_THRESHOLD) for k in KINDS}
    for kind in KINDS:
        for h in HORIZONS:
            t = m.thresholds.get((kind, h), STRICT_THRESHOLD)
            thr[kind] = F.when(F.col("horizon") == h, F.lit(float(t))).otherwise(thr[kind])
    cap = F.col("docks_total")
    out = long.withColumns({"pred_bikes": st.whole(F.col("pred_ratio") * cap),
                            "pred_bikes_lo": st.whole(F.col("lo") * cap),
                            "pred_bikes_hi": st.whole(F.col("hi") * cap),
                            "thr_empty": thr["empty"], "thr_full": thr["full"],
                            "docks_total": cap.cast("int")})
    return out.join(keep, ["station_id", "ts"]).select(
        "station_id", "name", "district", F.col("ts").alias("base_ts"), "horizon", "now_bikes",
        "now_docks_avail", "docks_total", "pred_ratio", "pred_bikes",
        F.greatest(F.col("docks_total") - F.col("pred_bikes"), F.lit(0)).alias("pred_docks"),
        "pred_bikes_lo", "pred_bikes_hi", "proba_empty", "proba_full",
        *[(F.col(f"proba_{k}") >= STRICT_THRESHOLD).alias(f"alert_{k}") for k in KINDS],
        *[(F.col(f"proba_{k}") >= F.col(f"thr_{k}")).alias(f"watch_{k}") for k in KINDS],
        "thr_empty", "thr_full", "is_live")


def importance(spark: SparkSession, m: Models, top: int = 15) -> DataFrame:
    """Strongest inputs of each level model (M23, G9); 42 numbers per model."""
    rows = [(h, name, float(v)) for h, pm in m.levels.items()
            for name, v in zip(FEATURES, pm.stages[-1].featureImportances.toArray())]
    from dockwatch.operators.ordering import top_per_group

    df = spark.createDataFrame(rows, "horizon int, feature string, gain double")
    return top_per_group(df, ["horizon"], [F.desc("gain"), F.asc("feature")], top)


def save(m: Models, root: str) -> None:
    """Store the models, thresholds and bands below ``root``."""
    spark = SparkSession.getActiveSession()
    for h, pm in m.levels.items():
        pm.write().overwrite().save(f"{root}/level_{h}")
    for (kind, h), pm in m.events.items():
        pm.write().overwrite().save(f"{root}/{kind}_{h}")
    rows = [(k, h, float(t)) for (k, h), t in m.thresholds.items()]
    spark.createDataFrame(rows, "kind string, horizon int, threshold double").write.mode(
        "overwrite").parquet(f"{root}/thresholds")
    if m.bands is not None:
        m.bands.write.mode("overwrite").parquet(f"{root}/bands")


def load(spark: SparkSession, root: str) -> Models:
    m = Models()
    for h in HORIZONS:
        m.levels[h] = PipelineModel.load(f"{root}/level_{h}")
        for kind in KINDS:
            m.events[kind, h] = PipelineModel.load(f"{root}/{kind}_{h}")
    m.thresholds = {(r["kind"], r["horizon"]): r["threshold"]
                    for r in spark.read.parquet(f"{root}/thresholds").collect()}
    m.bands = spark.read.parquet(f"{root}/bands")
    return m

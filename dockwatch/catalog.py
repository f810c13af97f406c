"""Every registered query over a folder of parquet tables."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dockwatch.functions import status as st, textfn as tx, timefn as tf
from dockwatch.operators import series
from dockwatch.plans import (alerts as al, evaluate as ev, features as fe, forecasts as fc, learn as le,
                             history as hi, policy as po, profiles as pr, reports as rp, scoring as sc,
                             serve as sv, served as sd, shapes as sh)
from dockwatch.schemas import LATEST, RAW_KEEP_DAYS, SNAPSHOT, STATION_JSON
from dockwatch.session import shared_dir, stage
from dockwatch.sinks import notifications as nt
from dockwatch.sinks.tables import publish, read_days, read_published
from dockwatch.sources import files as fi, fixtures as fx
from dockwatch.streaming.episodes import OUT, current, episode_stream
from dockwatch.streaming.refresh import Store, refresh_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
PLANS: dict[str, Callable[["Data"], DataFrame]] = {}     # the same on prepared tables
AS_OF = "2024-01-20 12:00:00"


def query(fn: Callable[["Data"], DataFrame]) -> Callable[["Data"], DataFrame]:
    """Register fn under its own name."""
    PLANS[fn.__name__] = fn
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Data(spark, sf_dir))
    return fn


def r6(df: DataFrame, *cols: str) -> DataFrame:
    """Round to 6 decimals; summation order may differ beyond that."""
    return df.withColumns({c: st.steady_round(F.col(c), 6) + F.lit(0.0) for c in cols})


class Data:
    """The derived tables of one folder; each is built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, wide: bool = False):
        self.spark, self.dir, self.wide = spark, sf_dir, wide
        self.staged = False

    @cached_property
    def snaps(self) -> DataFrame:
        return fx.snapshots(self.spark, self.dir, self.wide)

    @cached_property
    def stations(self) -> DataFrame:
        return fx.stations(self.spark, self.dir, self.wide, self.snaps)

    @cached_property
    def valid(self) -> DataFrame:
        b, d, c = (F.col(x) for x in ("bikes", "docks_avail", "docks_total"))
        return self.snaps.filter(st.is_valid(b, d, c))

    @cached_property
    def latest(self) -> DataFrame:
        return sv.latest(self.snaps)

    @cached_property
    def profile(self) -> DataFrame:
        return pr.weekly_profile(self.snaps)

    @cached_property
    def model_stations(self) -> DataFrame:
        return fe.model_stations(self.stations, fx.MIN_SNAPSHOTS)

    @cached_property
    def obs(self) -> DataFrame:
        return fe.observations(self.snaps, self.model_stations)

    def stage_inputs(self) -> None:
        """Write the tables that several branches of a large plan read, once."""
        if self.staged:
            return
        self.staged = True
        self.snaps = stage(self.snaps, "snapshots")
        self.stations = stage(self.stations, "stations")
        self.obs = stage(self.obs, "obs")

    @cached_property
    def train_end(self) -> str:
        """The first day after the training days."""
        return fx.split_days(self.spark, self.dir)["valid"][0]

    @cached_property
    def groups(self) -> DataFrame:
        """Stand-in for fitted clusters that every engine can compute."""
        return self.model_stations.select(
            "station_id", (F.col("station_id") % 6).cast("int").alias("cluster_id"))

    @cached_property
    def features(self) -> DataFrame:
        self.stage_inputs()
        return fe.feature_matrix(
            self.obs, self.model_stations, self.groups, pr.norms(self.obs, self.train_end),
            fe.neighbours(self.model_stations), sh.holidays(self.obs), keep=["docks_avail"])

    @cached_property
    def targets(self) -> DataFrame:
        """Readings with complete targets, one row per horizon."""
        rows = fe.complete_targets(fe.leads(self.obs))
        return fe.by_horizon(rows, ["station_id", "ts", "bikes", "docks_avail", "docks_total", "ratio"])

    @cached_property
    def scored_targets(self) -> DataFrame:
        """``targets`` with the closed-form forecast of each row's horizon."""
        t = self.targets
        h = F.col("horizon")
        fade = F.lit(1.0) - h / F.lit(1000.0)

        def proba(c: str) -> Column:
            return F.round(F.lit(3.0) / (F.lit(3.0) + F.col(c)) * fade, 6)
        return t.withColumns({
            "pred_ratio": F.col("ratio") + (F.lit(0.5) - F.col("ratio")) * h / F.lit(600.0),
            "proba_empty": proba("bikes"), "proba_full": proba("docks_avail")})

    @cached_property
    def policy_rows(self) -> DataFrame:
        """Readings with streak and one-hour empty risk."""
        risk = F.round(F.lit(3.0) / (F.lit(3.0) + F.col("bikes")) * F.lit(0.94), 6)
        return fe.rolling(self.obs).select("station_id", "ts", "bikes", "docks_total",
                                           "empty_streak", risk.alias("proba"))

    @cached_property
    def forecast(self) -> DataFrame:
        return fx.forecast(self.spark, self.dir, self.wide)

    @cached_property
    def raw_text(self) -> list[DataFrame]:
        """Raw readings as two text sources with different clocks and names."""
        raw = fx.describe_stations(self.spark, self.dir,
                                   fx.raw_snapshots(self.spark, self.dir, self.wide), self.wide)
        t = F.col("raw_ts")
        early = t < F.lit("2024-01-16").cast("timestamp_ntz")
        damaged = F.when(early & (F.col("station_id") == 3), "NATION?3").otherwise(F.col("name"))
        cols = [F.lit("CITY").alias("city"), F.coalesce("district", F.lit(" ")).alias("district"),
                F.concat(F.lit(" "), damaged, F.lit(" ")).alias("name"), "docks_total", "bikes",
                "docks_avail", "lon", "lat"]
        a = raw.filter(early).select(F.date_format(t, "yyyy/MM/dd HH:mm").alias("raw_time"), *cols)
        b = raw.filter(~early).select(F.date_format(t, "yyyy-MM-dd HH:mm:ss").alias("raw_time"), *cols)
        return [a, b]

    @cached_property
    def fixes(self) -> DataFrame:
        """Damaged and right station names, from the nation table."""
        n = fx.table(self.spark, self.dir, "nation")
        return n.select(F.regexp_replace("n_name", "_", "?").alias("old_name"),
                        F.col("n_name").alias("new_name"))


# ------------------------------------------------------------ cleaning, history

@query
def snapshot_dedupe(d: Data) -> DataFrame:
    return d.snaps.withColumns({c: F.col(c).cast("int")
                                for c in ("bikes", "docks_avail", "docks_total")})


@query
def snapshot_enriched(d: Data) -> DataFrame:
    out = hi.enriched(d.snaps, d.stations)
    return r6(out.withColumns({c: F.col(c).cast("int") for c in ("bikes", "docks_avail", "docks_total")}),
              "lon", "lat")


@query
def status_ladder(d: Data) -> DataFrame:
    b, k, c = (F.col(x) for x in ("bikes", "docks_avail", "docks_total"))
    return d.snaps.groupBy(st.status(b, k, c).alias("status")).agg(F.count("*").alias("n"))


@query
def name_fix_union(d: Data) -> DataFrame:
    rows = hi.clean_rows(d.raw_text[0].unionByName(d.raw_text[1]), d.fixes)
    return rows.groupBy("name", tx.blank_to_null(F.col("district")).alias("district")).agg(
        F.count("*").alias("n"), F.min("raw_ts").alias("first_ts"), F.max("raw_ts").alias("last_ts"))


@query
def station_master(d: Data) -> DataFrame:
    rows = hi.one_row_per_slot(hi.clean_rows(d.raw_text[0].unionByName(d.raw_text[1]), d.fixes))
    return r6(hi.station_master(rows), "lon", "lat")


@query
def history_build(d: Data) -> DataFrame:
    facts, _ = hi.build_history(d.raw_text, d.fixes)
    return facts.groupBy("station_id").agg(
        F.count("*").alias("n"), F.sum("bikes").alias("bikes"), F.sum("docks_avail").alias("docks_avail"),
        F.sum("docks_total").alias("docks_total"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query
def registry_append(d: Data) -> DataFrame:
    """Stations seen in the first half are known; the rest of the users arrive later."""
    raw = fx.describe_stations(
        d.spark, d.dir,
        fx.raw_snapshots(d.spark, d.dir, True).withColumn("ts", tf.slot_start(F.col("raw_ts"))), True)
    half = F.lit("2024-01-03").cast("timestamp_ntz")
    known = hi.registry_rows(raw.filter(F.col("ts") < half))
    return r6(hi.append_unseen(known, raw.filter(F.col("ts") >= half)), "lon", "lat")


@query
def station_merge(d: Data) -> DataFrame:
    """Stations of the event feed first, customers fill the ids it lacks."""
    feed = fx.describe_stations(
        d.spark, d.dir, fx.raw_snapshots(d.spark, d.dir, True).select("station_id").distinct(), True)
    primary = feed.select("station_id", "name", F.lit("feed").alias("origin"))
    c = fx.table(d.spark, d.dir, "customer")
    secondary = c.select(F.col("c_custkey").alias("station_id"), F.col("c_name").alias("name"),
                         F.lit("master").alias("origin"))
    return hi.merge_masters(primary, secondary, "station_id")


@query
def unknown_customers(d: Data) -> DataFrame:
    """Orders whose customer the station feed does not know."""
    o = fx.table(d.spark, d.dir, "orders")
    known = fx.table(d.spark, d.dir, "events").select(F.col("user_id").alias("o_custkey")).distinct()
    return (o.join(known, "o_custkey", "left_anti").groupBy("o_custkey")
            .agg(F.count("*").alias("n_orders")))


@query
def qc_month(d: Data) -> DataFrame:
    return hi.month_quality(d.snaps)


@query
def qc_station(d: Data) -> DataFrame:
    rows = hi.one_row_per_slot(hi.clean_rows(d.raw_text[0].unionByName(d.raw_text[1])))
    return hi.station_quality(hi.station_master(rows))


@query
def qc_misaligned(d: Data) -> DataFrame:
    return hi.misaligned_rows(d.snaps)


# -------------------------------------------------------------------- serving

@query
def latest(d: Data) -> DataFrame:
    return d.latest.withColumns({c: F.col(c).cast("int") for c in ("bikes", "docks_avail", "docks_total")})


@query
def latest_slot(d: Data) -> DataFrame:
    out = sv.latest_slot(d.snaps, d.stations)
    return r6(out.withColumns({c: F.col(c).cast("int") for c in ("bikes", "docks_avail", "docks_total")}),
              "lon", "lat")


@query
def station_list(d: Data) -> DataFrame:
    out = sv.station_list(d.stations, d.latest)
    return r6(out.withColumns({c: F.col(c).cast("int") for c in ("bikes", "docks_avail", "docks_total")}),
              "lon", "lat")


@query
def mappable_stations(d: Data) -> DataFrame:
    return r6(sv.mappable(d.stations).select("station_id", "name", "lon", "lat"), "lon", "lat")


@query
def station_stats(d: Data) -> DataFrame:
    return sv.all_station_stats(d.snaps)


@query
def station_detail(d: Data) -> DataFrame:
    out = sv.station_detail(d.stations, d.latest, d.snaps, 3)
    return out.select("station_id", "name", "district", "capacity_docks", "n_snapshots",
                      F.col("current.ts").alias("ts"), F.col("current.status").alias("status"),
                      F.col("stats.bikes_mean").alias("bikes_mean"),
                      F.col("stats.empty_rate").alias("empty_rate"),
                      F.col("stats.full_rate").alias("full_rate"),
                      F.col("stats.occ_rate").alias("occ_rate"))


@query
def station_history(d: Data) -> DataFrame:
    out = sv.station_history(d.snaps, 3, 7)
    return out.withColumns({c: F.col(c).cast("int") for c in ("bikes", "docks_avail", "docks_total")})


@query
def replay(d: Data) -> DataFrame:
    out = sv.replay(d.snaps, d.stations, "2024-01-15 08:10:00")
    return r6(out.withColumns({c: F.col(c).cast("int") for c in ("bikes", "docks_avail", "docks_total")}),
              "lon", "lat")


@query
def replay_status(d: Data) -> DataFrame:
    return sv.status_histogram(sv.station_list(d.stations, d.latest))


@query
def replay_days(d: Data) -> DataFrame:
    return sv.replay_days(d.snaps, 40)


@query
def weekly_profile(d: Data) -> DataFrame:
    return d.profile


@query
def profile_rollup(d: Data) -> DataFrame:
    return pr.profile_rollup(d.profile)


@query
def profile_district(d: Data) -> DataFrame:
    return pr.profile_rollup(d.profile, d.stations, "ASIA")


@query
def heatmap(d: Data) -> DataFrame:
    return pr.heatmap(d.spark, pr.profile_rollup(d.profile))


@query
def pulse(d: Data) -> DataFrame:
    return sv.pulse(d.snaps, d.stations, every_day=True)


@query
def pulse_newest_day(d: Data) -> DataFrame:
    return sv.pulse(d.snaps, d.stations)


def _newest_weekday(d: Data) -> Column:
    return d.snaps.agg(tf.iso_weekday(F.max("ts"))).scalar()


@query
def pulse_baseline(d: Data) -> DataFrame:
    return sv.pulse_baseline(d.profile, d.stations, _newest_weekday(d))


@query
def pulse_vs_baseline(d: Data) -> DataFrame:
    return sv.pulse_against_baseline(pulse_newest_day(d), pulse_baseline(d))


@query
def districts(d: Data) -> DataFrame:
    return sv.districts(d.stations, d.latest)


@query
def district_capacity(d: Data) -> DataFrame:
    return sv.districts(d.stations, None)


@query
def district_list(d: Data) -> DataFrame:
    return sv.district_list(d.stations)


@query
def problem_bar(d: Data) -> DataFrame:
    return sv.problem_bars(sv.districts(d.stations, d.latest))


@query
def overview(d: Data) -> DataFrame:
    return sv.overview_now(d.stations, d.latest)


@query
def overview_history(d: Data) -> DataFrame:
    return sv.overview_history(d.stations, d.snaps)


@query
def worst(d: Data) -> DataFrame:
    return sv.worst_stations(d.snaps, d.stations, "empty", 10)


@query
def worst_full(d: Data) -> DataFrame:
    return sv.worst_stations(d.snaps, d.stations, "full", 10)


@query
def coverage(d: Data) -> DataFrame:
    return sv.coverage(d.snaps)


@query
def freshness(d: Data) -> DataFrame:
    return sv.freshness(d.latest.withColumn("fetched_at", F.col("ts")))


@query
def labels(d: Data) -> DataFrame:
    """Slot labels and episode texts over the whole history."""
    e = al.episodes(d.snaps)
    return (e.select(tf.slot_label(tf.slot_of_day(F.col("ts"))).alias("label"),
                     tf.duration_text(F.col("duration_min"), F.col("duration_capped")).alias("text"))
            .groupBy("label", "text").agg(F.count("*").alias("n")))


# --------------------------------------------------------------------- alerts

@query
def alerts(d: Data) -> DataFrame:
    return _plain_alerts(al.alerts(d.snaps, d.stations))


@query
def alerts_as_of(d: Data) -> DataFrame:
    return _plain_alerts(al.alerts(d.snaps, d.stations, AS_OF))


def _plain_alerts(a: DataFrame) -> DataFrame:
    return r6(a.withColumns({c: F.col(c).cast("int") for c in ("bikes", "docks_avail", "docks_total")}),
              "lon", "lat")


@query
def episodes(d: Data) -> DataFrame:
    return al.episodes(d.snaps)


@query
def alert_counts(d: Data) -> DataFrame:
    return al.alert_counts(al.alerts(d.snaps, d.stations, AS_OF))


@query
def escalations(d: Data) -> DataFrame:
    """What rose between one alert round and the next half-hour's."""
    before = al.alerts(d.snaps, d.stations, "2024-01-20 11:30:00").filter(
        F.col("level").isin("warning", "critical")).select("station_id", "level")
    events, _ = al.escalations(al.alerts(d.snaps, d.stations, AS_OF), before)
    return events.withColumns({c: F.col(c).cast("int") for c in ("bikes", "docks_avail", "docks_total")})


@query
def dispatch_rule(d: Data) -> DataFrame:
    return fc.dispatch_by_rule(al.alerts(d.snaps, d.stations, AS_OF))


# ------------------------------------------------------------------- features

@query
def grid(d: Data) -> DataFrame:
    return r6(series.complete_grid(d.obs), "ratio")


@query
def lags(d: Data) -> DataFrame:
    cols = [f"ratio_lag{k}" for k in fe.LAGS]
    return r6(fe.lags(d.obs).select("station_id", "ts", *cols), *cols)


@query
def leads(d: Data) -> DataFrame:
    ratios = [c for c in fe.TARGETS if c.startswith(("y_ratio", "bl_"))]
    return r6(fe.leads(d.obs).select("station_id", "ts", *fe.TARGETS), *ratios)


@query
def rolling(d: Data) -> DataFrame:
    cols = [f"roll_{f}_{n}" for n in (4, 12) for f in ("mean", "std")] + [
        f"roll_{f}_48" for f in ("mean", "min", "max")]
    return r6(fe.rolling(d.obs).select("station_id", "ts", *cols, "empty_streak", "full_streak"), *cols)


@query
def norms(d: Data) -> DataFrame:
    return r6(pr.norms(d.obs, d.train_end), "norm_ratio", "norm_empty_rate", "norm_full_rate")


@query
def neighbours(d: Data) -> DataFrame:
    return r6(fe.neighbours(d.model_stations), "km")


@query
def neighbour_mean(d: Data) -> DataFrame:
    d.obs = stage(d.obs, "obs")
    return r6(fe.neighbour_mean(d.obs, fe.neighbours(d.model_stations)), "neigh_ratio")


@query
def group_means(d: Data) -> DataFrame:
    places = d.model_stations.join(d.groups, "station_id")
    part = stage(fe.group_means(d.obs, places), "group_means")
    a = fe.mean_by(part, "district", "m").withColumns(
        {"kind": F.lit("district"), "grp": F.col("district")})
    b = fe.mean_by(part, "cluster_id", "m").withColumns(
        {"kind": F.lit("cluster"), "grp": F.col("cluster_id").cast("string")})
    cols = ["kind", "grp", "ts", st.steady_round(F.col("m"), 6).alias("mean_ratio")]
    return a.select(*cols).unionByName(b.select(*cols))


@query
def holidays(d: Data) -> DataFrame:
    return r6(sh.day_distances(d.obs).withColumn(
        "is_holiday", F.col("to_weekend") < F.col("to_workday")), "to_weekend", "to_workday")


@query
def shape_z(d: Data) -> DataFrame:
    return r6(sh.day_shapes(d.obs).select("day", "hour", "r", "z"), "r", "z")


@query
def shape_fill(d: Data) -> DataFrame:
    return r6(sh.station_shapes(d.obs, d.train_end).select("station_id", "bucket", "level", "z"),
              "level", "z")


@query
def features(d: Data) -> DataFrame:
    f = d.features
    doubles = [c for c, t in f.dtypes if t == "double"]
    return r6(f.drop("docks_avail"), *doubles)


@query
def split_counts(d: Data) -> DataFrame:
    f = fe.leads(d.obs)
    parts = []
    for name, (a, b) in fx.split_days(d.spark, d.dir).items():
        parts.append(fe.split(f, a, b).withColumn("split", F.lit(name)))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("split").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"),
                                      F.max("ts").alias("last_ts"))


@query
def bridge(d: Data) -> DataFrame:
    return r6(pr.bridge(d.obs), "ratio")


def _bridged(d: Data) -> DataFrame:
    d.obs = stage(d.obs, "obs")
    return series.bridged_grid(d.model_stations, d.obs, pr.bridge(d.obs), sv.newest(d.obs),
                               fe.WEEK_SLOTS)


@query
def bridged_grid(d: Data) -> DataFrame:
    return r6(_bridged(d), "ratio")


@query
def bridge_ratio(d: Data) -> DataFrame:
    n = F.count("*")
    live, filled = F.count_if("is_live"), F.count("ratio")
    return _bridged(d).agg(n.alias("grid_cells"), st.steady_round(live / n, 4).alias("live_slot_ratio"),
                           st.steady_round((filled - live) / n, 4).alias("bridged_slot_ratio"))


# ----------------------------------------------------------------- evaluation

@query
def baseline_metrics(d: Data) -> DataFrame:
    return r6(ev.baseline_metrics(d.targets), "mae_ratio", "rmse_ratio", "mae_bikes")


@query
def rule_prf(d: Data) -> DataFrame:
    return r6(ev.baseline_events(d.targets), "precision", "recall", "f1")


@query
def level_metrics(d: Data) -> DataFrame:
    """Errors of the closed-form level forecast and its gain over persistence."""
    rows = d.scored_targets
    both = F.explode(F.array(
        F.struct(F.lit("formula").alias("model"), F.col("pred_ratio").alias("pred")),
        F.struct(F.lit("persistence").alias("model"), F.col("ratio").alias("pred")))).alias("b")
    m = rows.select("horizon", "y_ratio", "docks_total", both).select(
        "horizon", "y_ratio", "docks_total", "b.*").groupBy("horizon", "model").agg(
        *ev.level_errors("pred"))
    return r6(ev.improvement(m, "formula", "persistence"), "improve_pct")


@query
def best_threshold(d: Data) -> DataFrame:
    return r6(ev.best_threshold(ev.scored(d.scored_targets)), "precision", "recall", "f1", "threshold")


@query
def threshold_prf(d: Data) -> DataFrame:
    return r6(ev.with_prf(ev.threshold_table(ev.scored(d.scored_targets))),
              "precision", "recall", "f1", "threshold")


@query
def average_precision(d: Data) -> DataFrame:
    return r6(ev.ranking_quality(ev.scored(d.scored_targets)), "average_precision", "roc_auc")


@query
def interval_report(d: Data) -> DataFrame:
    rows = d.scored_targets.withColumns({
        "lo": F.col("pred_ratio") - F.lit(0.1), "hi": F.col("pred_ratio") + F.col("horizon") / F.lit(600.0) - F.lit(0.15)})
    return r6(ev.interval_report(rows), "coverage", "mean_width_bikes", "crossed_rate")


@query
def events(d: Data) -> DataFrame:
    return ev.both_event_starts(d.obs)


def _event_tables(d: Data) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = stage(d.scored_targets, "scored")
    long = F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(f"proba_{k}").alias("proba"), ev.truth(k).alias("fact"))
        for k in ("empty", "full")])).alias("k")
    probs = rows.select("station_id", "ts", "horizon", long).select("station_id", "ts", "horizon", "k.*")
    one = rows.filter(F.col("horizon") == 30).select("station_id", "ts", "bikes", "docks_total")
    leads_ = ev.event_leads(ev.both_event_starts(one), probs, fx.WATCH_THRESHOLD)
    return rows, probs, leads_


def _span(rows: DataFrame) -> Column:
    """Calendar days from the first to the last reading."""
    return rows.agg(F.datediff(F.max("ts"), F.min("ts")) + 1).scalar()


@query
def event_leads(d: Data) -> DataFrame:
    probs = (d.obs.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in fe.HORIZONS])))
             .withColumn("fade", F.lit(1.0) - F.col("horizon") / F.lit(1000.0)))
    kinds = F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"),
                 F.round(F.lit(3.0) / (F.lit(3.0) + F.col(c)) * F.col("fade"), 6).alias("proba"))
        for k, c in (("empty", "bikes"), ("full", "docks_avail"))])).alias("k")
    probs = probs.select("station_id", "ts", "horizon", kinds).select("station_id", "ts", "horizon", "k.*")
    return ev.event_leads(ev.both_event_starts(d.obs), probs, fx.WATCH_THRESHOLD)


@query
def event_report(d: Data) -> DataFrame:
    rows, probs, leads_ = _event_tables(d)
    n = rows.agg(F.countDistinct("station_id")).scalar()
    out = ev.event_report(leads_, probs, n, _span(rows), fx.WATCH_THRESHOLD)
    return r6(out, "coverage", "mean_lead_minutes", "median_lead_minutes",
              "mean_lead_minutes_all_events", "false_alarm_rate", "alerts_per_station_per_day")


# --------------------------------------------------------------------- policy

@query
def policy_rank(d: Data) -> DataFrame:
    return r6(po.ranked_picks(d.policy_rows), "score")


@query
def policy_coverage(d: Data) -> DataFrame:
    d.policy_rows = stage(d.policy_rows, "policy_rows")
    return po.policy_coverage(d.policy_rows)


@query
def events_preventable(d: Data) -> DataFrame:
    d.policy_rows = stage(d.policy_rows, "policy_rows")
    return po.events_preventable(d.policy_rows)


@query
def concentration(d: Data) -> DataFrame:
    return po.concentration(d.policy_rows)


# ------------------------------------------------------------------- forecast

@query
def forecast_top(d: Data) -> DataFrame:
    return r6(fc.forecast_list(d.forecast, 60, limit=300).select(
        "station_id", "name", "district", "base_ts", "horizon", "now_bikes", "pred_bikes",
        "pred_docks", "proba_empty", "proba_full", "watch_empty", "watch_full", "risk"), "risk")


@query
def forecast_alerts(d: Data) -> DataFrame:
    return fc.forecast_alerts(d.forecast, 60, limit=200)


@query
def forecast_alerts_strict(d: Data) -> DataFrame:
    return fc.forecast_alerts(d.forecast, 30, "strict", limit=200)


@query
def forecast_totals(d: Data) -> DataFrame:
    return fc.forecast_totals(d.forecast)


@query
def forecast_station(d: Data) -> DataFrame:
    return r6(fc.forecast_station(d.forecast, 3).select(
        "horizon", "base_ts", "now_bikes", "pred_bikes", "pred_docks", "pred_ratio"), "pred_ratio")


@query
def forecast_curve(d: Data) -> DataFrame:
    return fc.forecast_curve(d.forecast)


@query
def dispatch(d: Data) -> DataFrame:
    return fc.dispatch(d.forecast, d.stations, 60, max_km=1.2)


@query
def alerts_served(d: Data) -> DataFrame:
    """The stored alerts are half an hour too old, so they are computed again."""
    root = f"{shared_dir(d.spark)}/served-{uuid.uuid4().hex}"
    early = "2024-01-20 11:30:00"
    sd.publish_at(al.alerts(d.snaps, d.stations, early), root, F.lit(early))
    return _plain_alerts(sd.alerts_served(root, d.snaps, d.stations, AS_OF, since=dt.datetime.fromisoformat(AS_OF)))


@query
def dispatch_served(d: Data) -> DataFrame:
    """Tasks from a stored forecast, and by the rule where none is stored."""
    root = f"{shared_dir(d.spark)}/served-{uuid.uuid4().hex}"
    sd.publish_at(d.forecast, f"{root}/forecast", F.lit(AS_OF))

    def live() -> DataFrame:
        return al.alerts(d.snaps, d.stations, AS_OF)
    return sd.dispatch_served(f"{root}/forecast", d.stations, live, max_km=1.2).unionByName(
        sd.dispatch_served(f"{root}/none", d.stations, live, max_km=1.2))


@query
def forecast_meta(d: Data) -> DataFrame:
    judged = stage(d.scored_targets, "judged")
    flat = {(k, h): fx.WATCH_THRESHOLD for k in ("empty", "full") for h in fe.HORIZONS}
    root = f"{shared_dir(d.spark)}/report-{uuid.uuid4().hex}"
    publish(rp.backtest_metrics(judged, _span(judged), flat), root)
    return sd.forecast_meta(d.forecast, sd.model_report(d.spark, root)).drop("horizons")


@query
def dispatch_totals(d: Data) -> DataFrame:
    return fc.dispatch_totals(fc.dispatch(d.forecast, d.stations, 60, max_km=1.2))


# ---------------------------------------------------------------- raw records

@query
def nested_master(d: Data) -> DataFrame:
    """Station master read back from nested JSON records."""
    path = f"{shared_dir(d.spark)}/masters-{uuid.uuid4().hex}"
    address = F.concat_ws(" ", "district", F.lit("ROAD"), F.col("station_id").cast("string"))
    (d.stations.select(
        F.concat(F.lit("UID"), F.col("station_id").cast("string")).alias("StationUID"),
        F.struct(F.concat(F.lit("PREFIX_"), "name").alias("Zh_tw")).alias("StationName"),
        F.struct(address.alias("Zh_tw")).alias("StationAddress"),
        F.struct(F.col("lon").alias("PositionLon"), F.col("lat").alias("PositionLat")).alias("StationPosition"))
     .write.json(path))
    out = fi.nested_stations(d.spark.read.schema(STATION_JSON).json(path), "UID", "PREFIX_")
    return r6(out, "lon", "lat")


@query
def historical_slots(d: Data) -> DataFrame:
    """Newest historical record per station number and slot, from times with a zone."""
    raw = fx.raw_snapshots(d.spark, d.dir, d.wide)
    records = raw.select(
        F.concat(F.lit("UID"), F.col("station_id").cast("string")).alias("StationUID"),
        F.concat(F.col("raw_ts").cast("string"), F.lit("+08:00")).alias("SrcUpdateTime"),
        F.col("bikes").alias("AvailableRentBikes"), F.col("docks_avail").alias("AvailableReturnBikes"))
    return fi.historical_day(records, "UID").select("sno", "slot", "bikes", "docks_avail")


@query
def name_lookup(d: Data) -> DataFrame:
    path = f"{shared_dir(d.spark)}/names-{uuid.uuid4().hex}"
    d.stations.write.parquet(path)
    return fi.name_lookup(d.spark, path)


@query
def rejected_records(d: Data) -> DataFrame:
    """How many landed records of each day are usable and how many are not; station 3 lost its name."""
    raw = fx.describe_stations(d.spark, d.dir, fx.raw_snapshots(d.spark, d.dir, d.wide), d.wide)
    bikes = F.when(F.col("bikes") == 7, "seven").otherwise(F.col("bikes").cast("string"))
    records = raw.select(
        F.col("station_id").cast("string").alias("sno"),
        F.when(F.col("station_id") == 3, "PREFIX_ ").otherwise(F.concat(F.lit("PREFIX_"), "name")).alias("sna"),
        F.col("district").alias("sarea"), F.col("docks_total").cast("string").alias("tot_quantity"),
        bikes.alias("sbi_quantity"), F.col("docks_avail").cast("string").alias("bemp"),
        F.col("lon").cast("string").alias("lng"), F.col("lat").cast("string").alias("lat"), F.lit("1").alias("act"),
        F.lit("").alias("yb2_quantity"), F.lit(None).cast("string").alias("eyb_quantity"), F.lit("").alias("mday"),
        F.col("raw_ts").alias("at"))
    ok, bad = fi.split_realtime(records, F.col("at"), "PREFIX_", {"FRANCE": "GAUL"})
    day = F.col("at").cast("date").alias("day")
    both = ok.select(F.col("fetched_at").cast("date").alias("day"), "name").unionByName(
        bad.select(day, F.lit(None).cast("string").alias("name")))
    return both.groupBy("day").agg(F.count("name").alias("n_ok"), F.count_if(F.col("name").isNull()).alias("n_bad"),
                                   F.count_if(F.col("name") == "GAUL").alias("n_relabelled"))


@query
def json_rows(d: Data) -> DataFrame:
    e = fx.table(d.spark, d.dir, "events")
    return e.select("event_id", tx.as_json("event_id", "user_id", "event_type").alias("body"))


@query
def notifications(d: Data) -> DataFrame:
    """The log after two rounds, one of them folded and one not."""
    root = f"{shared_dir(d.spark)}/log-{uuid.uuid4().hex}"
    early = "2024-01-20 11:30:00"
    nobody = d.spark.createDataFrame([], "station_id long, level string")
    for epoch, (at, seen) in enumerate(((early, nobody), (AS_OF, None))):
        rows = stage(al.alerts(d.snaps, d.stations, at), "round")
        sent, state = al.escalations(rows, before if seen is None else seen)
        nt.append_notifications(sent, root, epoch, F.lit(at))
        before = stage(state, "state")
        if epoch == 0:
            nt.fold_notifications(d.spark, root)
    out = nt.notification_log(d.spark, root)
    return out.withColumns({x: F.col(x).cast("int") for x in ("bikes", "docks_avail", "docks_total")})


# ------------------------------------------------------------------- learning

def _trained(d: Data):
    """Small models on the training days; sizes follow the fixture, not production."""
    f = stage(d.features, "features")
    days = fx.split_days(d.spark, d.dir)
    tr, va = fe.split(f, *days["train"]), fe.split(f, *days["valid"])
    s = le.Settings(rounds=2, depth=3, min_rows=1)
    return f, le.train(tr, va, s)


@query
def clusters(d: Data) -> DataFrame:
    return sh.clusters(stage(d.obs, "obs"), d.train_end)


@query
def scored_forecast(d: Data) -> DataFrame:
    """Train, then score every station's newest slot from bridged readings."""
    _, m = _trained(d)
    live = sc.live_features(d.snaps, d.snaps, d.model_stations, d.groups,
                            pr.norms(d.obs, d.train_end), fe.neighbours(d.model_stations),
                            sh.holidays(d.obs))
    return le.forecast_table(m, live)


@query
def band_table(d: Data) -> DataFrame:
    """Bands of the closed-form forecast, from the residuals of the validation days."""
    first, last = fx.split_days(d.spark, d.dir)["valid"]
    day = F.col("ts").cast("date").cast("string")
    counts = stage(le.residual_counts(d.scored_targets.filter(day.between(first, last))), "residuals")
    return r6(le.conformal_bands(counts, least=50), "lo_shift", "hi_shift")


@query
def conformal_interval(d: Data) -> DataFrame:
    f, m = _trained(d)
    test = fe.split(f, *fx.split_days(d.spark, d.dir)["test"])
    judged = le.with_band(le.judge(m, le.model_frame(test)), m.bands)
    return ev.interval_report(judged)


# ------------------------------------------------------------------ streaming

def _land_events(d: Data) -> str:
    """All readings as landed JSON records, one folder of files per day."""
    raw = fx.describe_stations(d.spark, d.dir, fx.raw_snapshots(d.spark, d.dir, d.wide), d.wide)
    path = f"{shared_dir(d.spark)}/landed-{uuid.uuid4().hex}"
    def text(x):
        return F.col(x).cast("string")
    (raw.select(F.lit("S").alias("sno"), F.concat(F.lit("PREFIX_"), "name").alias("sna"),
                F.col("district").alias("sarea"), text("docks_total").alias("tot_quantity"),
                text("bikes").alias("sbi_quantity"), text("docks_avail").alias("bemp"),
                text("lon").alias("lng"), text("lat").alias("lat"), F.lit("1").alias("act"),
                text("raw_ts").alias("fetched_at"), F.col("raw_ts").cast("date").alias("day"))
     .repartition("day").write.partitionBy("day").json(path))
    return path


def _refreshed(d: Data, keep_days: int | None = None, now: str | None = None) -> Store:
    """Run the refresh stream over everything landed, in several batches."""
    store = Store(f"{shared_dir(d.spark)}/store-{uuid.uuid4().hex}")
    known = d.stations.filter(F.col("station_id") != 5)
    publish(known, store.at("registry"))
    q = refresh_stream(d.spark, _land_events(d), store, store.at("checkpoint"), "PREFIX_",
                       every=None, files_per_trigger=15, keep_days=keep_days, now=now)
    q.awaitTermination()
    return store


@query
def stream_recent(d: Data) -> DataFrame:
    """Streamed slot table; the one unknown station is numbered 900000."""
    out = read_days(d.spark, _refreshed(d, keep_days=None).at("recent"), SNAPSHOT)
    return out.withColumns({x: F.col(x).cast("int") for x in ("bikes", "docks_avail", "docks_total")})


@query
def stream_recent_kept(d: Data) -> DataFrame:
    """The slot table with the 14 days of a running system, whose clock stands at the last day."""
    today = d.snaps.agg(F.max(F.col("ts").cast("date"))).first()[0]
    store = _refreshed(d, RAW_KEEP_DAYS, str(today))
    out = read_days(d.spark, store.at("recent"), SNAPSHOT)
    return out.withColumns({x: F.col(x).cast("int") for x in ("bikes", "docks_avail", "docks_total")})


@query
def stream_latest(d: Data) -> DataFrame:
    out = read_published(d.spark, _refreshed(d).at("latest"), LATEST)
    return r6(out.withColumns({x: F.col(x).cast("int") for x in ("bikes", "docks_avail", "docks_total")}),
              "lon", "lat")


@query
def stream_episodes(d: Data) -> DataFrame:
    """Keyed-state durations over a stream of slot readings that come up to two days late."""
    base = f"{shared_dir(d.spark)}/episodes-{uuid.uuid4().hex}"
    days = d.snaps.withColumn("day", F.col("ts").cast("date"))
    first, last = days.agg(F.min("day"), F.max("day")).first()
    # Files are picked up by age, so what comes later must be written later: one
    # write per third of the span. Two of three days come with others, after newer days.
    third = max(1, ((last - first).days + 5) // 3) if first else 1
    number = F.datediff("day", F.lit(first))
    for k in range(3) if first else []:
        part = days.filter(F.floor((number + F.pmod(number * 7 + F.col("station_id"), F.lit(3))) / third) == k)
        part.drop("day").repartition(4, "station_id").write.mode("append").parquet(f"{base}/in")
    src = d.spark.readStream.schema(SNAPSHOT).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    q = (episode_stream(src, late_hours=72).writeStream.format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    out = current(d.spark.read.schema(OUT).parquet(f"{base}/out"))
    start = F.lit("1970-01-01").cast("timestamp_ntz")
    return out.select("station_id", tf.plus_minutes(
        start + F.make_dt_interval((F.col("slot") / 48).cast("int")), (F.col("slot") % 48) * 30).alias("ts"),
        "kind", "duration_min", "duration_capped")


@query
def backtest_report(d: Data) -> DataFrame:
    """All metric sections for the closed-form forecast over the whole history."""
    judged = stage(d.scored_targets, "judged")
    flat = {(k, h): fx.WATCH_THRESHOLD for k in ("empty", "full") for h in fe.HORIZONS}
    return r6(rp.backtest_metrics(judged, _span(judged), flat).filter(F.col("value").isNotNull()), "value")

"""Feature matrix for training and for the newest slot (M1, M4-M8)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from dockwatch.functions.cols import c
from dockwatch.functions import status as st, timefn as tf
from dockwatch.operators.frames import CHUNK_SLOTS, frame, own_rows, with_halo
from dockwatch.operators.pages import PAGE, dense, own, pages_of, with_chunk
from dockwatch.operators.spatial import nearest
from dockwatch.schemas import (FEATURES, HORIZONS, LAGS, MIN_MODEL_SNAPSHOTS, MODEL_EMPTY_MAX,
                               MODEL_FULL_MAX, NEIGHBOUR_COUNT, NEIGHBOUR_KM, SLOT_MINUTES,
                               STREAK_SLOTS, WEEK_SLOTS)
from dockwatch.session import stage, stage_bucketed

KEY = ["station_id"]
TARGETS = [f"{p}_{h}" for h in HORIZONS for p in ("y_ratio", "y_bikes", "y_docks", "bl_lastweek")]


def model_stations(stations: DataFrame, min_snapshots: int = MIN_MODEL_SNAPSHOTS) -> DataFrame:
    """Stations with capacity, traffic, a district and enough history."""
    fit = stations.filter((F.col("capacity_docks") > 0) & ~F.col("always_empty")
                          & (F.col("n_snapshots") >= min_snapshots)
                          & F.col("district").isNotNull())
    # A categorical model input, so the list of districts is short by nature.
    codes = fit.select("district").distinct().select(
        "district", (F.dense_rank().over(Window.orderBy("district")) - 1).alias("district_id"))
    return fit.join(codes, "district").select(
        "station_id", "name", "district", "district_id", "lon", "lat",
        F.col("capacity_docks").cast("int").alias("capacity"))


def observations(snapshots: DataFrame, stations: DataFrame) -> DataFrame:
    """Valid readings of the given stations with their fill ratio (C4)."""
    wide = [F.col(x).cast("int").alias(x) for x in ("bikes", "docks_avail", "docks_total")]
    return (snapshots.filter(st.is_valid(c.bikes, c.docks, c.total))
            .join(stations.select("station_id"), "station_id", "left_semi")
            .select("station_id", "ts", *wide, (c.bikes / c.total).alias("ratio")))


# A time feature is an aggregate over the slots lo..hi around a reading. The
# same list is rendered as window frames for a whole history and as one
# conditional aggregation per station when only a single slot is wanted.
Spec = dict[str, tuple[Callable[[Column], Column], Column, int, int]]


def _lag_spec() -> Spec:
    return {f"ratio_lag{k}": (F.max, c.ratio, -k, -k) for k in LAGS}


def _lead_spec() -> Spec:
    out: Spec = {}
    for h in HORIZONS:
        k = h // SLOT_MINUTES
        out[f"y_ratio_{h}"] = (F.max, c.ratio, k, k)
        out[f"y_bikes_{h}"] = (F.max, c.bikes, k, k)
        out[f"y_docks_{h}"] = (F.max, c.docks, k, k)
        out[f"bl_lastweek_{h}"] = (F.max, c.ratio, k - WEEK_SLOTS, k - WEEK_SLOTS)
    return out


def _total(v: Column) -> Column:
    return F.coalesce(F.sum(v), F.lit(0)).cast("int")


def _rolling_spec() -> Spec:
    out: Spec = {}
    for n in (4, 12):
        out[f"roll_mean_{n}"] = (F.avg, c.ratio, 1 - n, 0)
        out[f"roll_std_{n}"] = (F.stddev_samp, c.ratio, 1 - n, 0)
    for name, f in (("mean", F.avg), ("min", F.min), ("max", F.max)):
        out[f"roll_{name}_48"] = (f, c.ratio, -47, 0)
    # Matching slots among the last six, not the length of the current run.
    out["empty_streak"] = (_total, F.when(c.bikes <= MODEL_EMPTY_MAX, 1), 1 - STREAK_SLOTS, 0)
    out["full_streak"] = (_total, F.when(c.docks <= MODEL_FULL_MAX, 1), 1 - STREAK_SLOTS, 0)
    return out


def _reach(spec: Spec) -> tuple[int, int]:
    """How many slots back and ahead the frames of a specification look."""
    return (max(0, -min(lo for _, _, lo, _ in spec.values())), max(0, max(hi for _, _, _, hi in spec.values())))


def _with_frames(rows: DataFrame, spec: Spec) -> DataFrame:
    return rows.withColumns({name: _windowed(f, v, lo, hi) for name, (f, v, lo, hi) in spec.items()})


def _over_history(obs: DataFrame, spec: Spec) -> DataFrame:
    """Every reading with its time features."""
    return own_rows(_with_frames(with_halo(obs, tf.slot_index(F.col("ts")), *_reach(spec)), spec))


def _windowed(f: Callable[[Column], Column], v: Column, lo: int, hi: int) -> Column:
    w = frame(KEY, lo, hi)
    if f is _total:
        return F.coalesce(F.sum(v).over(w), F.lit(0)).cast("int")
    return f(v).over(w)


def _at_slot(obs: DataFrame, spec: Spec, at: Column, keep: list[str]) -> DataFrame:
    """The readings of one slot with the same time features, without a window."""
    back = -min(lo for _, _, lo, _ in spec.values())
    rel = tf.slot_index(F.col("ts")) - tf.slot_index(at)
    near = obs.filter((F.col("ts") <= at) & (F.col("ts") >= tf.plus_minutes(at, -SLOT_MINUTES * back)))
    near = near.withColumn("_rel", rel)
    here = F.col("_rel") == 0
    values = list(dict.fromkeys(["ratio", "bikes", "docks_avail", "docks_total", *keep]))
    return (near.groupBy("station_id").agg(
        F.max(F.when(here, F.col("ts"))).alias("ts"),
        *[F.max(F.when(here, F.col(x))).alias(x) for x in values],
        *[f(F.when(F.col("_rel").between(lo, hi), v)).alias(name)
          for name, (f, v, lo, hi) in spec.items()])
        .filter(F.col("ts").isNotNull()))


def lags(obs: DataFrame) -> DataFrame:
    return _over_history(obs, _lag_spec())


def leads(obs: DataFrame) -> DataFrame:
    return _over_history(obs, _lead_spec())


def rolling(obs: DataFrame) -> DataFrame:
    return _over_history(obs, _rolling_spec())


def neighbours(stations: DataFrame, k: int = NEIGHBOUR_COUNT, km: float = NEIGHBOUR_KM) -> DataFrame:
    """Up to k nearest stations within km."""
    p = stage(stations.select(F.col("station_id").alias("id"), "lat", "lon"), "points")
    return nearest(p, p, k, km).select(
        F.col("left_id").alias("station_id"), F.col("right_id").alias("neighbour_id"), "km")


def neighbour_mean(obs: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean level around each station and slot."""
    rows = with_chunk(obs.select("station_id", "ts", "ratio"))
    return _neighbour_mean(rows, edges).select("station_id", "ts", "neigh_ratio", "neigh_n")


def _neighbour_mean(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """The same for rows with _slot and _chunk: edges go to the pages of the neighbour, readings stay there."""
    there = rows.select(F.col("station_id").alias("neighbour_id"), "_chunk").distinct()
    asked = edges.select("station_id", "neighbour_id").join(there, "neighbour_id")
    around = rows.select(F.col("station_id").alias("neighbour_id"), "_chunk", "_slot", "ts", "ratio")
    return (asked.join(around, ["neighbour_id", "_chunk"]).groupBy(*PAGE, "_slot", "ts")
            .agg(F.avg("ratio").alias("neigh_ratio"), F.count("*").alias("neigh_n")))


def group_means(obs: DataFrame, groups: DataFrame) -> DataFrame:
    """Sum and count per district, cluster and slot: the shared first step."""
    return _group_sums(with_chunk(obs.select("station_id", "ts", "ratio")), groups).drop("_chunk", "_slot")


def _group_sums(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The same for rows with _slot and _chunk; readings meet their groups page by page."""
    pages = pages_of(rows, groups.select("station_id", "district", "cluster_id"))
    return (rows.select(*PAGE, "_slot", "ts", "ratio").join(pages, PAGE)
            .groupBy("district", "cluster_id", "_chunk", "_slot", "ts")
            .agg(F.sum("ratio").alias("s"), F.count("*").alias("n")))


def mean_by(partial: DataFrame, key: str, name: str) -> DataFrame:
    """Second step of E17: mean over all readings of a district or cluster."""
    return partial.groupBy(key, "ts").agg((F.sum("s") / F.sum("n")).alias(name))


def calendar(ts: Column) -> dict[str, Column]:
    return {"slot_of_day": tf.slot_of_day(ts), "dow": tf.sunday_weekday(ts),
            "is_weekend": tf.is_model_weekend(ts).cast("int"),
            "minutes_since_midnight": tf.minute_of_day(ts)}


def _at_one_slot(rows: DataFrame, around: DataFrame, places: DataFrame, norm: DataFrame,
                 edges: DataFrame, days_off: DataFrame) -> DataFrame:
    """The readings of one slot with their norm, the levels around them and the attributes of the
    station: one row per station on every side."""
    partial = group_means(around, places)
    ts = F.col("ts")
    return (rows.withColumns({**calendar(ts), "day": ts.cast("date")})
            .join(places, "station_id")
            .join(norm, ["station_id", "dow", "slot_of_day"], "left")
            .join(mean_by(partial, "district", "district_ratio"), ["district", "ts"], "left")
            .join(mean_by(partial, "cluster_id", "cluster_ratio"), ["cluster_id", "ts"], "left")
            .join(neighbour_mean(around, edges).drop("neigh_n"), ["station_id", "ts"], "left")
            .join(days_off.select("day", F.lit(1).alias("is_holiday")), "day", "left"))


def _page_context(rows: DataFrame, places: DataFrame, days_off: DataFrame) -> DataFrame:
    """What all readings of a page share: the station's attributes, the levels of its district
    and cluster by slot of the chunk, and the holidays of the chunk."""
    sums = stage(_group_sums(rows, places), "group_sums")
    at = F.col("_slot") - F.col("_chunk") * F.lit(CHUNK_SLOTS)

    def levels(key: str, name: str) -> DataFrame:
        mean = sums.groupBy(key, "_chunk", "_slot").agg((F.sum("s") / F.sum("n")).alias("_m"))
        return dense(mean, [key, "_chunk"], at, CHUNK_SLOTS, F.col("_m"), name)
    off = days_off.groupBy(F.floor(F.unix_date("day") * F.lit(48) / F.lit(CHUNK_SLOTS)).alias("_chunk")).agg(
        F.collect_set("day").alias("_off"))
    return (pages_of(rows, places).join(levels("district", "_district"), ["district", "_chunk"], "left")
            .join(levels("cluster_id", "_cluster"), ["cluster_id", "_chunk"], "left").join(off, "_chunk", "left"))


def _over_pages(seen: DataFrame, places: DataFrame, norm: DataFrame, edges: DataFrame,
                days_off: DataFrame, spec: Spec) -> DataFrame:
    """Every reading with its time features and all that surrounds it.

    The readings are written once in buckets of (station, chunk) with the rows that
    frames reach over the edge. Windows, group sums, the neighbours' readings and the
    joins all read them there; nothing moves them again. Norms come to the pages of their
    station and meet the narrow readings, before the windows make 40 more columns of them.
    """
    pages = stage_bucketed(with_halo(seen, tf.slot_index(F.col("ts")), *_reach(spec)), "pages", PAGE)
    rows = own(pages)
    ts = F.col("ts")
    usual = pages_of(rows, norm)
    narrow = pages.withColumns({"dow": tf.sunday_weekday(ts), "slot_of_day": tf.slot_of_day(ts)}).join(
        usual, [*PAGE, "dow", "slot_of_day"], "left")
    around = _neighbour_mean(rows, edges).select(*PAGE, "_slot", "neigh_ratio")
    at = (F.col("_slot") - F.col("_chunk") * F.lit(CHUNK_SLOTS)).cast("int")
    out = (own(_with_frames(narrow, spec)).join(around, [*PAGE, "_slot"], "left")
           .join(_page_context(rows, places, days_off), PAGE)
           .withColumns({**calendar(ts), "day": ts.cast("date")}))
    return out.withColumns({
        "district_ratio": F.get("_district", at), "cluster_ratio": F.get("_cluster", at),
        "is_holiday": F.coalesce(F.array_contains("_off", F.col("day")), F.lit(False)).cast("int")})


def feature_matrix(obs: DataFrame, stations: DataFrame, groups: DataFrame, norm: DataFrame,
                   edges: DataFrame, days_off: DataFrame, targets: bool = True,
                   only_at: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """42 model inputs per reading (M6), with targets for training, or only at
    one slot for scoring (M8). Training and scoring share this definition.

    ``groups`` has (station_id, cluster_id). ``keep`` names extra columns of
    ``obs`` to carry along.
    """
    keep = keep or []
    places = stations.join(groups, "station_id").select(
        "station_id", "district", "district_id", "lon", "lat", "capacity", "cluster_id")
    seen = obs.filter(c.ratio.isNotNull())
    spec = _lag_spec() | _rolling_spec()
    if only_at is None:
        rows = _over_pages(seen, stage(places, "places"), norm, edges, days_off,
                           (spec | _lead_spec()) if targets else spec)
    else:
        now = seen.filter(F.col("ts") == only_at)
        rows = _at_one_slot(_at_slot(seen, spec, only_at, keep), now, places, norm, edges, days_off)
        targets = False
    r = c.ratio
    derived = {
        "is_holiday": F.coalesce("is_holiday", F.lit(0)),
        "d1": r - F.col("ratio_lag1"), "d2": r - F.col("ratio_lag2"), "d4": r - F.col("ratio_lag4"),
        "norm_dev": r - F.col("norm_ratio"),
        "neigh_dev": F.col("neigh_ratio") - F.col("district_ratio")}
    return rows.select("station_id", "ts", *keep,
                       *[derived[x].alias(x) if x in derived else x for x in FEATURES],
                       *(TARGETS if targets else []))


def complete_targets(features: DataFrame) -> DataFrame:
    """Rows whose every horizon has an answer (M7)."""
    cond = F.lit(True)
    for h in HORIZONS:
        cond = cond & F.col(f"y_ratio_{h}").isNotNull()
    return features.filter(cond)


def split(features: DataFrame, first: str, last: str) -> DataFrame:
    """Rows of the days first..last with complete targets, never shuffled (M7)."""
    start = F.lit(first).cast("timestamp_ntz")
    stop = F.lit(last).cast("timestamp_ntz") + F.make_dt_interval(F.lit(1))
    return complete_targets(features.filter((F.col("ts") >= start) & (F.col("ts") < stop)))


def by_horizon(features: DataFrame, keep: list[str]) -> DataFrame:
    """One row per reading and horizon (H7), in one pass over the wide rows."""
    per = F.explode(F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.col(f"y_ratio_{h}").alias("y_ratio"),
                 F.col(f"y_bikes_{h}").alias("y_bikes"), F.col(f"y_docks_{h}").alias("y_docks"),
                 F.col(f"bl_lastweek_{h}").alias("lastweek")) for h in HORIZONS])).alias("t")
    return features.select(*keep, per).select(*keep, "t.*")

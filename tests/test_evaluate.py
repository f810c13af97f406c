import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from dockwatch.plans import evaluate as ev, policy as po, reports as rp

T0 = dt.datetime(2024, 1, 1)


def at(i):
    return T0 + dt.timedelta(minutes=30 * i)


def test_events_follow_rows_not_the_clock(spark):
    def rows(s, pairs):
        return [(s, at(i), b, 10) for i, b in pairs]
    data = rows(1, [(0, 0), (1, 0), (2, 5)])                   # starts with the first row
    data += rows(2, [(0, 5), (1, 0), (2, 5)])                  # one-row blip
    data += rows(3, [(0, 5), (1, 0), (9, 0), (10, 5)])         # rows are neighbours across a gap
    data += rows(4, [(0, 5), (1, 0)])                          # last row
    data += rows(5, [(0, 9), (1, 5), (2, 10), (3, 9), (4, 9)])  # full
    df = spark.createDataFrame(data, "station_id long, ts timestamp_ntz, bikes int, docks_total int")
    got = {(r["station_id"], r["ts"], r["kind"]) for r in ev.both_event_starts(df).collect()}
    assert got == {(1, at(0), "empty"), (3, at(1), "empty"), (5, at(2), "full")}
    for kind in ("empty", "full"):
        one = {(r["station_id"], r["ts"], r["kind"]) for r in ev.event_starts(df, kind).collect()}
        assert one == {x for x in got if x[2] == kind}


def test_events_across_chunks_and_long_gaps(spark):
    rng, data = random.Random(8), []
    for s in range(3):
        i = 0
        for _ in range(400):
            i += rng.choice([1, 1, 1, 2, 40, 3000])            # gaps longer than a chunk
            data.append((s, at(i), rng.choice([0, 0, 5, 9, 10]), 10))
    df = spark.createDataFrame(data, "station_id long, ts timestamp_ntz, bikes int, docks_total int")
    want = set()
    for s in range(3):
        mine = sorted(r for r in data if r[0] == s)
        for kind, inside in (("empty", [r[2] <= 1 for r in mine]), ("full", [10 - r[2] <= 1 for r in mine])):
            for j in range(len(mine) - 1):
                if inside[j] and inside[j + 1] and not (j and inside[j - 1]):
                    want.add((s, mine[j][1], kind))
    got = [tuple(r) for r in ev.both_event_starts(df).collect()]
    assert set(got) == want and len(got) == len(want) > 100


def test_leads_take_the_longest_horizon(spark):
    events = spark.createDataFrame([(1, at(10), "empty"), (2, at(10), "empty")], "station_id long, ts timestamp_ntz, kind string")
    probs = spark.createDataFrame(
        [(1, at(9), 30, "empty", 0.9), (1, at(6), 120, "empty", 0.8), (1, at(4), 180, "empty", 0.6),
         (1, at(8), 60, "full", 0.9), (2, at(8), 30, "empty", 0.9)],
        "station_id long, ts timestamp_ntz, horizon int, kind string, proba double")
    lead = {r["station_id"]: r["lead"] for r in ev.event_leads(events, probs, 0.7).collect()}
    assert lead == {1: 120, 2: 0}
    per = {("empty", 180): 0.5}
    assert {r["station_id"]: r["lead"] for r in ev.event_leads(events, probs, per).collect()}[1] == 180


def brute_quality(rows):
    pos = sum(f for _, f in rows)
    neg = len(rows) - pos
    auc = sum((p > q) + 0.5 * (p == q) for p, f in rows if f for q, g in rows if not g) / (pos * neg)
    ap, last = 0.0, 0.0
    for t in sorted({p for p, _ in rows}, reverse=True):
        top = [f for p, f in rows if p >= t]
        recall = sum(top) / pos
        ap += (recall - last) * sum(top) / len(top)
        last = recall
    return ap, auc


def test_ranking_quality_and_thresholds(spark):
    rng = random.Random(5)
    rows = [(h, k, round(rng.random(), 1), rng.random() < 0.4) for h in (30, 60) for k in ("empty", "full") for _ in range(60)]
    df = spark.createDataFrame(rows, "horizon int, kind string, proba double, fact boolean")
    for r in ev.ranking_quality(df).collect():
        want = brute_quality([(p, f) for h, k, p, f in rows if (h, k) == (r["horizon"], r["kind"])])
        assert (r["average_precision"], r["roc_auc"]) == pytest.approx(want)
    for r in ev.best_threshold(df).collect():
        mine = [(p, f) for h, k, p, f in rows if (h, k) == (r["horizon"], r["kind"])]
        scores = []
        for t in ev.THRESHOLDS:
            tp = sum(f for p, f in mine if p >= t)
            fp = sum(not f for p, f in mine if p >= t)
            fn = sum(f for p, f in mine if p < t)
            scores.append((2 * tp / (2 * tp + fp + fn) if tp else 0.0, -t))
        assert (r["f1"], -r["threshold"]) == pytest.approx(max(scores))


def test_nothing_to_find(spark):
    df = spark.createDataFrame([(30, "empty", 0.2, False)], "horizon int, kind string, proba double, fact boolean")
    r = ev.best_threshold(df).first()
    assert (r["threshold"], r["f1"], r["precision"], r["recall"]) == (0.05, 0.0, 0.0, 0.0)
    assert ev.ranking_quality(df).first()["roc_auc"] is None


def policy_rows(n_slots=60, n_stations=30, seed=2):
    rng = random.Random(seed)
    return [(s, at(i), rng.choice([0, 0, 1, 2, 5, 9]), 10, rng.randint(0, 6), round(rng.random(), 2))
            for i in range(n_slots) for s in range(n_stations) if rng.random() < 0.9]


def test_policy_against_brute_force(spark):
    rows = policy_rows()
    df = spark.createDataFrame(rows, "station_id long, ts timestamp_ntz, bikes int, docks_total int, empty_streak int, proba double")
    caps = (1, 5, 10)
    got = {r["capacity"]: r for r in po.policy_coverage(df, caps).collect()}
    empty = {(s, t) for s, t, b, *_ in rows if b <= 1}

    def cover(queue, k):
        out = set()
        for t in {r[1] for r in rows}:
            pool = [r for r in rows if r[1] == t and (r[2] <= 1) == (queue == "rule")]
            pool.sort(key=lambda r: (-(r[4] if queue == "rule" else r[5]), r[0]))
            lead = 1 if queue == "rule" else 2
            out |= {(r[0], t + dt.timedelta(minutes=30 * j)) for r in pool[:k] for j in range(lead, lead + 4)}
        return out
    for k in caps:
        half = max(k // 2, 1)
        assert got[k]["prevent_slots"] == len(empty & cover("prevent", k))
        assert got[k]["rule_slots"] == len(empty & cover("rule", k))
        assert got[k]["hybrid_slots"] == len(empty & (cover("prevent", half) | cover("rule", half)))
        assert got[k]["empty_slots"] == len(empty)
    for p in ("prevent", "rule", "hybrid"):
        assert got[1][f"{p}_slots"] <= got[5][f"{p}_slots"] <= got[10][f"{p}_slots"]


def test_concentration(spark):
    rows = [(s, at(i), 0 if i < s else 5) for s in range(40) for i in range(40)]
    df = spark.createDataFrame(rows, "station_id long, ts timestamp_ntz, bikes int")
    r = po.concentration(df).first()
    total = sum(range(40))
    assert (r["top_stations"], r["top_share"]) == (2, round((39 + 38) / total, 4))
    assert r["mostly_empty_stations"] == 19 and r["empty_slots"] == total


def test_top_picks_limit_before_the_shuffle(spark):
    df = spark.createDataFrame(policy_rows(5), "station_id long, ts timestamp_ntz, bikes int, docks_total int, empty_streak int, proba double")
    plan = po.ranked_picks(df, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_report_document(spark):
    rng = random.Random(3)
    rows = []
    for s in range(5):
        for i in range(40):
            for h in (30, 60, 120, 180):
                b = rng.randint(0, 10)
                rows.append((s, at(i), h, b / 10, b, 10, None, rng.random(), rng.random(), rng.random(),
                             rng.random(), rng.randint(0, 10), rng.randint(0, 10)))
    judged = spark.createDataFrame(rows, (
        "station_id long, ts timestamp_ntz, horizon int, ratio double, bikes int, docks_total int, lastweek double, "
        "pred_ratio double, proba_empty double, proba_full double, y_ratio double, y_bikes int, y_docks int"))
    m = rp.backtest_metrics(judged, 1, {("empty", 60): 0.4}).cache()
    assert {r[0] for r in m.select("section").distinct().collect()} == {
        "level", "ranking", "strict", "operational", "rule", "events_strict", "events_operational"}
    doc = rp.document(m, generated_at="now", stations=5)
    assert doc.count() == 1 and set(doc.first()["sections"]) >= {"level", "rule"}
    h = rp.headline(m).first()
    assert h["mae_bikes_60min"] > 0 and h["n_empty_events"] > 0


def test_stored_table_is_served_while_it_is_new_enough(spark):
    import tempfile
    from dockwatch.plans import reports as rp, served as sd
    from dockwatch.sinks.tables import publish

    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    t = dt.datetime(2024, 1, 1, 8)

    def ask(since):
        return sd.stored_or(spark, f"{root}/x", None, since, lambda: spark.range(1)).count()
    assert ask(None) == 1                                          # nothing stored
    sd.publish_at(spark.range(5), f"{root}/x", F.lit(t))
    assert ask(None) == 5 and ask(t) == 5 and ask(t + dt.timedelta(minutes=30)) == 1
    m = spark.createDataFrame([("level", "model", None, 60, "mae_bikes", 1.5)], rp.LONG)
    publish(m, f"{root}/report")
    assert sd.model_report(spark, f"{root}/report").count() == 1
    assert sd.model_report(spark, f"{root}/report", f"{root}/bands").count() == 1     # no bands yet
    publish(m, f"{root}/bands")
    assert sd.model_report(spark, f"{root}/report", f"{root}/bands").count() == 2
    out = sd.policy_report(spark.createDataFrame([("rule", 5, 0.5)], "policy string, capacity int, share double"),
                           spark.createDataFrame([(7,)], "n int")).collect()
    assert {tuple(r) for r in out} == {("coverage", "rule", "capacity", 5.0), ("coverage", "rule", "share", 0.5),
                                       ("preventable", "all", "n", 7.0)}

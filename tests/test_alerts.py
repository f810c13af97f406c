import datetime as dt

from dockwatch.plans import alerts as al
from dockwatch.schemas import SNAPSHOT

T0 = dt.datetime(2024, 1, 1, 12, 0)


def at(slots):
    return T0 + dt.timedelta(minutes=30 * slots)


def snaps(spark, rows):
    return spark.createDataFrame([(s, at(t), b, d, n) for s, t, b, d, n in rows], SNAPSHOT)


def stations(spark, ids, always=()):
    return spark.createDataFrame(
        [(i, f"S{i}", "D", 1.0, 2.0, 20, None if i % 2 else (i in always)) for i in ids],
        "station_id long, name string, district string, lon double, lat double, capacity_docks int, "
        "always_empty boolean")


def test_episode_lengths(spark):
    rows = []
    rows += [(1, t, 0, 20, 20) for t in range(-11, 1)]                 # empty all along: capped
    rows += [(2, 0, 0, 20, 20), (2, -1, 3, 17, 20)]                    # just began: 30 minutes
    rows += [(3, t, 0, 20, 20) for t in (0, -1, -3)] + [(3, -2, 0, 0, 20), (3, -4, 5, 15, 20)]
    rows += [(4, 0, 2, 2, 4)]                                          # both sides near
    rows += [(5, 0, 20, 0, 20), (5, -2, 19, 1, 20)]                    # full for an hour
    rows += [(6, -1, 0, 20, 20)]                                       # not in the newest slot
    rows += [(7, 0, 0, 0, 20)]                                         # offline now
    rows += [(8, 0, 0, 20, 20)]                                        # first seen empty
    rows += [(10, 0, 0, 20, 20)]                                       # always empty
    out = {r["station_id"]: r for r in al.alerts(snaps(spark, rows), stations(spark, range(1, 11), (10,))).collect()}
    got = {k: (r["kind"], r["duration_min"], r["duration_capped"], r["level"]) for k, r in out.items()}
    assert got == {
        1: ("empty", 330, True, "critical"), 2: ("empty", 30, False, "warning"),
        3: ("empty", 120, False, "critical"), 4: ("near_empty", 0, False, "notice"),
        5: ("full", 60, False, "critical"), 8: ("empty", 0, True, "warning")}


def test_order_and_filters(spark):
    rows = [(2, 0, 0, 9, 9), (2, -1, 3, 6, 9), (4, 0, 0, 9, 9), (4, -4, 1, 8, 9), (6, 0, 1, 8, 9)]
    st = stations(spark, [2, 4, 6])
    assert [r["station_id"] for r in al.alerts(snaps(spark, rows), st).collect()] == [4, 2, 6]
    assert [r["station_id"] for r in al.alerts(snaps(spark, rows), st, level="notice").collect()] == [6]
    assert al.alerts(snaps(spark, rows), st, district="it's").count() == 0


def test_escalations(spark):
    cols = ("station_id long, name string, district string, level string, kind string, duration_min int, "
            "bikes int, docks_avail int, docks_total int, ts timestamp_ntz")

    def round_(levels):
        return spark.createDataFrame([(i, "n", "d", v, "empty", 10 * i, 0, 9, 9, T0) for i, v in levels.items()], cols)

    def step(levels, seen):
        ev, state = al.escalations(round_(levels), seen)
        return [(r["station_id"], r["prev_level"]) for r in ev.collect()], state

    ev, seen = step({1: "critical", 2: "warning", 3: "notice"}, None)
    assert ev == []                                   # the first round only records
    assert {tuple(r) for r in seen.collect()} == {(1, "critical"), (2, "warning")}
    ev, seen = step({1: "critical", 2: "critical", 3: "warning"}, seen)
    assert ev == [(2, "warning"), (3, None)]          # rose, appeared; unchanged stays quiet
    ev, seen = step({2: "warning"}, seen)
    assert ev == []                                   # fell, others cleared
    ev, seen = step({1: "warning", 2: "critical"}, seen)
    assert ev == [(2, "warning"), (1, None)]          # rises again from the lower level; returns
    ev, seen = step({i: "warning" for i in range(10, 130)}, seen)
    assert len(ev) == 120 and seen.count() == 120     # a city-wide outage arrives whole

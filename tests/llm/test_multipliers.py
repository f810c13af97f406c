"""Multipliers of the mix on sizes that no fixture text has."""

import pytest
from pyspark.sql import functions as F

from dockwatch.llm import mixing


def test_multipliers_take_a_text_of_more_than_a_million_words(spark):
    rows = [("a", 10, 100_000), ("a", 1_500_000, 1), ("a", 2_000_000_000, 1), ("b", 100, 9_000_000)]
    hist = spark.createDataFrame(rows, "source string, size long, n long")
    goal = mixing.targets(hist.groupBy("source").agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_docs")))
    state = mixing.multipliers(hist, goal)
    got = {r["source"]: r for r in state.collect()}
    assert all(r["off"] < mixing.TOLERANCE for r in got.values())
    taken = mixing._classes(hist, state, mixing.CAP).groupBy("source").agg(
        F.sum(F.col("n") * F.col("size") * (F.col("rate") / mixing.UNIT)).alias("t"))
    for r in taken.collect():
        assert r["t"] == pytest.approx(got[r["source"]]["target"], rel=1e-5)


def _dealt(classes, target, cap):
    """Copies of each size, dealt tier by tier from the top in plain whole numbers."""
    taken, out = 0, {}
    for t in sorted({int(s).bit_length() for s, _, _ in classes}, reverse=True):
        rest = [c for c in classes if int(c[0]).bit_length() <= t]
        z, e = sum(s * n for s, n, _ in rest), sum(s * n * r for s, n, r in rest)
        shift, upto = round(((target - taken) * mixing.UNIT - float(e)) / z), 0
        for s, n, r in sorted(rest, reverse=True):
            if int(s).bit_length() == t:
                last, upto = upto, upto + n * max(0, min(cap * mixing.UNIT, r + shift))
                whole = [(x + mixing.UNIT // 2) // mixing.UNIT for x in (last, upto)]
                out[s] = min(n * cap, whole[1] - whole[0])
                taken += out[s] * s
    return out


def test_copies_take_as_many_jobs_for_many_tiers_as_for_few(spark):
    sc, jobs = spark.sparkContext, {}
    for name, sizes in (("few", [0, 4, 5, 6, 7]), ("many", [0, *(2 ** k + d for k in range(1, 15) for d in (0, 1))])):
        rows = [(s, size, 1 + (size * k) % 9) for k, s in enumerate(["a", "b", None], 1) for size in sizes]
        hist = spark.createDataFrame(rows, "source string, size long, n long")
        goal = mixing.targets(hist.groupBy("source").agg(
            F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_docs")))
        state = mixing.multipliers(hist, goal)
        sc.setJobGroup(name, name)
        got = {(r["source"], r["size"]): r["copies"] for r in mixing.class_copies(hist, state).collect()}
        jobs[name] = len(sc.statusTracker().getJobIdsForGroup(name))
        sc.setLocalProperty("spark.jobGroup.id", None)
        rates = mixing._classes(hist, state, mixing.CAP).filter("size > 0").collect()
        want = {(s, size): k for s in ("a", "b", None) for size, k in _dealt(
            [(r["size"], r["n"], r["rate"]) for r in rates if r["source"] == s],
            next(r["target"] for r in rates if r["source"] == s), mixing.CAP).items()}
        assert got == want
    assert jobs["many"] <= jobs["few"] + 2

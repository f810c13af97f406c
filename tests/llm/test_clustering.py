"""Clustering in whole numbers against brute force, on odd rows and on ties."""

import hashlib
import math

import numpy as np
import pytest

from dockwatch.llm import clustering as cl

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance string, z string"


def _brute(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v, *_ in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    c = [list(v) for _, v in order[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((dist(v, x), j) for j, x in enumerate(c))
    for _ in range(rounds):
        who = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), w in zip(kept, who) if w == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    got = [(i, *near(v)) for i, v in kept]
    per = {j: sum(d for _, d, w in got if w == j) for j in range(len(c))}
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i, w, d, per[w], sum(per.values()), sha[w]) for i, d, w in got), key=str)


def _rows(n, grid):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(5, 64))
    rows = [(i, np.round(centres[i % 5] + rng.normal(size=64) * 0.3, grid).tolist(), 0, "x", None, "y") for i in range(n)]
    rows += [rows[0], rows[0], rows[3]]                                       # repeated rows
    rows += [(900, None, *[None] * 4), (901, [], *[None] * 4), (902, [1.0] * 63, *[None] * 4),
             (903, [float("nan")] * 64, *[None] * 4), (904, [None] + [1.0] * 63, *[None] * 4),
             (905, [float("inf")] + [1.0] * 63, *[None] * 4), (None, [0.25] * 64, *[None] * 4)]
    return rows


@pytest.mark.parametrize("n, grid", [(150, 6), (200, 0), (5, 2)])
def test_matches_brute_force(spark, n, grid):
    rows = _rows(n, grid)
    got = cl.clusters(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == _brute(rows)


def test_tree_finds_ties_and_equal_centroids():
    rng = np.random.default_rng(1)
    for k in (1, 2, 3, 16, 40):
        c = rng.integers(-2, 3, (k, 3))
        z = rng.integers(-3, 4, (500, 3))
        d = ((z[:, None] - c[None]) ** 2).sum(axis=2)
        who, best = cl.VantageTree.build(c).nearest(z)
        assert (who == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_tree_on_the_largest_numbers():
    top = cl.LIMIT - 1
    c = np.array([[top] * 64, [-top] * 64, [top - 1] * 64])
    z = np.array([[-top] * 64, [top] * 64, [top - 1] * 63 + [top]])
    who, best = cl.VantageTree.build(c).nearest(z)
    assert who.tolist() == [1, 0, 2] and best.tolist() == [0, 0, 1]


def test_too_large_components_and_empty_table(spark):
    rows = [(1, [1e300] * 64), (2, [1.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in cl.clusters(df).collect()] == [2]
    assert cl.clusters(df.limit(0)).collect() == []

"""Centroid clustering of vectors in whole numbers, with a vantage-point tree over the centroids.

Each round builds a tree over the centroids, broadcasts it (k nodes, k x dims numbers)
and assigns every vector by a best-first search of its own: of the nodes a vector has
not visited it takes the one with the smallest lower bound, as long as that bound does
not exceed the distance to the best centroid so far. A bound equal to it is still
visited, so ties are seen and go to the smaller number. Bounds are doubles with a
margin for rounding; the distances that decide are exact whole numbers. A batch of
vectors is searched together, each with its own frontier.

New centroids are floor(sum / count) of each component, from whole sums: tasks add up
their batches, Spark adds those, and only k x dims sums reach the driver.

Defined cases: vectors that are null, have another number of components, or hold null,
non-finite or too large ones (scaled, LIMIT or beyond: their squares do not fit a long)
take no part; repeated rows are vectors each; rows without id are clustered, but start
no centroid unless others are too few; fewer vectors than k give as many centroids;
equal starting vectors are both kept, the larger number stays empty; sums of distances
beyond a long are null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from dockwatch.llm.common import table
from dockwatch.llm.vectors import is_finite, matrix
from dockwatch.session import stage

K = 16
ROUNDS = 3
DIMS = 64
SCALE = 64
SEED = 1
#: Scaled components stay below this, so a squared distance fits a long.
LIMIT = 1 << 27
#: Share by which lower bounds are reduced against rounding.
MARGIN = 1e-12


@dataclass
class VantageTree:
    """Nodes in arrays: a centroid each, and for both children the range of distances from it."""

    centroids: np.ndarray       # k x dims
    point: np.ndarray           # centroid of each node
    child: np.ndarray           # nodes x 2, -1 for none
    low: np.ndarray             # nodes x 2
    high: np.ndarray

    @classmethod
    def build(cls, centroids: np.ndarray) -> VantageTree:
        k = len(centroids)
        tree = cls(centroids, np.zeros(k, int), np.full((k, 2), -1), np.zeros((k, 2)), np.zeros((k, 2)))
        waiting, node = [(np.arange(k), -1, 0)], 0
        while waiting:
            some, parent, side = waiting.pop()
            if parent >= 0:
                tree.child[parent, side] = node
            tree.point[node] = some[0]
            rest = some[1:]
            d = np.sqrt(((centroids[rest] - centroids[some[0]]) ** 2).sum(axis=1).astype(np.float64))
            order = np.argsort(d, kind="stable")
            half = (len(rest) + 1) // 2
            for side, part in enumerate((order[:half], order[half:])):
                if len(part):
                    tree.low[node, side], tree.high[node, side] = d[part].min(), d[part].max()
                    waiting.append((np.sort(rest[part]), node, side))
            node += 1
        return tree

    def nearest(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of each row, and its squared distance."""
        n, nodes = len(z), len(self.point)
        bound = np.full((n, nodes), np.inf)
        bound[:, 0] = 0.0
        best = np.full(n, np.iinfo(np.int64).max)
        who = np.full(n, nodes, dtype=np.int64)
        rows = np.arange(n)
        while len(rows):
            node = bound[rows, :].argmin(axis=1)
            least = bound[rows, node]
            # Inclusive: a centroid at exactly the best distance may have a smaller number.
            go = np.isfinite(least) & (least <= np.sqrt(best[rows].astype(np.float64)))
            rows, node, least = rows[go], node[go], least[go]
            at = self.point[node]
            d2 = ((z[rows] - self.centroids[at]) ** 2).sum(axis=1)
            nearer = (d2 < best[rows]) | ((d2 == best[rows]) & (at < who[rows]))
            best[rows[nearer]], who[rows[nearer]] = d2[nearer], at[nearer]
            bound[rows, node] = np.inf
            d = np.sqrt(d2.astype(np.float64))
            for side in (0, 1):
                has = self.child[node, side] >= 0
                r, m = rows[has], node[has]
                low, high, dist = self.low[m, side], self.high[m, side], d[has]
                gap = np.maximum(low - dist, dist - high) - MARGIN * (high + dist)
                bound[r, self.child[m, side]] = np.maximum(least[has], gap)
        return who, best


def clean(embeddings: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and whole-number vector ``z`` of all rows that take part."""
    scaled = F.transform(F.col("embedding"), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    fits = F.forall(F.col("embedding"),
                    lambda x: F.abs(F.lit(float(scale)) * x.cast("double")) < F.lit(float(LIMIT)))
    return embeddings.filter(is_finite("embedding") & (F.size("embedding") == dims) & fits).select(
        F.col("vec_id").cast("long").alias("vec_id"), scaled.cast("array<long>").alias("z"))


def starts(vectors: DataFrame, k: int, seed: int = SEED) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of ``seed:vec_id``, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.select("z", key.alias("_h")).orderBy(F.asc_nulls_last("_h"), "z").limit(k)
    return np.array([r["z"] for r in first.collect()], dtype=np.int64)


def _sums(tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = matrix(b.column("z"), dtype=np.int64)
            who, _ = tree.value.nearest(z)
            for c in np.unique(who):
                mine = z[who == c]
                yield pa.RecordBatch.from_pydict({
                    "cluster": pa.array([c], pa.int32()), "n": pa.array([len(mine)], pa.int64()),
                    "sums": pa.array([mine.sum(axis=0)], pa.list_(pa.int64()))})
    return run


def _assign(tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, d2 = tree.value.nearest(matrix(b.column("z"), dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), pa.array(who, pa.int32()), pa.array(d2, pa.int64())],
                names=["vec_id", "cluster", "distance"])
    return run


def next_centroids(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floor of the mean of each centroid's vectors; centroids without vectors stay."""
    tree = vectors.sparkSession.sparkContext.broadcast(VantageTree.build(centroids))
    part = vectors.select("z").mapInArrow(_sums(tree), "cluster int, n long, sums array<long>")
    sums = (part.select("cluster", "n", F.posexplode("sums").alias("pos", "s"))
            .groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(30,0)")).alias("s")))
    out = centroids.copy()
    for r in sums.collect():                    # k x dims rows
        out[r["cluster"], r["pos"]] = int(r["s"]) // r["n"]
    return out


def fit(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Centroids (k x dims) of ``vectors`` (vec_id, z) after ``rounds`` rounds."""
    centroids = starts(vectors, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = next_centroids(vectors, centroids)
    return centroids


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance of every row of ``vectors``."""
    tree = vectors.sparkSession.sparkContext.broadcast(VantageTree.build(centroids)) if len(centroids) else None
    return vectors.select("vec_id", "z").mapInArrow(_assign(tree), "vec_id long, cluster int, distance long")


def clusters(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """Every vector with its cluster, the squared distance and the inertia of its cluster and of all."""
    spark = embeddings.sparkSession
    vectors = stage(clean(embeddings), "cluster-vectors")
    centroids = fit(vectors, k, rounds, seed)
    rows = stage(assigned(vectors, centroids), "cluster-rows")
    digest = spark.createDataFrame(
        [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)],
        "cluster int, centroid_sha256 string")
    whole = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("_s"))
    # At most k rows each: one per cluster.
    per = whole.join(digest, "cluster").select(
        "cluster", F.expr("try_cast(_s as bigint)").alias("cluster_inertia"),
        F.expr("try_cast(sum(_s) over () as bigint)").alias("inertia"), "centroid_sha256")
    return rows.join(F.broadcast(per), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors in 16 clusters after three rounds."""
    return clusters(table(spark, sf_dir, "embeddings"))


def oracle() -> str:
    """The same rounds as SQL: one row per vector and component."""
    def assign(i: int) -> str:
        return f"""
         d{i} AS (SELECT v.vec_id, c.c, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{i} c USING (pos) GROUP BY ALL),
         a{i} AS MATERIALIZED (SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{i} GROUP BY vec_id),"""

    def move(i: int) -> str:
        return f"""
         m{i} AS (SELECT a.c, v.pos, sum(v.x)::BIGINT AS s, count(*) AS n FROM v JOIN a{i} a USING (vec_id) GROUP BY ALL),
         c{i + 1} AS MATERIALIZED (
             SELECT c, pos, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c{i}.x) AS x
             FROM c{i} LEFT JOIN m{i} m USING (c, pos)),"""
    rounds = "".join(assign(i) + move(i) for i in range(ROUNDS))
    return f"""
    WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos
               FROM embeddings WHERE len(embedding) = {DIMS}),
         bad AS (SELECT DISTINCT vec_id FROM e WHERE x IS NULL OR NOT isfinite(x)),
         v AS MATERIALIZED (SELECT vec_id, pos, floor({SCALE} * x)::BIGINT AS x FROM e ANTI JOIN bad USING (vec_id)),
         s AS (SELECT vec_id, (row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1)::INTEGER AS c
               FROM (SELECT DISTINCT vec_id FROM v) ORDER BY c LIMIT {K}),
         c0 AS MATERIALIZED (SELECT s.c, v.pos, v.x FROM v JOIN s USING (vec_id)),{rounds}{assign(ROUNDS)}
         g AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY pos)) AS h FROM c{ROUNDS} GROUP BY c)
    SELECT a.vec_id, a.c AS cluster, a.d::BIGINT AS distance,
           (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
           (sum(a.d) OVER ())::BIGINT AS inertia, g.h AS centroid_sha256
    FROM a{ROUNDS} a JOIN g USING (c)"""

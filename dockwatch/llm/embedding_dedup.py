"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with cosine of at least c lie within eps = sqrt(2 - 2c) of each
other. All distinct vectors are projected onto a few leading principal
directions, which never lengthens a distance, and sorted by label and by the
cells of a grid of width eps on those directions. The sorted sequence is cut
into blocks. Pairs of intervals of the sequence are joined from the top: two
intervals whose boxes are farther apart than eps, or whose labels differ, are
skipped with all they hold, the others are cut in FAN parts each, until blocks
are left whose vectors are compared in double precision.

The directions come from a bounded sample; they only steer what can be skipped,
so the result is exact whatever the sample. A pair of blocks gives back sums of
links and the local component of each vector, at most two rows for each vector
in it, never its pairs. Equal vectors are one entry with a weight.

Defined cases: vectors that are null, zero or hold null or non-finite
components, and rows without label, link with nothing; shorter vectors count as
filled with zeros; rows that repeat are vectors of their own and link with each
other; rows without vec_id link too but never name a component; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from dockwatch.llm.common import table
from dockwatch.llm.components import connected_components
from dockwatch.llm.vectors import is_finite, matrix, same_width
from dockwatch.operators.ordering import numbered
from dockwatch.session import stage

COSINE = 0.98
#: Leading principal directions that the grid uses.
DIRECTIONS = 6
#: Vectors in a block, intervals in an interval, intervals at the top.
BLOCK, FAN, TOP = 256, 8, 64
#: Vectors that the directions are fitted on.
SAMPLE = 4096
SLACK = 1e-9


def _unit(m: np.ndarray) -> np.ndarray:
    scale = np.abs(m).max(axis=1, keepdims=True, initial=0)
    m = m / np.where(scale > 0, scale, 1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def principal(vectors: DataFrame) -> np.ndarray:
    """Leading directions of a sample that is the same in every run, one per column."""
    rows = vectors.orderBy(F.xxhash64("embedding"), "first_id").limit(SAMPLE).select("embedding").collect()
    width = vectors.agg(F.max(F.size("embedding"))).first()[0] or 1
    m = np.zeros((max(1, len(rows)), width))
    for i, r in enumerate(rows):
        m[i, :len(r[0])] = r[0]
    _, _, vt = np.linalg.svd(_unit(m) - _unit(m).mean(axis=0), full_matrices=True)
    return vt[:DIRECTIONS].T


def _project(directions: np.ndarray):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def project(vecs: pd.Series) -> pd.Series:
        width = directions.shape[0]
        m = np.zeros((len(vecs), width))
        for i, v in enumerate(vecs):
            m[i, :len(v)] = v
        return pd.Series(list(_unit(m) @ directions))
    return project


def _boxes(rows: DataFrame, key: Column, lo: list[str], hi: list[str], label_lo: str, label_hi: str,
           n: int) -> DataFrame:
    return rows.groupBy(key.alias("id")).agg(
        *[F.min(lo[d]).alias(f"l{d}") for d in range(n)], *[F.max(hi[d]).alias(f"h{d}") for d in range(n)],
        F.min(label_lo).alias("label_lo"), F.max(label_hi).alias("label_hi"))


def _near(n: int, eps: float) -> Column:
    """True unless the boxes of i and j are provably more than eps apart or share no label."""
    gap = F.lit(0.0)
    for d in range(n):
        x = F.greatest(F.lit(0.0), F.col(f"j.l{d}") - F.col(f"i.h{d}"), F.col(f"i.l{d}") - F.col(f"j.h{d}"))
        gap = gap + x * x
    return ((gap <= eps * eps + SLACK) & (F.col("i.label_lo") <= F.col("j.label_hi"))
            & (F.col("j.label_lo") <= F.col("i.label_hi")))


def interval_join(boxes: DataFrame, n_blocks: int, n: int, eps: float) -> DataFrame:
    """Pairs (i, j), i <= j, of blocks that may hold vectors within eps."""
    levels, count = [boxes], n_blocks
    while count > TOP:
        lo, hi = [f"l{d}" for d in range(n)], [f"h{d}" for d in range(n)]
        levels.append(stage(_boxes(levels[-1], F.floor(F.col("id") / FAN).cast("long"), lo, hi,
                                   "label_lo", "label_hi", n), "ego-level"))
        count = -(-count // FAN)
    pairs = levels[-1].select(F.col("id").alias("a"), F.explode(
        F.sequence(F.col("id"), F.lit(max(0, count - 1)).cast("long"))).alias("b"))
    top = levels[-1]
    pairs = (pairs.join(top.alias("i"), F.col("a") == F.col("i.id"))
             .join(top.alias("j"), F.col("b") == F.col("j.id")).filter(_near(n, eps)).select("a", "b"))
    for level in reversed(levels[:-1]):
        kids = level.withColumn("up", F.floor(F.col("id") / FAN).cast("long"))
        pairs = (stage(pairs, "ego-pairs").join(kids.alias("i"), F.col("a") == F.col("i.up"))
                 .join(kids.alias("j"), F.col("b") == F.col("j.up"))
                 .filter((F.col("i.id") <= F.col("j.id")) & _near(n, eps))
                 .select(F.col("i.id").alias("a"), F.col("j.id").alias("b")))
    return pairs


def _compare(cosine: float):
    def members(rows: pa.Array) -> tuple:
        get = lambda f: rows.field(f).to_numpy(zero_copy_only=False)
        return get("pos"), get("code"), get("weight"), _unit(matrix(rows.field("embedding")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a = members(batch.column("arows")[i].values)
                same = batch.column("a")[i].as_py() == batch.column("b")[i].as_py()
                b = a if same else members(batch.column("brows")[i].values)
                x, y = same_width(a[3], b[3])
                hit = (x @ y.T >= cosine) & (a[1][:, None] == b[1][None, :])
                if same:
                    np.fill_diagonal(hit, False)
                if not hit.any():
                    continue
                # The smallest position that each vector reaches inside this pair of blocks.
                big = np.iinfo(np.int64).max
                ra, rb = a[0].copy(), b[0].copy()
                while True:
                    na = np.minimum(ra, np.where(hit, rb[None, :], big).min(axis=1))
                    nb = np.minimum(rb, np.where(hit, na[:, None], big).min(axis=0))
                    if same:
                        na = nb = np.minimum(na, nb)
                    if (na == ra).all() and (nb == rb).all():
                        break
                    ra, rb = na, nb
                out = [(a[0], hit @ b[2], ra, hit.any(axis=1))]
                if not same:
                    out.append((b[0], a[2] @ hit, rb, hit.any(axis=0)))
                pos, links, root = (np.concatenate([o[f][o[3]] for o in out]) for f in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in (pos, links, root)],
                                                 names=["pos", "links", "root"])
    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    eps = float(np.sqrt(2 - 2 * cosine))
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    good = is_finite("embedding") & F.col("label").isNotNull() & F.coalesce(
        F.exists(F.col("embedding"), lambda x: x != 0), F.lit(False))
    # The number of a vector's distinct twin: rows are grouped by value.
    distinct = stage(v.filter(good).groupBy("label", "embedding").agg(
        F.count("*").alias("weight"), F.min("vec_id").alias("first_id")), "ego-distinct")
    directions = principal(distinct)
    n = directions.shape[1]
    p = distinct.withColumn("p", _project(directions)("embedding"))
    p = p.select("*", *[F.col("p")[d].alias(f"p{d}") for d in range(n)]).drop("p")
    cells = [F.floor(F.col(f"p{d}") / eps) for d in range(n)]
    seq = numbered(p, [F.col("label"), *cells, F.xxhash64("embedding"), F.col("first_id")], "pos")
    seq = stage(seq.withColumn("block", F.floor((F.col("pos") - 1) / BLOCK).cast("long")), "ego-sequence")
    ps = [f"p{d}" for d in range(n)]
    boxes = stage(_boxes(seq, F.col("block"), ps, ps, "label", "label", n), "ego-boxes")
    pairs = stage(interval_join(boxes, boxes.count(), n, eps), "ego-pairs")
    rows = stage(seq.groupBy("block").agg(F.collect_list(F.struct(
        "pos", F.xxhash64("label").alias("code"), "weight", "embedding")).alias("rows")), "ego-blocks")
    joined = (pairs.join(rows.select(F.col("block").alias("a"), F.col("rows").alias("arows")), "a")
              .join(rows.select(F.col("block").alias("b"), F.col("rows").alias("brows")), "b"))
    found = stage(joined.mapInArrow(_compare(cosine), "pos long, links long, root long"), "ego-links")
    links = found.groupBy("pos").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("pos").alias("a"), F.col("root").alias("b")))
    linked = seq.select("pos", "first_id").join(links, "pos").join(
        roots.withColumnRenamed("node", "pos"), "pos")
    named = linked.groupBy("root").agg(F.min("first_id").alias("component"))
    linked = linked.join(named, "root").select("pos", "links", "component")
    classes = seq.select("label", "embedding", "pos", "weight", "first_id").join(linked, "pos", "left")
    classes = stage(classes.select(
        "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "first_id").alias("component_id")), "ego-classes")
    ours = v.filter(good).join(classes, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = v.filter(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                  F.col("vec_id").alias("component_id"))
    return ours.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors with links and component."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))

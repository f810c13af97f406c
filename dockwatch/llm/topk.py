"""Exact top-k search by inner product, with a three-phase uniform threshold.

The components of all vectors are cut into LISTS parts; a score is the sum of
one partial score per part. Rows lie in shards by a hash of their id, queries in
blocks, and every (query block, shard) is one piece of work of bounded size.

1. Each shard gathers, for each query, the heads of its partial score lists with
   their whole scores, and the largest partial score of each list.
2. The k-th best of the gathered scores is a safe cutoff of the query: the answer
   scores no less. It goes back to the shards with the largest partial scores. A
   row that reaches the cutoff must, in one list, lie within slack / LISTS of the
   largest partial score, where slack is what the sum of those exceeds the cutoff
   by. The entries that do are sufficient.
3. Their remaining partial scores are added exactly; those below the cutoff go,
   and the best k of each query are taken.

Scores are whole numbers, so the result has no rounding.

Defined cases: rows without id, and vectors that are null or hold null or
non-finite components, take no part; rows that repeat an id are rows of their own:
each that meets the condition is a query, and each but the query's own row is a
candidate; shorter vectors are filled with zeros; ties go to the smaller id; a
query with fewer than k candidates gets them all; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dockwatch.llm.common import table
from dockwatch.llm.vectors import is_finite, matrix, same_width
from dockwatch.operators.ordering import top_per_group
from dockwatch.session import stage

K = 5
LISTS = 2
SHARD_ROWS = 4096
BLOCK_QUERIES = 1024
EVERY = 50
SCALE = 256


def _parts(q: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """Partial scores of each list, exact whole numbers."""
    q, c = same_width(q, c)
    # Products of doubles are exact while all sums stay below 2^53.
    small = q.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) < 2.0 ** 53
    kind = np.float64 if small else np.int64
    cut = np.array_split(np.arange(q.shape[1]), LISTS)
    return [(q[:, d].astype(kind) @ c[:, d].astype(kind).T).astype(np.int64) for d in cut]


_LOW = np.int64(-(1 << 62))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties to the smaller id."""
    k = min(k, len(scores))
    if k == 0:
        return np.zeros(0, dtype=np.int64)
    bar = np.partition(scores, len(scores) - k)[len(scores) - k]
    near = np.flatnonzero(scores >= bar)
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def _column(rows: pa.StructArray, name: str) -> np.ndarray:
    return rows.field(name).to_numpy(zero_copy_only=False)


def _cells(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Queries, ids of the candidates and the partial scores of each cell; a query's own row scores lowest."""
    for i in range(batch.num_rows):
        q, c = batch.column("qrows")[i].values, batch.column("crows")[i].values
        parts = _parts(matrix(q.field("z"), dtype=np.int64), matrix(c.field("z"), dtype=np.int64))
        own = _column(q, "row")[:, None] == _column(c, "row")[None, :]
        for p in parts:
            p[own] = _LOW // LISTS
        yield q, _column(c, "vec_id"), parts, own


def _gather(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, ci, parts, own in _cells(batch):
                scores = []
                for i in range(len(q)):
                    heads = np.unique(np.concatenate([_best(p[i], ci, k) for p in parts]))
                    heads = heads[~own[i, heads]]
                    whole = sum(p[i, heads] for p in parts)
                    scores.append(whole[_best(whole, ci[heads], k)].tolist())
                yield pa.RecordBatch.from_pydict({
                    "row": pa.array(_column(q, "row"), pa.int64()),
                    "scores": pa.array(scores, pa.list_(pa.int64())),
                    **{f"top{b}": pa.array(p.max(axis=1), pa.int64()) for b, p in enumerate(parts)}})
    return run


def _collect(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, ci, parts, own in _cells(batch):
                cut = _column(q, "cutoff").astype(np.int64)
                tops = [_column(q, f"top{b}") for b in range(LISTS)]
                slack = sum(tops) - cut
                enough = np.zeros(parts[0].shape, dtype=bool)
                for p, t in zip(parts, tops):
                    enough |= LISTS * (t[:, None] - p) <= slack[:, None]
                enough &= ~own
                rows, qi, out = _column(q, "row"), _column(q, "vec_id"), ([], [], [], [])
                for i in np.flatnonzero(enough.any(axis=1)):
                    at = np.flatnonzero(enough[i])
                    whole = sum(p[i, at] for p in parts)
                    keep = whole >= cut[i]
                    at, whole = at[keep], whole[keep]
                    top = _best(whole, ci[at], k)
                    for x, values in zip(out, (np.full(len(top), rows[i]), np.full(len(top), qi[i]),
                                               ci[at][top], whole[top])):
                        x.append(values)
                if out[0]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(x), pa.int64()) for x in out],
                        names=["row", "query_id", "vec_id", "score"])
    return run


def whole_numbers(vec: str) -> Column:
    """floor(SCALE * x) of each component, x as double."""
    return F.transform(F.col(vec), lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("bigint"))


def _grid(queries: DataFrame, n_shards: int, shards: DataFrame) -> DataFrame:
    cells = queries.select("block", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"))
    return cells.join(shards, "shard").join(queries, "block").select("qrows", "crows")


def top_k(vectors: DataFrame, queries: Column, k: int = K) -> DataFrame:
    """The ``k`` best rows of ``vectors`` (vec_id, z) for each row that meets ``queries``."""
    # The number of a row is fixed by writing it.
    v = stage(vectors.withColumn("row", F.monotonically_increasing_id()), "topk-vectors")
    q = v.filter(queries)
    n, nq = v.count(), q.count()
    n_shards = max(1, -(-n // SHARD_ROWS))
    n_blocks = max(1, -(-nq // BLOCK_QUERIES))
    shards = v.groupBy(F.pmod(F.xxhash64("row"), F.lit(n_shards)).cast("int").alias("shard")).agg(
        F.collect_list(F.struct("row", "vec_id", "z")).alias("crows"))
    shards = stage(shards, "topk-shards")
    block = F.pmod(F.xxhash64(F.lit("block"), F.col("row")), F.lit(n_blocks)).cast("int").alias("block")
    asked = q.groupBy(block).agg(F.collect_list(F.struct("row", "vec_id", "z")).alias("qrows"))
    tops = [f"top{b}" for b in range(LISTS)]
    heads = stage(_grid(asked, n_shards, shards).mapInArrow(
        _gather(k), "row long, scores array<long>, " + ", ".join(f"{t} long" for t in tops)), "topk-heads")
    best = top_per_group(heads.select("row", F.explode("scores").alias("score")), ["row"], [F.desc("score")], k)
    cutoff = best.groupBy("row").agg(F.when(F.count("*") >= k, F.min("score")).alias("cutoff"))
    cut = heads.groupBy("row").agg(*[F.max(t).alias(t) for t in tops]).join(cutoff, "row", "left")
    # Fewer than k scores seen anywhere: every row may belong to the answer.
    cut = cut.withColumn("cutoff", F.coalesce("cutoff", F.lit(int(_LOW) // 4).cast("long")))
    told = q.join(cut, "row").groupBy(block).agg(
        F.collect_list(F.struct("row", "vec_id", "z", "cutoff", *tops)).alias("qrows"))
    entries = _grid(stage(told, "topk-cutoffs"), n_shards, shards).mapInArrow(
        _collect(k), "row long, query_id long, vec_id long, score long")
    return top_per_group(entries, ["row"], [F.desc("score"), F.col("vec_id")], k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def clean(embeddings: DataFrame) -> DataFrame:
    """vec_id and whole-number vector ``z`` of all rows that take part."""
    return embeddings.filter(F.col("vec_id").isNotNull() & is_finite("embedding")).select(
        F.col("vec_id").cast("long").alias("vec_id"), whole_numbers("embedding").alias("z"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for every 50th vector."""
    return top_k(clean(table(spark, sf_dir, "embeddings")), F.col("vec_id") % EVERY == 0)


ORACLE = f"""
    WITH r AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
         e AS (SELECT r, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM r),
         bad AS (SELECT DISTINCT r FROM e WHERE x IS NULL OR NOT isfinite(x)),
         v AS MATERIALIZED (SELECT r, vec_id, pos, floor({SCALE} * x)::BIGINT AS z FROM e ANTI JOIN bad USING (r)),
         s AS (SELECT q.r, q.vec_id AS query_id, c.r AS other, c.vec_id, sum(q.z * c.z)::BIGINT AS score
               FROM v q JOIN v c ON q.pos = c.pos AND q.r <> c.r WHERE q.vec_id % {EVERY} = 0 GROUP BY ALL),
         o AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank
               FROM s)
    SELECT query_id, rank, vec_id, score FROM o WHERE rank <= {K}"""

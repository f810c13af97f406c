"""Near-duplicate documents by SimHash and multi-index hashing.

A fingerprint has 64 bits; bit i is set if it is set in more than half of the
hashes of the text's 3-word shingles. Two documents link if their fingerprints
differ in at most RADIUS bits. To find all such pairs without comparing all
pairs, a fingerprint is cut into SEGMENTS segments: one of them differs in at
most RADIUS // SEGMENTS bits, so each fingerprint looks up, for every segment,
all values of the small Hamming ball around its own value in the table of
segment values, and the whole distance of what it meets is verified.

Equal fingerprints are one entry, so a group of exact copies costs one look-up
however large it is. Links are between different fingerprints only; components
run over those links (see ``components``).

Defined cases: null and empty texts have fingerprint 0 and link like any other;
fewer than three words are one shingle; rows that repeat get equal rows; a
null doc_id links as others do and never names a component unless no member
has an id (then component_id is null); an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from dockwatch.llm.common import first_of_repeats, keyed, table, text_key
from dockwatch.llm.components import connected_components
from dockwatch.session import stage

BITS = 64
RADIUS = 3
SEGMENTS = 2
SHINGLE = 3
#: Hashes counted at a time, so that a very long text needs little memory.
CHUNK = 1 << 15

_hash = xxhash.xxh64_intdigest


def text_fingerprint(text: str | None) -> int:
    """The fingerprint of one text as an unsigned number."""
    words = (text or "").encode("utf-8").lower().split()    # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, CHUNK):
        w = words[at:min(n, at + CHUNK) + SHINGLE - 1]
        if len(words) < SHINGLE:
            hashes = [_hash(b" ".join(words), 42)]
        else:
            hashes = [_hash(b"%b %b %b" % run, 42) for run in zip(w, w[1:], w[2:])]
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, BITS // 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


@F.pandas_udf(T.LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    """Fingerprints as signed numbers of 64 bits."""
    return pd.Series(np.array([text_fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def ball(width: int, radius: int) -> list[int]:
    """All numbers of ``width`` bits with at most ``radius`` bits set."""
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def _segments(fp: Column) -> list[tuple[int, Column]]:
    width = BITS // SEGMENTS
    return [(i, F.shiftrightunsigned(fp, i * width).bitwiseAND(F.lit((1 << width) - 1)))
            for i in range(SEGMENTS)]


def links(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs a < b of distinct ``fp`` that differ in at most ``radius`` bits."""
    width = BITS // SEGMENTS
    masks = F.array(*[F.lit(m).cast("long") for m in ball(width, radius // SEGMENTS)])
    entry = F.array(*[F.struct(F.lit(i).alias("seg"), v.alias("key")) for i, v in _segments(F.col("fp"))])
    rows = fingerprints.select("fp", F.explode(entry).alias("e"))
    stored = rows.select(F.col("fp").alias("b"), "e.seg", "e.key")
    asked = rows.select(F.col("fp").alias("a"), "e.seg", F.col("e.key").alias("own"),
                        F.explode(masks).alias("mask")).select(
                            "a", "seg", F.col("own").bitwiseXOR(F.col("mask")).alias("key"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    # The planner sizes exploded rows as if they were one each, and would broadcast them: no broadcast.
    return (asked.hint("merge").join(stored, ["seg", "key"]).filter((F.col("a") < F.col("b")) & near)
            .select("a", "b").distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_key, fp, root, component_id and n_links.

    ``root`` is the smallest fingerprint of the component.
    ``n_links`` counts other fingerprints within the radius, not documents.
    """
    d = stage(docs.select(F.col("doc_id"), text_key().alias("text_key"),
                          fingerprint("text").alias("fp")), "simhash")
    u = stage(d.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-table")
    pairs = stage(links(u.select("fp")), "simhash-links")
    roots = connected_components(pairs).withColumnRenamed("node", "fp")
    degree = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(
        F.count("*").alias("n_links"))
    linked = u.join(roots, "fp").join(degree, "fp")
    named = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = linked.join(named, "root").select("fp", "root", "component_id", "n_links")
    alone = u.join(roots.select("fp"), "fp", "left_anti").select(
        "fp", F.col("fp").alias("root"), F.col("first_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    of = stage(linked.unionByName(alone), "simhash-classes")
    return d.join(of, "fp")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: the smallest doc_id, null ids last."""
    best = near_duplicates(docs).groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("a"), F.col("doc_id").cast("long").alias("b"),
        F.col("text_key").alias("c"))).alias("p"))
    best = best.select(F.coalesce("p.b", F.lit(-(1 << 63))).alias("_id"), F.col("p.c").alias("_key"))
    kept = keyed(docs).join(best.distinct(), ["_id", "_key"])
    return first_of_repeats(kept).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with fingerprint and component."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                      "component_id", "n_links")

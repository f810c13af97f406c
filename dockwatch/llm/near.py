"""Near copies: texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from SimHash as in ``simhash``: 3-word shingles, fingerprints that differ
in at most three of 64 bits, met by multi-index hashing. Two texts at 0.8 differ in some ten
bits, and balls of that radius would hold most of the table, so what this radius does
not reach comes from MinHash bands: ``BANDS`` bands of ``ROWS`` least hashes, and a pair at similarity s
shares a band but for (1 - s**ROWS)**BANDS: 1.0e-3 at 0.8, 3e-6 at 0.85, while of the
pairs at 0.5 nine in a hundred share one and at 0.3 one in a thousand. Every link is
verified on the whole shingle sets.

Links serve components only, so a pair inside a component is not compared. The bands with
the same first member, the one that shares most bands (the text that copies were made
from is alike to all of them, two copies are less so), form one cell, in which all members are
compared with it. Then members that are not in its component take turns as
pivots, 4, 16, 64, ... in a round, until all pairs of a cell are decided. Pairs that cannot
reach 0.8 are ruled out by what is known of each member:

- Shingles that at most three texts have are rare. Texts that share a rare one are compared at
  once. All others have no rare shingle in common, so they share at most what either has beside them.
- Such a pair shares at most what either has in common with the first member of the cell, and
  of the shingles outside it at most those of either that are not rare.

A member that cannot reach 0.8 with the smallest of its cell takes no part. The work of
a round is linear in the members, and only a cell of n texts that are mutually unlike and
differ from its first member in shingles that more than three of them have costs up to n * n / 2
verifications in log n rounds.

Defined cases: null and empty texts are one group; fewer words than a shingle are one
shingle; words compare as in ``simhash`` (A-Z lower-cased, ASCII white space); repeated
rows are one text, of rows equal in id and text one stays; null ids come after all
others; other columns are kept as they are; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from dockwatch.llm.common import first_of_repeats, keyed
from dockwatch.llm.components import connected_components
from dockwatch.llm.simhash import fingerprint, links
from dockwatch.operators.ordering import top_per_group
from dockwatch.session import stage

SHINGLE = 5
#: A pair links from this share on, as a ratio of whole numbers.
SIMILAR = (4, 5)
BANDS, ROWS = 48, 9
#: Shingles hashed at a time.
CHUNK = 2048

_rng = np.random.default_rng(20240131)
_MUL = _rng.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)
_FOLD = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_hash = xxhash.xxh64_intdigest


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").lower().split()


def shingles(words: list[bytes]) -> np.ndarray:
    """The distinct shingle hashes of a text."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    n = max(1, len(words) - SHINGLE + 1)
    return np.unique(np.fromiter((_hash(b" ".join(words[i:i + SHINGLE]), 7) for i in range(n)), np.uint64, n))


def bands_of(grams: np.ndarray) -> np.ndarray:
    """One key for each band; no keys without shingles."""
    if not len(grams):
        return np.zeros(0, dtype=np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(grams), CHUNK):
        np.minimum(least, (grams[None, at:at + CHUNK] * _MUL + _ADD).min(axis=1), out=least)
    return (least.reshape(BANDS, ROWS) * _FOLD).sum(axis=1, dtype=np.uint64).view(np.int64)


_SKETCH = T.StructType([T.StructField("node", T.LongType()), T.StructField("n", T.LongType()),
                        T.StructField("bands", T.ArrayType(T.LongType()))])


@F.pandas_udf(_SKETCH)
def _sketch(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        w = words_of(t)
        g = shingles(w)
        rows.append((np.uint64(_hash(b" ".join(w), 11)).astype(np.int64), len(g), bands_of(g)))
    return pd.DataFrame(rows, columns=["node", "n", "bands"])


@F.pandas_udf(T.ArrayType(T.LongType()))
def _grams(texts: pd.Series) -> pd.Series:
    return pd.Series([shingles(words_of(t)).view(np.int64) for t in texts])


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) with ``both`` and ``either``: sizes of common and joint set, from whole ``sets``."""
    a = sets.select(F.col("node").alias("a"), F.col("grams").alias("ga"))
    b = sets.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
    both = F.size(F.array_intersect("ga", "gb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", both.alias("both"),
                                                  (F.size("ga") + F.size("gb") - both).alias("either"))


def _sizes_allow(n: str, m: str):
    num, den = SIMILAR
    return (F.col(n) * den >= F.col(m) * num) & (F.col(m) * den >= F.col(n) * num)


def _reach(both: Column, n: str, m: str) -> Column:
    """Whether sets of ``n`` and ``m`` members with ``both`` in common are similar."""
    num, den = SIMILAR
    return both * (num + den) >= (F.col(n) + F.col(m)) * num


def _cells(nodes: DataFrame) -> DataFrame:
    """cell, cn, node, n and weight: the members of bands by the first member of the band, which shares most bands."""
    rows = nodes.select("node", "n", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    rows = stage(rows.join(shared, "key"), "near-shared")
    weight = rows.groupBy("node").agg(F.sum("size").alias("weight"))
    rows = stage(rows.join(weight, "node"), "near-bands")
    first = rows.groupBy("key").agg(F.min(F.struct((-F.col("weight")).alias("w"), "node", "n")).alias("p"))
    first = first.select("key", F.col("p.node").alias("cell"), F.col("p.n").alias("cn"))
    return stage(rows.join(first, "key").select("cell", "cn", "node", "n", "weight").distinct(), "near-cells")


def _rare(sets: DataFrame) -> DataFrame:
    """who and times: up to three nodes, and the number of shingles that they and no others have."""
    one = sets.select("node", F.explode("grams").alias("gram")).groupBy("gram").agg(
        F.count("*").alias("df"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.bit_xor("node").alias("x"))
    one = one.filter("df <= 3").groupBy("df", "lo", "hi", "x").agg(F.count("*").alias("times"))
    mid = F.col("x").bitwiseXOR(F.col("lo")).bitwiseXOR(F.col("hi"))
    who = F.when(F.col("df") == 1, F.array("lo")).when(F.col("df") == 2, F.array("lo", "hi")).otherwise(
        F.array(F.col("lo"), mid, F.col("hi")))
    return stage(one.select(who.alias("who"), "times"), "near-rare")


def _apart(pairs: DataFrame, key: str, of: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes in different components, of sizes that allow a link, from ``pairs`` of ``key``."""
    side = lambda x, y: of.select(F.col(key).alias(x), *[F.col(c).alias(f"{y}_{c}") for c in ("node", "n", "root")])
    met = pairs.withColumnsRenamed({"a": "ka", "b": "kb"}).join(side("ka", "a"), "ka").join(side("kb", "b"), "kb")
    return met.filter((F.col("a_root") != F.col("b_root")) & _sizes_allow("a_n", "b_n")).select(
        F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))


def _members(cells: DataFrame, rare: DataFrame, compared: DataFrame) -> DataFrame:
    """``cells`` without their first members and those that are similar to nobody, with what bounds their common sets:
    kept (shingles that are not rare), both (in common with the cell) and own (neither), null if not compared."""
    rare = rare.select(F.explode("who").alias("node"), "times").groupBy("node").agg(F.sum("times").alias("rare"))
    known = compared.select("a", "b", "both")
    m = cells.join(rare, "node", "left").join(
        rare.withColumnsRenamed({"node": "cell", "rare": "crare"}), "cell", "left").fillna(0, ["rare", "crare"])
    m = m.withColumns({"a": F.least("node", "cell"), "b": F.greatest("node", "cell")}).join(known, ["a", "b"], "left")
    m = m.join(cells.groupBy("cell").agg(F.min("n").alias("least")), "cell")
    kept = F.col("n") - F.col("rare")
    own = F.col("n") - F.col("both") - F.greatest(F.lit(0), F.col("rare") - F.col("crare"))
    own = F.when(F.col("both").isNotNull(), F.greatest(F.lit(0), own))
    m = m.select("cell", "node", "n", "weight", "least", kept.alias("kept"), "both", own.alias("own"))
    return stage(m.filter((F.col("node") != F.col("cell")) & _reach(F.col("kept"), "n", "least")).drop("least"),
                 "near-members")


def _joined(roots: DataFrame, compared: DataFrame) -> DataFrame:
    """``roots`` after the links among the ``compared``."""
    num, den = SIMILAR
    alike = compared.filter(F.col("both") * den >= F.col("either") * num).select("a", "b")
    if alike.isEmpty():
        return roots
    known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return stage(connected_components(known.unionByName(alike)), "near-roots")


def _rooted(rows: DataFrame, roots: DataFrame, node: str = "node", root: str = "root") -> DataFrame:
    return rows.join(roots.select(F.col("node").alias(node), F.col("root").alias(root)), node, "left").withColumn(
        root, F.coalesce(root, node))


def groups(docs: DataFrame, sketched: DataFrame) -> DataFrame:
    """(node, root) of all nodes that have a near copy.

    ``sketched`` has _id, _key, node, n, bands and fp of the rows of ``docs``.
    """
    nodes = sketched.groupBy("node").agg(F.min("n").alias("n"), F.first("bands").alias("bands"), F.min("fp").alias("fp"))
    cells = _cells(nodes)
    prints = stage(nodes.groupBy("fp").agg(F.count("*").alias("size")), "near-prints")
    same = prints.filter("size > 1").select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    # Each fingerprint asks for many keys, which the planner's size estimate does not see: no broadcast.
    close = stage(links(prints.select("fp").hint("merge")).unionByName(same), "near-close")
    close_fp = close.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    printed = stage(nodes.select("node", "n", "fp").join(close_fp, "fp"), "near-printed")

    wanted = cells.select("node").unionByName(printed.select("node")).distinct()
    where = sketched.join(wanted, "node", "left_semi").groupBy("node").agg(
        F.min(F.struct("_id", "_key")).alias("p")).select("node", "p._id", "p._key")
    sets = first_of_repeats(keyed(docs).select("_id", "_key", "text").join(where, ["_id", "_key"]))
    sets = stage(sets.select("node", _grams("text").alias("grams")), "near-sets")
    rare = _rare(sets)

    # Members of a cell against the first one.
    pairs = cells.filter((F.col("node") != F.col("cell")) & _sizes_allow("n", "cn")).select(
        F.least("node", "cell").alias("a"), F.greatest("node", "cell").alias("b")).distinct()
    tried = stage(pairs, "near-pairs")
    compared = stage(_compared(tried, sets), "near-compared")
    roots = _joined(sets.select("node", F.col("node").alias("root")).filter(F.lit(False)), compared)
    members = _members(cells, rare, compared)

    # Texts with close fingerprints and those that share a rare shingle.
    some = F.array(*[F.struct(F.get("who", i).alias("a"), F.get("who", j).alias("b")) for i, j in [(0, 1), (0, 2), (1, 2)]])
    shared = rare.filter(F.size("who") > 1).select(F.explode(some).alias("p")).select("p.*").dropna().distinct()
    sizes = nodes.select("node", "n").join(wanted, "node", "left_semi").withColumn("key", F.col("node"))
    pairs = _apart(close, "fp", _rooted(printed, roots)).unionByName(_apart(shared, "key", _rooted(sizes, roots)))
    pairs = stage(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "near-pairs")
    tried = tried.unionByName(pairs)
    roots = _joined(roots, stage(_compared(pairs, sets), "near-compared"))

    used, batch = None, 4
    while True:
        live = stage(_rooted(_rooted(members, roots), roots, "cell", "croot"), "near-live")
        left = live.filter("root != croot")
        left = left if used is None else left.join(used, ["cell", "node"], "left_anti")
        pivots = top_per_group(left, ["cell"], [F.desc("weight"), F.col("node")], batch).select(
            "cell", *[F.col(c).alias(f"p_{c}") for c in ("node", "n", "root", "kept", "both", "own")])
        pivots = stage(pivots, "near-pivots")
        if pivots.isEmpty():
            return roots
        # Unlike the rest, ``least`` passes over a null.
        through = F.when(F.col("both").isNotNull() & F.col("p_both").isNotNull(),
                         F.least("both", "p_both") + F.least("own", "p_own"))
        most = F.least(F.least("kept", "p_kept"), through)
        pairs = live.join(pivots, "cell").filter(
            (F.col("root") != F.col("p_root")) & _sizes_allow("n", "p_n") & _reach(most, "n", "p_n")).select(
                F.least("node", "p_node").alias("a"), F.greatest("node", "p_node").alias("b")).distinct()
        pairs = stage(pairs.join(tried, ["a", "b"], "left_anti"), "near-pairs")
        roots = _joined(roots, stage(_compared(pairs, sets), "near-compared"))
        tried = tried.unionByName(pairs)
        done = pivots.select("cell", F.col("p_node").alias("node"))
        used, batch = done if used is None else used.unionByName(done), 4 * batch


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near copies: the smallest doc_id, null ids last."""
    d = keyed(docs).select("_id", "_key", F.col("doc_id").isNull().alias("_none"), _sketch("text").alias("s"),
                             fingerprint("text").alias("fp"))
    d = stage(d.select("_id", "_key", "_none", "s.*", "fp"), "near-docs")
    roots = groups(docs, d).withColumnRenamed("root", "_root")
    best = d.select("_id", "_key", "_none", "node").join(roots, "node", "left").groupBy(
        F.coalesce("_root", "node").alias("_root")).agg(
            F.min(F.struct("_none", "_id", "_key")).alias("p"))
    kept = keyed(docs).join(best.select("p._id", "p._key").distinct(), ["_id", "_key"])
    return first_of_repeats(kept).select(*docs.columns)

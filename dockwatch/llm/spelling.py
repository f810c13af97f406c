"""Groups of spelling variants: words one edit apart, found by a relational trie frontier.

Words are counted per batch in tasks and summed by Spark. The trie over the vocabulary
is a table of edges. A node is a prefix (named by a 64-bit hash of it) after which words
differ or one ends; an edge carries the code points up to the next node, or to the end
of its word. Words one edit apart part at a node on both their paths. From there a state
(word, position, node, edits)

- takes an edge with a larger first code point (replaced), or
- skips its own code point (the other word lacks it),

and then must match whole edges: states are joined with the edges level by level, and
those that end a word with one edit are neighbours. Insertions and replacements by
smaller code points are the same pairs seen from the other word.

Near the root every word meets every node, so edits there would make many states that
lead nowhere. Two words one edit apart share their first or their second half; the trie
therefore holds each word forwards and, behind a mark, backwards, and edits are made in
the later half only, where few words are left under a node. An edge also knows the first
code points of the edges after it, so states that cannot go on are not made. Every level
is a written table; there are as many levels as nodes on the longest path.

Defined cases: null and empty texts have no words; a null doc_id counts as an empty
string in the checksum; rows that repeat count each time; words of any length take
part; ties of counts go to the smaller word in code-point order; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from dockwatch.llm.common import table
from dockwatch.session import stage

MIN_LENGTH = 6
MIN_COUNT = 5
#: A form occurs at least this many times as often as its variant.
RATIO = 5
#: One of so many (document, word) pairs loses a code point.
DROP = 199
#: Different words held by a task before it hands its counts on.
HELD = 200_000
#: Stands before words spelt backwards.
MARK = "\x01"

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {i: i + 32 for i in range(65, 91)}
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
U = np.uint64


def runs_of(doc: str, text: str, known: dict[str, tuple[str, bytes]]) -> dict[str, int]:
    """Words of one text with their counts: A-Z lower-cased, some with a code point deleted.

    Only runs of MIN_LENGTH code points or more; ``known`` remembers their lower-cased form.
    """
    out: dict[str, int] = {}
    start = zlib.crc32(f"{doc}:".encode())
    for run, n in Counter([r for r in _RUN.findall(text) if len(r) >= MIN_LENGTH]).items():
        if run not in known:
            word = run.lower() if run.isascii() else run.translate(_LOWER)
            known[run] = word, word.encode()
        word, raw = known[run]
        h = zlib.crc32(raw, start)
        if h % DROP == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1:]
        out[word] = out.get(word, 0) + n
    return out


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def frame() -> pd.DataFrame:
        some = [(w, n) for w, n in held.items() if len(w) >= MIN_LENGTH]
        return pd.DataFrame(some, columns=["word", "n"])
    held: dict[str, int] = {}
    known: dict[str, tuple[str, bytes]] = {}
    for pdf in batches:
        for doc, text in zip(pdf["doc"], pdf["text"]):
            for word, n in runs_of(doc, text, known).items():
                held[word] = held.get(word, 0) + n
            if len(held) > HELD or len(known) > HELD:
                yield frame()
                held, known = {}, {}
    yield frame()


def vocabulary(docs: DataFrame) -> DataFrame:
    """word and n: the words of all texts that are long and frequent enough."""
    d = docs.filter(F.col("text").isNotNull()).select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), "text")
    return (d.mapInPandas(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= MIN_COUNT))


_STEP = T.ArrayType(T.StructType([T.StructField("node", T.LongType()), T.StructField("next", T.IntegerType())]))


@F.pandas_udf(_STEP)
def _prefixes(words: pd.Series) -> pd.Series:
    """For each prefix of a word, the empty one first: its hash and the code point after it (-1 at the end)."""
    out = []
    for w in words:
        codes = np.frombuffer(w.encode("utf-32-le"), dtype=np.uint32)
        n = len(codes)
        up = np.full(n + 1, _INVERSE, dtype=np.uint64)
        up[0] = 1
        sums = np.concatenate([[U(0)], np.cumsum(codes.astype(np.uint64) * np.cumprod(up)[:n], dtype=np.uint64)])
        h = (sums ^ (np.arange(n + 1, dtype=np.uint64) * U(0xD6E8FEB86659FD93))) * U(_BASE)
        h = ((h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)).view(np.int64)
        nxt = np.append(codes.astype(np.int64), -1)
        out.append([{"node": int(a), "next": int(b)} for a, b in zip(h, nxt)])
    return pd.Series(out)


def _bit(letter: Column) -> Column:
    """One of 63 bits for a code point, or for the end of a word."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(letter), F.lit(63)))


def trie(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges of the trie over ``words`` and the path (word, pos, node, depth) of each word.

    An edge has node, depth, first, label, child, leaf and nexts. A leaf edge has no
    child but the word that it ends; the edge of a word that ends at its node has an
    empty label. nexts has the bits of the first code points at the child.
    """
    steps = stage(words.select("word", F.posexplode(_prefixes("word")).alias("pos", "s"))
                  .select("word", "pos", "s.node", "s.next"), "spelling-prefixes")
    nodes = steps.groupBy("node", "pos").agg(F.min("next").alias("_lo"), F.max("next").alias("_hi")).filter(
        "_lo < _hi").select("node", "pos")
    # Prefixes of three code points at most are few by the alphabet, and met by most words.
    short = steps.filter("pos <= 3").join(F.broadcast(nodes.filter("pos <= 3")), ["node", "pos"], "left_semi")
    long = steps.filter("pos > 3").join(nodes.filter("pos > 3"), ["node", "pos"], "left_semi")
    along = Window.partitionBy("word").orderBy("pos")
    path = stage(short.unionByName(long).select(
        "word", "pos", "node", (F.row_number().over(along) - 1).alias("depth"),
        F.lead("pos").over(along).alias("_to"), F.lead("node").over(along).alias("child")), "spelling-path")
    size = F.coalesce(F.col("_to"), F.char_length("word")) - F.col("pos")
    label = F.col("word").substr(F.col("pos") + 1, size)
    edges = path.select("node", "depth", label.alias("label"), "child",
                        F.when(F.col("child").isNull(), F.col("word")).alias("leaf"))
    edges = edges.groupBy("node", "depth", F.substring("label", 1, 1).alias("first")).agg(
        F.min("label").alias("label"), F.min("child").alias("child"), F.min("leaf").alias("leaf"))
    edges = stage(edges, "spelling-edges")
    nexts = edges.groupBy(F.col("node").alias("child")).agg(F.bit_or(_bit(F.col("first"))).alias("nexts"))
    # Leaf edges have no child and stay out of the join.
    inner = edges.filter("child IS NOT NULL").join(nexts, "child")
    edges = stage(inner.unionByName(edges.filter("child IS NULL").withColumn("nexts", F.lit(None).cast("long"))),
                  "spelling-edges")
    return edges, path.select("word", "pos", "node", "depth")


def _part(at: Column, size: Column | int) -> Column:
    return F.col("word").substr(at + 1, size if isinstance(size, Column) else F.lit(size))


def _arrived(rows: DataFrame) -> DataFrame:
    """States with one edit that end at a word, or can go on from where they are."""
    pos = F.col("pos")
    ends = F.col("leaf").isNotNull() & (pos == F.char_length("word"))
    on = F.col("leaf").isNull() & (F.col("nexts").bitwiseAND(_bit(_part(pos, 1))) != 0)
    return rows.filter(ends | on).drop("nexts")


def _step(fresh: DataFrame, edited: DataFrame | None, edges: DataFrame) -> DataFrame:
    """States (word, pos, node) with one edit after an edge, and the word (leaf) that the edge ended."""
    pos, label = F.col("pos"), F.col("label")
    size = F.char_length("label")
    edges = edges.select("node", "first", "label", F.col("child").alias("to"), "leaf", "nexts")
    here, after = _part(pos, 1), _part(pos + 1, 1)
    replaced = (here != "") & (F.col("first") > here) & (
        F.substring("label", 2, 1 << 30) == _part(pos + 1, size - 1))
    skipped = (here != "") & (F.col("first") == after) & (F.col("first") != here) & (label == _part(pos + 1, size))
    # One edge may serve as a replacement and as a skip: both go on.
    ways = F.array_compact(F.array(F.when(replaced, pos + size), F.when(skipped, pos + size + 1)))
    out = _arrived(fresh.join(edges, "node").filter(replaced | skipped).select(
        "word", F.explode(ways).alias("pos"), F.col("to").alias("node"), "leaf", "nexts"))
    if edited is not None:
        matched = edited.withColumn("first", _part(pos, 1)).join(edges, ["node", "first"]).filter(
            label == _part(pos, size))
        out = out.unionByName(_arrived(matched.select(
            "word", (pos + size).alias("pos"), F.col("to").alias("node"), "leaf", "nexts")))
    return out


def neighbours(words: DataFrame) -> DataFrame:
    """Pairs (word, near) of ``words`` exactly one edit apart, each in both directions."""
    back = F.concat(F.lit(MARK), F.reverse("word"))
    edges, path = trie(words.select("word").unionByName(words.select(back.alias("word"))))
    # Forwards edits from the middle on, backwards those before it.
    marked = F.col("word").startswith(MARK)
    size = F.char_length("word") - marked.cast("int")
    half = F.floor((size - 1) / 2)
    fresh = path.filter(F.col("pos") >= F.when(marked, size - half + 1).otherwise(half))
    deepest = path.agg(F.max("depth")).first()[0]
    ended, edited = [], None
    for depth in range(0 if deepest is None else deepest + 1):
        at = F.col("depth") == depth
        reached = stage(_step(fresh.filter(at), edited, edges.filter(at)), "spelling-states")
        ended.append(reached.filter("leaf IS NOT NULL").select("word", F.col("leaf").alias("near")))
        edited = reached.filter("node IS NOT NULL").drop("leaf")
    if not ended:
        return words.select("word", F.col("word").alias("near")).filter(F.lit(False))
    plain = [F.when(F.col(c).startswith(MARK), F.reverse(F.substring(c, 2, 1 << 30))).otherwise(F.col(c)).alias(c)
             for c in ("word", "near")]
    # Halves may overlap; and nodes are named by hashes, so the words themselves decide.
    pairs = reduce(DataFrame.unionByName, ended).select(*plain).distinct()
    pairs = stage(pairs.filter(F.levenshtein("word", "near", 1) == 1), "spelling-pairs")
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near")))


def roots(forms: DataFrame) -> DataFrame:
    """word and root: forms followed to the last, for words that have a form.

    Each round doubles the steps taken. Counts grow RATIO-fold with each form, so no
    chain of counts below 2**63 outlives 32 steps.
    """
    up = stage(forms.select("word", F.col("form").alias("root")), "spelling-up")
    for _ in range(5):
        on = up.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        if up.join(on, "root", "left_semi").isEmpty():
            break
        up = stage(up.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root")),
                   "spelling-up")
    return up


def variants(docs: DataFrame) -> DataFrame:
    """Every word with its form, the root of its forms, its count, near words and the form's count."""
    words = stage(vocabulary(docs), "spelling-words")
    near = neighbours(words).join(words.select(F.col("word").alias("near"), "n"), "near")
    near = near.groupBy("word").agg(F.count("*").alias("n_near"),
                                    F.min(F.struct((-F.col("n")).alias("m"), "near")).alias("b"))
    has = -F.col("b.m") >= F.lit(RATIO) * F.col("n")
    out = stage(words.join(near, "word", "left").select(
        "word", F.when(has, F.col("b.near")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has, -F.col("b.m")).alias("form_n")), "spelling-forms")
    root = roots(out.filter("form IS NOT NULL"))
    return out.join(root, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spelling variants of all documents."""
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text"))

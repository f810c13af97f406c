"""Removal of word sequences that stand in more than one place, by FM-indexes per shard.

Two equal windows of WINDOW words hold the same GRAM-word runs, and so the same
smallest hash among them, their anchor. Consecutive windows with one anchor make
a segment, and equal windows always lie in segments of equal anchor. So each
shard takes the segments of some anchors, indexes them (every different segment
once, weighted by how often it occurs) and streams them against its own index
only. Backward search over the wavelet matrix finds the stretches of WINDOW
words or more that occur elsewhere. Anchors of one segment that holds them once
cannot match and are left out before any words are moved.

An anchor with more than HOT_SEGMENTS different segments (the edges of a passage
that a large part of the corpus quotes) would make one shard too large. Its
segments are taken apart into their windows, equal windows are one entry, and a
window's own hash deals them out to shards, so no shard grows with the group.

Words are compared by their 64-bit hashes. Text crosses the network twice: for
the words of the first copy of each segment, and for the removal itself.

Windows are judged on the input, all at once; all words that a repeated window
covers go.

Defined cases: null and empty texts have no words; rows that repeat are places
of their own, so all their windows repeat; texts shorter than a window keep
everything; a null doc_id is an id like any other; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from dockwatch.llm.common import keyed, table
from dockwatch.llm.fmindex import FMIndex, repeated_intervals
from dockwatch.session import stage

WINDOW = 35
GRAM = 8
#: Windows in a segment at most.
RUN = WINDOW - GRAM + 1
#: Words of a shard, on average.
SHARD_WORDS = 400_000
#: Different segments of one anchor that stay together.
HOT_SEGMENTS = 5_000

_hash = xxhash.xxh64_intdigest
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
U = np.uint64


def split(text: str | None) -> list[bytes]:
    """Words of a text: UTF-8, unchanged, between ASCII white space."""
    return text.encode("utf-8").split() if isinstance(text, str) else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hash, words), dtype=np.uint64, count=len(words))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def segments_of(h: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments of one text's word hashes: start, number of windows, anchor, hash of the words, and
    whether the anchor stands in the segment more than once."""
    n = len(h)
    with np.errstate(over="ignore"):
        grams = np.zeros(n - GRAM + 1, dtype=np.uint64)
        for i in range(GRAM):
            grams = grams * U(_BASE) + h[i:n - GRAM + 1 + i]
        grams = _mixed(grams)
        anchor = _sliding_min(grams, RUN)
        m = len(anchor)
        new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        place = np.arange(m)
        begun = np.maximum.accumulate(np.where(new, place, 0))
        start = np.flatnonzero((place - begun) % RUN == 0)
        count = np.diff(np.concatenate([start, [m]]))
        sums = np.concatenate([[U(0)], np.cumsum(h * _powers(_BASE, n), dtype=np.uint64)])
        words = sums[start + count + WINDOW - 1] - sums[start]
        again = np.zeros(len(start), dtype=bool)
        ordered = np.sort(grams)
        if (ordered[1:] == ordered[:-1]).any():
            for k, (s, c) in enumerate(zip(start, count)):
                again[k] = np.count_nonzero(grams[s:s + c + RUN - 1] == anchor[s]) > 1
        return start, count, anchor[start], _mixed(words * _powers(_INVERSE, n)[start]), again


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        parts: list[tuple] = []
        for doc, key, text in zip(pdf["_id"], pdf["_key"], pdf["text"]):
            words = split(text)
            if len(words) >= WINDOW:
                found = segments_of(word_hashes(words))
                parts.append((np.full(len(found[0]), doc), np.full(len(found[0]), key), *found))
        if parts:
            cols = [np.concatenate(x) for x in zip(*parts)]
            yield pd.DataFrame({"_id": cols[0], "_key": cols[1], "start": cols[2].astype(np.int32),
                                "n": cols[3].astype(np.int32), "anchor": cols[4].view(np.int64),
                                "seg": cols[5].view(np.int64), "again": cols[6]})


def _fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The words, as hashes in bytes, of segments whose place in a text is known.

    A segment of a hot anchor comes as its windows: ``at`` is a window's place in
    it, ``key`` the window's hash. Others have ``at`` -1 and their anchor as key.
    """
    for pdf in batches:
        rows = []
        for text, wanted in zip(pdf["text"], pdf["wanted"]):
            words = split(text)
            for w in wanted:
                some = word_hashes(words[w["start"]:w["start"] + w["n"] + WINDOW - 1])
                cut = range(w["n"]) if w["hot"] else [-1]
                for at in cut:
                    raw = (some if at < 0 else some[at:at + WINDOW]).tobytes()
                    key = w["anchor"] if at < 0 else xxhash.xxh64_intdigest(raw) - (1 << 63)
                    rows.append((w["anchor"], w["seg"], w["n"], w["weight"], at, key, raw))
        yield pd.DataFrame(rows, columns=["anchor", "seg", "n", "weight", "at", "key", "words"])


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One shard after the other: rows come sorted by shard."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        for shard, part in pdf.groupby("shard", sort=True):
            if held and held[0]["shard"].iat[0] != shard:
                yield _search_shard(pd.concat(held))
                held = []
            held.append(part)
    if held:
        yield _search_shard(pd.concat(held))


def _search_shard(rows: pd.DataFrame) -> pd.DataFrame:
    units = [np.frombuffer(w, dtype=np.uint64) for w in rows["words"]]
    unit, first, last = repeated_intervals(FMIndex(units, rows["weight"].to_numpy()), WINDOW)
    got = rows[["key", "seg", "n", "at"]].iloc[unit].reset_index(drop=True)
    return got.assign(first=first.astype(np.int32), last=last.astype(np.int32))


def repeats(docs: DataFrame) -> DataFrame:
    """Stretches of words to remove: _id, _key and a list of (first, last) for each text with any."""
    spark = docs.sparkSession
    d = keyed(docs.select("doc_id", "text")).drop("doc_id")
    seg = stage(d.mapInPandas(
        _segments, "_id long, _key long, start int, n int, anchor long, seg long, again boolean"), "segments")
    twice = seg.groupBy("anchor").agg(F.count("*").alias("_n"), F.max("again").alias("_again")).filter(
        "_n > 1 OR _again").select("anchor")
    seg = stage(seg.drop("again").join(twice, "anchor"), "segments-repeated")
    # Every different segment once, with its number of places and the first of them.
    distinct = seg.groupBy("anchor", "seg", "n").agg(
        F.count("*").alias("weight"), F.min(F.struct("_id", "_key", "start")).alias("p"))
    hot = distinct.groupBy("anchor").agg(F.count("*").alias("_n")).filter(
        F.col("_n") > HOT_SEGMENTS).select("anchor", F.lit(True).alias("hot"))
    distinct = distinct.join(hot, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    wanted = distinct.groupBy(F.col("p._id").alias("_id"), F.col("p._key").alias("_key")).agg(
        F.collect_list(F.struct(F.col("p.start").alias("start"), "anchor", "seg", "n", "weight", "hot"))
        .alias("wanted"))
    words = stage(d.join(wanted, ["_id", "_key"]).select("text", "wanted").mapInPandas(
        _fetch, "anchor long, seg long, n int, weight long, at int, key long, words binary"), "segment-words")
    windows = words.filter("at >= 0").drop("words")
    units = words.filter("at < 0").select("key", "seg", "n", "at", "weight", "words").unionByName(
        words.filter("at >= 0").groupBy("key").agg(
            F.sum("weight").alias("weight"), F.min("words").alias("words")).select(
                "key", F.col("key").alias("seg"), F.lit(1).alias("n"), F.lit(0).alias("at"), "weight", "words"))
    total = words.agg(F.sum(F.octet_length("words") / 8)).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total // SHARD_WORDS))
    found = stage(
        units.withColumn("shard", F.pmod("key", F.lit(shards)).cast("int"))
        .repartition(shards, "shard").sortWithinPartitions("shard")
        .mapInPandas(_search, "key long, seg long, n int, at int, first int, last int"), "segment-repeats")
    apart = windows.join(found.filter("at >= 0").select("key"), "key").select(
        "anchor", "seg", "n", F.col("at").alias("first"), (F.col("at") + WINDOW - 1).alias("last"))
    found = found.filter("at < 0").select(F.col("key").alias("anchor"), "seg", "n", "first", "last")
    found = found.unionByName(apart).distinct()
    return (seg.join(found, ["anchor", "seg", "n"]).groupBy("_id", "_key")
            .agg(F.array_sort(F.collect_set(F.struct(
                (F.col("start") + F.col("first")).alias("first"),
                (F.col("start") + F.col("last")).alias("last")))).alias("gone")))


def _cut(words: list[bytes], gone) -> tuple[int, bytes]:
    """Number of removed words, and the kept ones joined by one space."""
    if gone is None or not len(gone):
        return 0, b" ".join(words)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for g in gone:
        edge[g["first"]] += 1
        edge[g["last"] + 1] -= 1
    keep = np.cumsum(edge)[:-1] == 0
    return int(len(words) - keep.sum()), b" ".join([words[i] for i in np.flatnonzero(keep)])


def remove_repeats(docs: DataFrame, as_is: bool = False) -> DataFrame:
    """``docs`` with n_words, n_removed and the kept words as ``kept_text`` in place of text.

    Null stays null. With ``as_is`` a text that loses nothing keeps its white space.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes, removed, kept = [], [], []
            for text, gone in zip(pdf["text"], pdf["_gone"]):
                words = split(text)
                n, rest = _cut(words, gone)
                sizes.append(len(words))
                removed.append(n)
                whole = as_is and not n or not isinstance(text, str)
                kept.append(text if whole else rest.decode("utf-8"))
            out = pdf.drop(columns=["_gone", "text"])
            yield out.assign(n_words=sizes, n_removed=removed, kept_text=kept)

    gone = repeats(docs).withColumnRenamed("gone", "_gone")
    keep = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_text")]
    joined = keyed(docs.select(*keep)).join(gone, ["_id", "_key"], "left").drop("_id", "_key")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                       for f in joined.schema if f.name not in ("text", "_gone"))
    return joined.mapInPandas(run, f"{fields}, n_words long, n_removed long, kept_text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the word sequences that stand elsewhere too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed",
        F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))

"""Packing documents into sequences: best fit, then swap-based local search.

The packing itself knows only how many pieces there are of each length, at most
one number for each length up to the sequence length, whatever the corpus
holds. Bins that hold the same lengths are one pattern with a count, so best fit
in decreasing order and the local search handle millions of bins at a time.

The local search exchanges one piece for one, two for one, or moves one or two pieces
between underfull bins whenever that raises the sum of squared fills, which
empties the emptier bin in the end. Each step is done on as many bins of the
two patterns at once as both have. It looks at all pairs of underfull patterns and at
all pieces and pairs of pieces in them, and ends when none of these exchanges helps or
the number of bins is the least that can hold the tokens. What a bin can give is a
set of sums up to the sequence length, kept as the bits of one number.

Patterns then name slots: the slots of a length are numbered over all patterns,
the pieces of that length are numbered by range partitions, and equal numbers
meet in a join with the (bounded) slot table.

Defined cases: a null text is an empty one; every document ends with the end
id, so an empty one is one piece of length 1; rows that repeat are documents of
their own; longer documents are cut from the end, so only the first piece is
short; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from dockwatch.llm.common import table
from dockwatch.llm.tokens import default_path, encoder
from dockwatch.operators.ordering import numbered
from dockwatch.session import stage

LENGTH = 2048
END_ID = 0

Pattern = tuple[int, ...]


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length and the ids as bytes."""
    path = path or default_path()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for pdf in batches:
            rows, held = [], 0
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                ids = enc.encode(text if isinstance(text, str) else "") + end
                total = len(ids) // 4
                first = total % length or length
                for k, at in enumerate([0, *range(first, total, length)]):
                    stop = at + length if k else first
                    rows.append((doc, k, at, stop - at, ids[4 * at:4 * stop]))
                held += total
                if held >= 1 << 21:
                    yield _frame(rows)
                    rows, held = [], 0
            if rows:
                yield _frame(rows)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInPandas(
        cut, f"doc_id {kind}, piece int, start long, length long, ids binary")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids"])
    if out["doc_id"].dtype.kind == "f":
        out["doc_id"] = out["doc_id"].astype("Int64")
    return out


def best_fit(counts: dict[int, int], length: int) -> Counter[Pattern]:
    """Best fit in decreasing order, bins of equal content at once."""
    bins: dict[int, Counter[Pattern]] = defaultdict(Counter)    # by room left
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, n: int) -> None:
        if not bins[room]:
            insort(rooms, room)
        bins[room][pattern] += n

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                room, pattern, n = length, (), left
            else:
                room = rooms[at]
                pattern, n = next(iter(bins[room].items()))
            fits = room // size
            use = min(n, max(1, left // fits))
            take = min(fits, left // use)
            if pattern:
                bins[room][pattern] -= use
                if not bins[room][pattern]:
                    del bins[room][pattern]
                if not bins[room]:
                    rooms.pop(at)
            put(room - take * size, pattern + (size,) * take, use)
            left -= take * use
    return sum((c for c in bins.values()), Counter())


def _less(pattern: Pattern, *out: int) -> Pattern:
    rest = list(pattern)
    for x in out:
        rest.remove(x)
    return tuple(rest)


def _mask(sizes: Iterable[int]) -> int:
    mask = 0
    for x in sizes:
        mask |= 1 << x
    return mask


def _offers(pattern: Pattern) -> int:
    """What a bin can give at once, one bit for each sum: any piece or any two."""
    ones = _mask(pattern)
    twos = _mask(x + y for x, y in combinations(sorted(set(pattern)), 2))
    return ones | twos | _mask(2 * x for x, n in Counter(pattern).items() if n > 1)


def _given(pattern: Pattern, total: int) -> tuple[int, ...]:
    """The piece, or else two pieces, of ``pattern`` with this sum."""
    if total in pattern:
        return (total,)
    for i, x in enumerate(pattern):
        if total - x in pattern[i + 1:]:
            return (x, total - x)
    raise ValueError(total)


def _widest(offers: int, backs: Pattern, least: int, most: int) -> tuple[int, int]:
    """The greatest x - y in least + 1 .. most for x of ``offers`` and y of ``backs`` or 0, and its y."""
    if most <= least:
        return least, 0
    window = (1 << most + 1) - (1 << least + 1)
    return max((((offers >> y & window).bit_length() - 1, y) for y in {0, *backs}), default=(-1, 0))


def _better(a: Pattern, b: Pattern, length: int, offers: Callable[[Pattern], int] = _offers
            ) -> tuple[Pattern, Pattern] | None:
    """The exchange between two bins that raises the sum of squared fills the most."""
    fa, fb = sum(a), sum(b)
    if fa > fb:
        a, b, fa, fb = b, a, fb, fa
    # b gains ``d`` and a loses it: squares rise by 2 d (fb - fa + d) > 0 for any d > 0.
    d, back = _widest(offers(a), b, 0, length - fb)
    # The other way round a takes from b: it pays only if a then holds more than b did.
    e, fore = _widest(offers(b), a, fb - fa, length - fa)
    if e - (fb - fa) > max(d, 0):
        out = _given(b, e + fore)
        return _less(b, *out) + (fore,) * bool(fore), _less(a, *(fore,) * bool(fore)) + out
    if d <= 0:
        return None
    out = _given(a, d + back)
    return _less(a, *out) + (back,) * bool(back), _less(b, *(back,) * bool(back)) + out


def local_search(bins: Counter[Pattern], length: int) -> Counter[Pattern]:
    """Exchanges between any two underfull patterns until no exchange helps or no fewer bins can do."""
    bins = Counter(bins)
    least = -(-sum(sum(p) * n for p, n in bins.items()) // length)
    offers = cache(_offers)
    idle: dict[Pattern, set[Pattern]] = defaultdict(set)    # partners without an exchange that helps
    moved = True
    while moved and sum(bins.values()) > least:
        # The emptiest bins are to be emptied; those with much room in all can take what they hold.
        open_ = [p for p in bins if sum(p) < length]
        low = sorted(open_, key=sum)
        wide = sorted(open_, key=lambda p: (sum(p) - length) * bins[p])
        moved = False
        for a in low:
            for b in wide:
                n = bins[a] // 2 if a == b else min(bins[a], bins[b])
                if n <= 0 or b in idle[a]:
                    continue
                change = _better(a, b, length, offers)
                if change is None:
                    idle[a].add(b)
                    idle[b].add(a)
                    continue
                bins[a] -= n
                bins[b] -= n
                for p in change:
                    if p:
                        bins[tuple(sorted(p, reverse=True))] += n
                moved = True
        bins = +bins
        idle = defaultdict(set, {p: others for p, others in idle.items() if p in bins})
    return bins


def pack_counts(counts: dict[int, int], length: int = LENGTH) -> Counter[Pattern]:
    """Bins for ``counts`` pieces of each length; the better of best fit and the search after it."""
    return local_search(best_fit({s: n for s, n in counts.items() if n}, length), length)


def slots(bins: Counter[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first, n, sequence, offset): slots first .. first + n - 1 of a length lie at
    ``offset`` of the sequences from ``sequence`` on."""
    rows, used, sequence = [], Counter(), 0
    for pattern, n in sorted(bins.items()):
        at = 0
        for size in pattern:
            rows.append((size, used[size], n, sequence, at))
            used[size] += n
            at += size
        sequence += n
    return rows


def place(cut: DataFrame, length: int = LENGTH) -> DataFrame:
    """``cut`` (with doc_id, piece, length) with sequence_id and offset.

    Rows of ``cut`` are staged, so leave the ids out or keep what stands for them.
    """
    spark = cut.sparkSession
    p = stage(cut, "pieces")
    # At most ``length`` rows.
    counts = {r["length"]: r["n"] for r in p.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table_ = spark.createDataFrame(slots(pack_counts(counts, length)),
                                   "_size long, _first long, _n long, _sequence long, offset long")
    order = [F.col("length"), F.col("doc_id"), F.col("piece"), F.col("start")]
    pos = numbered(p, order, "_at")
    starts, before = [], 0
    for size in sorted(counts):
        starts.append((size, before))
        before += counts[size]
    first = spark.createDataFrame(starts, "length long, _before long")
    pos = pos.join(F.broadcast(first), "length")            # at most ``length`` rows
    pos = pos.withColumn("_at", F.col("_at") - 1 - F.col("_before"))
    # Slots: one row for each piece of each pattern, bounded by the patterns, not by the bins.
    hit = (F.col("length") == F.col("_size")) & (F.col("_at") >= F.col("_first")) & (
        F.col("_at") < F.col("_first") + F.col("_n"))
    return (pos.join(F.broadcast(table_), hit)
            .withColumn("sequence_id", F.col("_sequence") + F.col("_at") - F.col("_first"))
            .drop("_at", "_before", "_size", "_first", "_n", "_sequence"))


def placed(docs: DataFrame) -> DataFrame:
    """Pieces of ``docs`` with a checksum of their ids and their place."""
    cut = pieces(docs)
    return place(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return placed(table(spark, sf_dir, "documents"))

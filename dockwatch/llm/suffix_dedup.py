"""Removal of byte strings that stand in an earlier document too, by run-length indexes per shard.

Every WINDOW bytes hold GRAM-byte grams; the one with the smallest hash is their anchor.
Consecutive windows with one anchor make a segment, so equal windows lie in segments of
equal anchor, and a shard that holds all segments of its anchors decides them alone.
Documents lie in blocks of some megabytes, dealt by hash. What a block asks and what it
is told travel as packed arrays, one row for each block and receiver:

1. Blocks send their anchors with the smallest and largest id; receivers answer with
   those held by more than one document.
2. Blocks send the segments of these anchors, each different one once with its smallest
   id. A receiver holds several shards. A shard indexes the different ones (``rindex``: runs
   of the Burrows-Wheeler transform with samples at run ends), streams them through the index
   for their matching statistics, and its receiver answers with the first owner of each of
   their windows.
3. Blocks mark the windows whose first owner has a smaller id, and cut.

Rows that travel are blocks times receivers, so both are as large as a task's memory allows;
shards are smaller, for an index that a cache holds.

A block sends a gram, segment or window once however many of its documents hold it, so
a passage that a third of the corpus quotes reaches a receiver once per block. Segments
of an anchor that more than HOT_SEGMENTS segments share (the edges of such a passage
differ in each document) are taken apart into single windows, which their own hash deals
over all shards.

Bytes are compared through 64-bit hashes of segments, within shards byte by byte.

Windows are judged on the input, all at once; all bytes that a marked window covers go.

Defined cases: null and empty texts have no bytes; texts shorter than a window keep
everything; rows that share a doc_id are not earlier than each other, so repeated rows
keep what the first of them keeps; a null doc_id comes before all others; texts of any
length are cut into chunks in memory, not in result; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from dockwatch.llm.common import table
from dockwatch.llm.rindex import RunIndex
from dockwatch.session import dropping_shuffles, stage, stage_bucketed

WINDOW = 50
GRAM = 20
#: Windows in a segment at most.
RUN = WINDOW - GRAM + 1
#: Text of a block, on average.
BLOCK_BYTES = 8 << 20
#: Text whose segments go to one shard, on average; some sixteenth of it are anchors.
SHARD_BYTES = 1 << 20
#: Text whose segments go to one receiver, on average.
RECEIVER_BYTES = 32 << 20
#: Text whose anchors go to one receiver, on average.
BUCKET_BYTES = 16 << 20
#: Parts that small inputs are cut into, so that hashes deal them evenly.
SPREAD = 256
#: Text of a bucket of the table of blocks, on average.
FILE_BYTES = 64 << 20
#: Segments of one anchor that stay together.
HOT_SEGMENTS = 5_000
#: Bytes hashed at a time, few enough for a cache; longer texts are cut at multiples of it.
CHUNK = 1 << 16

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240217).integers(0, 1 << 63, 256, dtype=np.uint64)
_NONE = np.iinfo(np.int64).max
#: Bits of an anchor's hash that travel; grams that agree in them are told apart in the index.
_KEPT = U(0xFFFFFFFFFFFF0000)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, CHUNK + WINDOW), _powers(_INVERSE, CHUNK + WINDOW)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def _part(x: np.ndarray, parts: int) -> np.ndarray:
    """A part of 0..parts-1 for each hash, in the order of the hashes."""
    return (((x >> U(32)) * U(parts)) >> U(32)).astype(np.int64)


def _grams(sums: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM consecutive bytes, from the sums of bytes times powers."""
    x = sums[GRAM:] - sums[:-GRAM]
    x *= _DOWN[:len(x)]
    return _mixed(x)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def _chunk(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """Segments of the texts between ``bounds``: place, number of windows, anchor, hash of the bytes."""
    lo, size = int(bounds[0]), int(bounds[-1] - bounds[0])
    if size < WINDOW:
        return None
    begin, stop = bounds[:-1] - lo, np.maximum(bounds[:-1], bounds[1:] - WINDOW + 1) - lo
    m = size - WINDOW + 1
    h = _TABLE[data[lo:lo + size]]
    h *= _UP[:size]
    sums = np.zeros(size + 1, dtype=np.uint64)
    np.cumsum(h, out=sums[1:])
    anchor = _sliding_min(_grams(sums), RUN)
    new = np.ones(m, dtype=bool)
    np.not_equal(anchor[1:], anchor[:-1], out=new[1:])
    new[begin[begin < m]] = True
    new[stop[stop < m]] = True
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, m))
    inside = start < stop[np.searchsorted(begin, start, side="right") - 1]
    start, count = start[inside], count[inside]
    if not len(start):
        return None
    pieces = -(-count // RUN)                                   # more than one where a gram stands again and again
    ends = np.repeat(start + count, pieces)
    start = _spread(np.zeros_like(pieces), pieces) * RUN + np.repeat(start, pieces)
    count = np.minimum(ends - start, RUN)
    seg = _mixed((sums[start + count + WINDOW - 1] - sums[start]) * _DOWN[start] + count.astype(np.uint64))
    # The smallest hashes are small numbers: mixed once more, they spread evenly over receivers.
    return start + lo, count, _mixed(anchor[start]) & _KEPT, seg


def segments(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments of all texts: place in ``data``, number of windows, anchor, hash; the same for the same text."""
    found, i, n = [], 0, len(bounds) - 1
    while i < n:
        j = i + 1
        while j < n and bounds[j + 1] - bounds[i] <= CHUNK:
            j += 1
        if bounds[j] - bounds[i] <= CHUNK:
            found.append(_chunk(data, bounds[i:j + 1]))
        else:
            for at in range(int(bounds[i]), int(bounds[j]), CHUNK):
                found.append(_chunk(data, np.array([at, min(at + CHUNK + WINDOW - 1, bounds[j])])))
        i = j
    found = [f for f in found if f is not None]
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.view(np.uint64), none.view(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places start, start + 1, ... of ranges of given sizes, one range after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)


def _window_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), dtype=np.uint64)
    for lo in range(0, len(at), CHUNK // WINDOW):
        some = at[lo:lo + CHUNK // WINDOW, None] + np.arange(WINDOW)
        out[lo:lo + len(some)] = (_TABLE[data[some]] * _UP[:WINDOW]).sum(axis=1, dtype=np.uint64)
    return _mixed(out + U(1))


def _texts(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text starts and ends; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = a.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[a.offset:a.offset + len(a) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def _packed(x: np.ndarray) -> bytes:
    """Numbers with their first bytes together, then their second, ...: alike bytes shrink on the way."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _numbers(column, dtype) -> np.ndarray:
    """The packed numbers of a binary column, one row after the other."""
    width = np.dtype(dtype).itemsize
    rows = [np.frombuffer(x, np.uint8).reshape(width, -1).T for x in column.to_pylist() if x]
    return np.concatenate(rows).reshape(-1).view(dtype) if rows else np.zeros(0, dtype)


def _groups(x: np.ndarray) -> np.ndarray:
    """First places of the runs of equal values."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _owner_ids(ids: np.ndarray, bounds: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The id of the text that each place lies in; empty texts hold no place."""
    return ids[np.searchsorted(bounds, start, side="right") - 1]


# ---- 1. anchors held by more than one document

def _send_anchors(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column("_block").to_numpy()
            cuts = np.append(_groups(blocks), len(blocks))
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                some = batch.slice(lo, hi - lo)
                data, bounds = _texts(some.column("text"))
                start, _, anchor, _ = segments(data, bounds)
                ids = _owner_ids(some.column("_id").to_numpy(), bounds, start)
                order = np.argsort(anchor)
                anchor, ids = anchor[order], ids[order]
                first = _groups(anchor)
                if not len(first):
                    continue
                key = anchor[first]
                cols = (key, np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first),
                        np.diff(np.append(first, len(anchor))).astype(np.int32))
                bucket = _part(key, buckets)
                at = np.append(_groups(bucket), len(bucket))
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(bucket[at[:-1]], pa.int32()),
                    "_block": pa.array(np.full(len(at) - 1, blocks[lo]), pa.int64()),
                    **{n: pa.array([_packed(c[a:b]) for a, b in zip(at[:-1], at[1:])], pa.binary())
                       for n, c in zip(("anchor", "low", "high", "n"), cols)}})
    return run


def _by(name: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """All rows of one value after the other; rows come sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        x = batch.column(name).to_numpy()
        cuts = np.append(_groups(x), len(x))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if held and held[0].column(name)[0].as_py() != x[lo]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _repeat_of(rows: pa.Table, column: str, width: int) -> np.ndarray:
    """``_block`` of each packed number of ``column``."""
    size = np.array([len(x) // width for x in rows.column(column).to_pylist()])
    return np.repeat(rows.column("_block").to_numpy(), size)


def _answer_anchors(hot_segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by("bucket", batches):
            anchor = _numbers(rows.column("anchor"), np.uint64)
            order = np.argsort(anchor, kind="stable")
            block = _repeat_of(rows, "anchor", 8)[order]
            anchor, first = anchor[order], _groups(anchor[order])
            low = np.minimum.reduceat(_numbers(rows.column("low"), np.int64)[order], first)
            high = np.maximum.reduceat(_numbers(rows.column("high"), np.int64)[order], first)
            total = np.add.reduceat(_numbers(rows.column("n"), np.int32)[order].astype(np.int64), first)
            size = np.diff(np.append(first, len(anchor)))
            keep = np.repeat(low < high, size)
            hot = np.repeat(total > hot_segments, size)[keep]
            block, anchor = block[keep], anchor[keep]
            order = np.lexsort((hot, block))
            block, anchor, hot = block[order], anchor[order], hot[order]
            at = np.append(_groups(block), len(block))
            cold = np.array([a + np.count_nonzero(~hot[a:b]) for a, b in zip(at[:-1], at[1:])], dtype=np.int64)
            yield pa.RecordBatch.from_pydict({
                "_block": pa.array(block[at[:-1]], pa.int64()),
                "cold": pa.array([_packed(anchor[a:m]) for a, m in zip(at[:-1], cold)], pa.binary()),
                "hot": pa.array([_packed(anchor[m:b]) for m, b in zip(cold, at[1:])], pa.binary())})
    return run


# ---- 2. first owners of windows

def _among(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Where each of ``x`` stands in the sorted ``some``, -1 if it does not."""
    if not len(some):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(some, x), len(some) - 1)
    return np.where(some[at] == x, at, -1)


_UNITS = pa.schema([("receiver", pa.int32()), ("_block", pa.int64()), ("seg", pa.binary()), ("id", pa.binary()),
                    ("size", pa.binary()), ("shard", pa.binary()), ("text", pa.binary())])


def _send_segments(receivers: int, shards: int):
    """``shards`` is their number in each receiver."""
    def run(key, docs: pa.Table, told: pa.Table) -> pa.Table:
        if not told.num_rows or not docs.num_rows:
            return _UNITS.empty_table()
        data, bounds = _texts(docs.column("text"))
        start, count, anchor, seg = segments(data, bounds)
        ids = _owner_ids(docs.column("_id").combine_chunks().to_numpy(), bounds, start)
        whole = _among(anchor, np.sort(_numbers(told.column("cold"), np.uint64))) >= 0
        apart = _among(anchor, np.sort(_numbers(told.column("hot"), np.uint64))) >= 0
        at = _spread(start[apart], count[apart])
        own = _window_hashes(data, at)
        # A segment goes by its anchor, a window by itself.
        dealt = np.concatenate([_mixed(anchor[whole]), _mixed(own)])
        seg = np.concatenate([seg[whole], own])
        ids = np.concatenate([ids[whole], np.repeat(ids[apart], count[apart])])
        size = np.concatenate([count[whole] + WINDOW - 1, np.full(len(at), WINDOW)])
        start = np.concatenate([start[whole], at])
        if not len(seg):
            return _UNITS.empty_table()
        order = np.argsort(seg)
        first = _groups(seg[order])
        pick, low = order[first], np.minimum.reduceat(ids[order], first)
        shard = _part(dealt[pick], receivers * shards)
        order = np.argsort(shard, kind="stable")
        pick, low, shard = pick[order], low[order], shard[order]
        receiver = shard // shards
        cut = np.append(_groups(receiver), len(receiver))
        text = data[_spread(start[pick], size[pick])]
        ends = np.concatenate([[0], np.cumsum(size[pick])])
        cols = {"seg": seg[pick], "id": low, "size": size[pick].astype(np.uint8),
                "shard": (shard - receiver * shards).astype(np.uint16)}
        return pa.Table.from_pydict({
            "receiver": pa.array(receiver[cut[:-1]], pa.int32()),
            "_block": pa.array(np.full(len(cut) - 1, key[0].as_py()), pa.int64()),
            **{n: pa.array([_packed(c[a:b]) for a, b in zip(cut[:-1], cut[1:])], pa.binary())
               for n, c in cols.items()},
            "text": pa.array([text[ends[a]:ends[b]].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
        }, schema=_UNITS)
    return run


def _answer_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _by("receiver", batches):
        seg = _numbers(rows.column("seg"), np.uint64)
        ids = _numbers(rows.column("id"), np.int64)
        size = _numbers(rows.column("size"), np.uint8).astype(np.int64)
        shard = _numbers(rows.column("shard"), np.uint16)
        text = _numbers(rows.column("text"), np.uint8)
        block = _repeat_of(rows, "seg", 8)
        order = np.argsort(seg)
        begun = _groups(seg[order])
        first, owner = order[begun], np.minimum.reduceat(ids[order], begun)
        unit = np.empty(len(seg), dtype=np.int64)
        unit[order] = np.repeat(np.arange(len(first)), np.diff(np.append(begun, len(seg))))
        place, length = (np.cumsum(size) - size)[first], size[first]
        by_shard = np.argsort(shard[first], kind="stable")
        cuts = np.append(_groups(shard[first][by_shard]), len(first))
        run_first, run_count = np.empty(len(first), dtype=np.int64), np.empty(len(first), dtype=np.int64)
        sizes, told, n = [], [], 0
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = by_shard[a:b]
            data = text[_spread(place[own], length[own])]
            # The index is built on the different segments of the shard, which also stream against it.
            owners, offset = RunIndex(data, length[own], owner[own], WINDOW).first_owners(data, length[own], _NONE)
            new = np.concatenate([[True], owners[1:] != owners[:-1]])
            new[offset] = True
            runs = np.flatnonzero(new)
            at = np.searchsorted(runs, offset)
            run_first[own], run_count[own] = at + n, np.diff(np.append(at, len(runs)))
            sizes.append(np.diff(np.append(runs, len(owners))).astype(np.uint8))
            told.append(owners[runs])
            n += len(runs)
        run_size, run_owner = np.concatenate(sizes), np.concatenate(told)
        order = np.argsort(block, kind="stable")
        block, unit, seg = block[order], unit[order], seg[order]
        at = np.append(_groups(block), len(block))
        out: dict[str, list] = {"_block": [], "seg": [], "count": [], "size": [], "owner": []}
        for a, b in zip(at[:-1], at[1:]):
            u = unit[a:b]
            r = _spread(run_first[u], run_count[u])
            out["_block"].append(int(block[a]))
            out["seg"].append(_packed(seg[a:b]))
            out["count"].append(_packed(run_count[u].astype(np.uint8)))
            out["size"].append(_packed(run_size[r]))
            out["owner"].append(_packed(run_owner[r]))
        yield pa.RecordBatch.from_pydict(
            {n: pa.array(v, pa.int64() if n == "_block" else pa.binary()) for n, v in out.items()})


# ---- 3. cutting

def _covered(data: np.ndarray, bounds: np.ndarray, ids: np.ndarray, told: pa.Table) -> np.ndarray:
    """Which bytes a window with an earlier owner covers."""
    edge = np.zeros(len(data) + 1, dtype=np.int32)
    seg_of = _numbers(told.column("seg"), np.uint64)
    if len(seg_of):
        order = np.argsort(seg_of)
        count = _numbers(told.column("count"), np.uint8).astype(np.int64)
        size = _numbers(told.column("size"), np.uint8).astype(np.int64)
        owner = _numbers(told.column("owner"), np.int64)
        run_first = np.cumsum(count) - count
        begun = np.cumsum(size) - size
        begun = begun - np.repeat(begun[run_first], count)
        start, windows, anchor, seg = segments(data, bounds)
        own = _owner_ids(ids, bounds, start)
        apart = _among(anchor, np.sort(_numbers(told.column("hot"), np.uint64))) >= 0
        at = _spread(start[apart], windows[apart])
        place = np.concatenate([start[~apart], at])
        own = np.concatenate([own[~apart], np.repeat(own[apart], windows[apart])])
        found = _among(np.concatenate([seg[~apart], _window_hashes(data, at)]), seg_of[order])
        hit = found >= 0
        unit = order[found[hit]]
        r = _spread(run_first[unit], count[unit])
        per = count[unit]
        place, own = np.repeat(place[hit], per), np.repeat(own[hit], per)
        gone = owner[r] < own
        first = place[gone] + begun[r[gone]]
        np.add.at(edge, first, 1)
        np.add.at(edge, first + size[r[gone]] + WINDOW - 1, -1)
    return np.cumsum(edge, out=edge)[:-1] > 0


_SPAN = pa.struct([("first", pa.int64()), ("last", pa.int64())])


def _cut(schema: pa.Schema):
    def run(key, docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        data, bounds = _texts(docs.column("text"))
        data, bounds = data[bounds[0]:bounds[-1]], bounds - bounds[0]
        gone = _covered(data, bounds, docs.column("_id").combine_chunks().to_numpy(), told)
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[bounds] = True                                     # spans end with their text
        fresh = gone & (np.concatenate([[True], ~gone[:-1]]) | edge[:-1])[:len(gone)]
        begins = np.flatnonzero(fresh)
        ends = np.flatnonzero(gone & (np.concatenate([~gone[1:], [True]]) | edge[1:])[:len(gone)]) + 1
        per = np.searchsorted(begins, bounds)
        text_of = np.repeat(np.arange(len(bounds) - 1), np.diff(per))
        removed = np.concatenate([[0], np.cumsum(ends - begins)])[per]
        kept = (bounds - removed).astype(np.int32)
        spans = pa.StructArray.from_arrays([pa.array(begins - bounds[text_of]), pa.array(ends - bounds[text_of])],
                                           fields=list(_SPAN))
        rest = pa.Array.from_buffers(pa.binary(), len(kept) - 1,
                                     [None, pa.py_buffer(kept), pa.py_buffer(np.ascontiguousarray(data[~gone]))])
        return pa.Table.from_arrays([
            docs.column("doc_id").combine_chunks(), pa.array(np.diff(bounds)), pa.array(np.diff(removed)),
            pa.array(np.diff(per)), pa.ListArray.from_arrays(pa.array(per.astype(np.int32)), spans), rest], schema=schema)
    return run


def remove_repeats(docs: DataFrame, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (first, last + 1) and the kept bytes of every row of ``docs``."""
    with dropping_shuffles(docs.sparkSession):
        return _remove_repeats(docs, hot_segments)


def _remove_repeats(docs: DataFrame, hot_segments: int) -> DataFrame:
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks, receivers, buckets = (max(least, min(4 * least, SPREAD), total // each)
                                  for each in (BLOCK_BYTES, RECEIVER_BYTES, BUCKET_BYTES))
    shards = -(-total // (SHARD_BYTES * receivers)) or 1
    d = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_id"), "text")
    # Numbering the rows keeps many repeats of one row apart; the table is written before it is read.
    dealt = F.xxhash64("_id", F.monotonically_increasing_id())
    d = d.withColumn("_block", F.pmod(dealt, F.lit(blocks)))
    d = stage_bucketed(d, "suffix_docs", ["_block"], max(least, total // FILE_BYTES))

    sent = d.sortWithinPartitions("_block").select("_block", "_id", "text").mapInArrow(
        _send_anchors(buckets), "bucket int, _block long, anchor binary, low binary, high binary, n binary")
    told = stage(sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        _answer_anchors(hot_segments), "_block long, cold binary, hot binary"), "suffix-anchors")

    units = d.select("_block", "_id", "text").groupBy("_block").cogroup(told.groupBy("_block")).applyInArrow(
        _send_segments(receivers, shards),
        "receiver int, _block long, seg binary, id binary, size binary, shard binary, text binary")
    owners = stage(units.repartition("receiver").sortWithinPartitions("receiver").mapInArrow(
        _answer_segments, "_block long, seg binary, count binary, size binary, owner binary"), "suffix-owners")

    answers = owners.withColumn("hot", F.lit(None).cast("binary")).unionByName(
        told.filter(F.octet_length("hot") > 0).select("_block", "hot"), allowMissingColumns=True)
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {doc_id}, n_bytes long, n_removed long, n_spans long, " \
             "spans array<struct<first: bigint, last: bigint>>, kept binary"
    kind = spark.createDataFrame([], f"doc_id {doc_id}").toArrow().schema.field("doc_id").type
    schema = pa.schema([("doc_id", kind), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                        ("n_spans", pa.int64()), ("spans", pa.list_(_SPAN)), ("kept", pa.binary())])
    return d.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(_cut(schema), fields)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 50-byte strings of earlier documents."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

"""The run-length index and the removal of earlier byte strings, against brute force."""

import hashlib
import random

import numpy as np
import pytest

from dockwatch.llm import suffix_dedup as sd
from dockwatch.llm.rindex import RunIndex


def _brute(rows):
    data = [(i if i is not None else -(1 << 63), i, (t or "").encode()) for i, t in rows]
    first = {}
    for key, _, b in data:
        for k in range(len(b) - 49):
            w = b[k:k + 50]
            if first.get(w, key) >= key:
                first[w] = key
    out = []
    for key, i, b in data:
        keep = bytearray(b"\x01" * len(b))
        for k in range(len(b) - 49):
            if first[b[k:k + 50]] < key:
                keep[k:k + 50] = bytes(50)
        spans = sum(1 for k in range(len(b)) if not keep[k] and (k == 0 or keep[k - 1]))
        rest = bytes(x for x, k in zip(b, keep) if k)
        out.append((i, len(b), len(b) - len(rest), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def _got(df, **how):
    out = []
    for r in sd.remove_repeats(df, **how).collect():
        assert sum(s["last"] - s["first"] for s in r["spans"]) == r["n_removed"] and len(r["spans"]) == r["n_spans"]
        out.append((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"],
                    hashlib.sha256(bytes(r["kept"])).hexdigest()))
    return sorted(out, key=str)


def _rows():
    rng = random.Random(4)
    make = lambda n, a="abcdefgh é中 ": "".join(rng.choice(a) for _ in range(n))
    passage, line = make(120), make(46, "abcdefgh ")
    rows = [(i, make(rng.randint(0, 300)) + (passage[rng.randint(0, 60):rng.randint(61, 120)] if i % 3 else "")
             + make(rng.randint(0, 80))) for i in range(60)]
    rows += [(100 + i, make(30) + line + make(30)) for i in range(40)]         # shorter than a window, very common
    rows += [(150 + i, make(3) + passage + make(5)) for i in range(30)]
    rows += [(200, "a" * 500), (201, "a" * 49), (202, "a" * 50), (203, "ab" * 200), (204, "b" + "ab" * 40), (205, "\0" * 80),
             (206, "\0" * 50), (207, passage), (208, passage), (208, passage), (207, passage + "x"),
             (209, None), (210, ""), (None, passage), (None, None), rows[5], rows[5]]
    return rows


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.mark.parametrize("hot", [sd.HOT_SEGMENTS, 20, 1])
def test_matches_brute_force(spark, rows, hot):
    df = spark.createDataFrame([(*r, "t", 5, None, 1) for r in rows],
                               "doc_id long, text string, kept string, n int, _block string, _id int").repartition(4)
    assert _got(df, hot_segments=hot) == _brute(rows)


def test_rows_that_travel_do_not_grow_with_blocks_times_shards(spark, monkeypatch):
    """All sizes are a 256th, so that this megabyte is dealt as 256 are."""
    for name in ("BLOCK_BYTES", "SHARD_BYTES", "RECEIVER_BYTES", "BUCKET_BYTES", "FILE_BYTES"):
        monkeypatch.setattr(sd, name, getattr(sd, name, 0) >> 8, raising=False)
    sent = {}

    def counted(df, name, write=sd.stage):
        out = write(df, name)
        sent[name] = out.count()
        return out

    monkeypatch.setattr(sd, "stage", counted)
    rng = random.Random(9)
    make = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passages = [make(400) for _ in range(300)]
    rows = []
    for i in range(1000):
        at = rng.randint(0, 200)
        rows.append((i, make(700) + rng.choice(passages)[at:at + 300] + make(20)))
    assert _got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == _brute(rows)
    assert 0 < sent["suffix-anchors"] <= 1500 and 0 < sent["suffix-owners"] <= 1500


def test_texts_longer_than_a_chunk(spark):
    rng = np.random.default_rng(3)
    long = rng.integers(97, 123, sd.CHUNK + 70_000, dtype=np.uint8).tobytes().decode()
    changed = long[:500_000] + "#" + long[500_000:]
    rows = [(1, long), (2, changed), (3, long[sd.CHUNK - 60:sd.CHUNK + 60]), (4, "~" + long[:200])]
    assert _got(spark.createDataFrame(rows, "doc_id int, text string")) == _brute(rows)


def test_no_rows_and_no_long_texts(spark):
    df = spark.createDataFrame([(1, "short"), (2, None)], "doc_id long, text string")
    assert [r[:4] for r in _got(df)] == [(1, 5, 0, 0), (2, 0, 0, 0)]
    assert _got(df.limit(0)) == []


def _flat(units):
    return np.frombuffer(b"".join(units), np.uint8), np.array([len(u) for u in units])


@pytest.mark.parametrize("seed", range(12))
def test_index_gives_matching_statistics(seed):
    rng = random.Random(seed)
    alphabet = [b"ab", b"abcd", bytes([0, 1, 255])][seed % 3]
    make = lambda n: bytes(rng.choice(alphabet) for _ in range(n))
    base, units = make(120), []
    for _ in range(rng.randint(1, 20)):
        at = rng.randint(0, 60)
        u = bytearray(base[at:at + rng.randint(1, 60)])
        u[rng.randrange(len(u))] = rng.choice(alphabet)
        units.append(bytes(u))
    owner = np.array([rng.randint(0, 50) for _ in units])
    index = RunIndex(*_flat(units), owner, 30)
    patterns = [make(rng.randint(1, 80)) for _ in range(4)] + [base, b"zz" + base] + units
    got = {}
    for place, which, length, _ in index.stream(*_flat(patterns)):
        got |= {(p, len(patterns[p]) - place): n for p, n in zip(which, length)}
    owners, offset = index.first_owners(*_flat(patterns), -1)
    for p, s in enumerate(patterns):
        for i in range(len(s)):
            n = 0
            while i + n < len(s) and any(s[i:i + n + 1] in u for u in units):
                n += 1
            assert got[p, i] == n
            if i + 30 <= len(s):
                holds = [o for o, u in zip(owner, units) if s[i:i + 30] in u]
                assert owners[offset[p] + i] == min(holds, default=-1)


def test_repeats_fall_into_the_same_runs():
    unit = np.random.default_rng(1).integers(97, 101, 70).astype(np.uint8).tobytes()
    once = RunIndex(*_flat([unit]), np.zeros(1, int), 50).runs
    copies = [unit] * 200 + [unit[:35] + b"z" + unit[35:]]
    assert RunIndex(*_flat(copies), np.zeros(201, int), 50).runs < 3 * once

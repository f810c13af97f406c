"""Operators on documents against brute force, on odd rows, repeats and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from dockwatch.llm import (licenses, mixing, packing, sharding, simhash, substring, tokens, toxicity)
from dockwatch.llm.fmindex import FMIndex, repeated_intervals

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {ord(a): ord(a) + 32 for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_simhash_against_brute_force(docs, doc_rows):
    def fp(text):
        w = WORD.findall((text or "").translate(LOWER))
        h = [xxhash.xxh64(" ".join(w[i:i + 3]).encode(), 42).intdigest() for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))

    got = rows_of(simhash.near_duplicates(docs))
    assert len(got) == len(doc_rows)
    want = Counter((r[0], fp(r[1])) for r in doc_rows)
    assert Counter((r["doc_id"], r["fp"] % (1 << 64)) for r in got) == want
    fps = sorted({f for _, f in want})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 3:
                root[find(b)] = find(a)
    ids = defaultdict(list)
    for d, f in want:
        ids[find(f)].append(d)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    for r in got:
        assert r["component_id"] == least[find(r["fp"] % (1 << 64))]
    assert len({find(f) for f in fps}) < len(fps)                # something did link
    kept = rows_of(simhash.keep_one(docs))
    assert len(kept) == len({find(f) for f in fps})
    assert set(kept[0]) == set(docs.columns)


def test_simhash_links_by_balls(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40)
    fps = [int(b) for b in base]
    for b in base[:20]:
        for n in (1, 3, 4):
            f = int(b)
            for bit in rng.permutation(63)[:n]:
                f ^= 1 << int(bit)
            fps.append(f)
    fps = sorted(set(fps))
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    assert got == {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3}


def test_simhash_links_broadcast_no_exploded_rows(spark):
    df = simhash.links(spark.range(1000).select(F.xxhash64("id").alias("fp")))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


@pytest.mark.parametrize("hot", [5_000, 1])
def test_substring_against_brute_force(docs, doc_rows, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT_SEGMENTS", hot)          # 1: nearly every anchor is taken apart
    places = Counter()
    words = [(r[1] or "").encode().split() for r in doc_rows]
    for w in words:
        places.update(tuple(w[i:i + 35]) for i in range(len(w) - 34))
    want = Counter()
    for r, w in zip(doc_rows, words):
        keep = [True] * len(w)
        for i in range(len(w) - 34):
            if places[tuple(w[i:i + 35])] > 1:
                keep[i:i + 35] = [False] * 35
        kept = b" ".join(x for x, k in zip(w, keep) if k).decode()
        want[(r[0], len(w), keep.count(False), None if r[1] is None else kept)] += 1
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"])
                  for r in rows_of(substring.remove_repeats(docs)))
    assert got == want
    assert sum(k[2] > 0 for k in want) > 5


@pytest.mark.parametrize("seed", range(8))
def test_fm_index_finds_all_repeats(seed):
    rng = np.random.default_rng(seed)
    units = [rng.integers(1, 2 + seed * 40, rng.integers(1, 60)).astype(np.uint64) for _ in range(40)]
    weights = rng.integers(1, 3, 40)
    seen = Counter()
    for u, w in zip(units, weights):
        seen.update({k: int(w) * n for k, n in Counter(u[i:i + 6].tobytes() for i in range(len(u) - 5)).items()})
    want = {(k, i) for k, u in enumerate(units) for i in range(len(u) - 5) if seen[u[i:i + 6].tobytes()] > 1}
    got = {(int(k), i) for k, a, b in zip(*repeated_intervals(FMIndex(units, weights), 6)) for i in range(a, b - 4)}
    assert got == want


def test_packing_is_whole_and_tight(docs, doc_rows):
    enc = tokens.encoder(tokens.default_path())
    want = Counter()
    for r in doc_rows:
        ids = np.array([*enc.tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        first = len(ids) % 2048 or 2048
        for k, at in enumerate([0, *range(first, len(ids), 2048)]):
            part = ids[at:at + (2048 if k else first)]
            want[(r[0], k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    got = rows_of(packing.placed(docs))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 2048
    total = sum(k[3] * n for k, n in want.items())
    assert len(bins) <= -(-total // 2048) + 2


def test_local_search_empties_bins():
    best = packing.best_fit({6: 2, 4: 1, 3: 3, 2: 1}, 10)
    assert sum(best.values()) >= 3
    poor = Counter({(6, 2): 1, (6, 1): 1, (4, 1): 1, (3, 3): 1})
    better = packing.local_search(poor, 10)
    assert sum(better.values()) == 3
    assert sorted(x for p, n in better.items() for x in p * n) == sorted(x for p, n in poor.items() for x in p * n)


def _helps(a, b, length):
    """Whether moving at most two pieces against at most one raises the sum of squared fills."""
    for one, two in ((a, b), (b, a)):
        gives = [c for n in (1, 2) for c in combinations(one, n)]
        for out in gives:
            for back in [(), *((y,) for y in two)]:
                d = sum(out) - sum(back)
                if sum(two) + d <= length and d * (sum(two) - sum(one) + d) > 0 and sum(one) - d <= length:
                    return True
    return False


def test_local_search_looks_at_every_underfull_pattern():
    """The twenty emptiest patterns help nobody, the two after them each other."""
    bins = Counter({(51 + i,): 1 for i in range(20)} | {(71, 1): 1, (72, 3): 1})
    better = packing.local_search(bins, 100)
    assert better[(72, 3, 1)] == better[(71,)] == 1
    assert not any(_helps(a, b, 100) for a, b in combinations(better.elements(), 2))


def test_local_search_sees_every_pair_of_pieces_and_has_no_last_round():
    rng = random.Random(8)
    for length, most, n in ((100, 12, 60), (2048, 90, 60), (2048, 1500, 700)):
        for _ in range(3):
            bins = Counter()
            for _ in range(n):
                p = []
                while not p or rng.random() < 0.9:
                    p.append(rng.randint(1, most))
                while sum(p) > length:
                    p.pop()
                bins[tuple(sorted(p, reverse=True))] += 1
            better = packing.local_search(bins, length)
            pieces = lambda c: sorted(x for p in c.elements() for x in p)
            assert pieces(better) == pieces(bins) and max(map(sum, better)) <= length
            least = -(-sum(pieces(bins)) // length)
            some = list(better.elements())
            assert len(some) == least or not any(_helps(a, b, length) for a, b in combinations(some, 2))


def test_tokens_equal_the_tokenizer():
    enc = tokens.encoder(tokens.default_path())
    rng = np.random.default_rng(0)
    signs = list(" \t\n\r\x0b\x0c\x1c\x85\xa0'stremvld.,!?09²½ aéßñÀ́中A<|>")
    for _ in range(400):
        t = "".join(rng.choice(signs, rng.integers(0, 30)))
        assert enc.encode(t) == enc.whole(t)
    assert enc.encode("a<|endoftext|>b") == enc.whole("a<|endoftext|>b")


def test_mixing_meets_targets(docs, doc_rows):
    got = rows_of(mixing.mix(docs))
    assert len(got) == len(doc_rows)
    size = Counter()
    for r in doc_rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    names = sorted([s for s in size if s is not None]) + [None]
    weight = dict(zip(names, [5, 2, 1] * 9))
    total, target, free = sum(size.values()), {}, dict(size)
    while True:                                     # stop at three times, share the rest again
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] > 3 * size[s]]
        if not full:
            break
        for s in full:
            target[s] = 3.0 * free.pop(s)
    target |= {s: level * weight[s] for s in free}
    taken, largest = Counter(), Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in size:
        assert abs(taken[s] - target[s]) <= max(60, 0.02 * target[s], 0.5 * largest[s])
    key = lambda r: (str(r["doc_id"]), r["text_key"], r["copies"])
    assert sorted(map(key, rows_of(mixing.mix(docs.repartition(3))))) == sorted(map(key, got))
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns and rows.count() == sum(r["copies"] for r in got)


def test_licenses_against_brute_force(docs, doc_rows):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = Counter()
    for r in doc_rows:
        w = word.findall((r[1] or "").translate(LOWER))
        found = [(i, label) for p, label in licenses.PHRASES.items() for q in [p.split()]
                 for i in range(len(w) - len(q) + 1) if w[i:i + len(q)] == q]
        want[(r[0], len(w), len(found), min(found)[0] if found else None, max(found)[0] if found else None,
              ",".join(sorted({x for _, x in found})))] += 1
    got = rows_of(licenses.scan(docs))
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
                   for r in got) == want
    assert any("mit" in r["labels"] for r in got)                # the edited notice
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_sharding(docs, doc_rows):
    got = rows_of(sharding.place(docs, "doc_id", sharding.shard_names(5), slots=101))
    table = sharding.lookup_table(sharding.shard_names(5), 101)
    assert len(got) == len(doc_rows)
    for r in got:
        slot = int(hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:15], 16) % 101
        assert (r["slot"], r["shard"]) == (slot, f"shard-{table[slot]:04d}")
    n = np.bincount(table)
    assert n.max() - n.min() <= 1
    fewer = sharding.lookup_table(sharding.shard_names(4), 101)
    assert (table[table < 4] == fewer[table < 4]).mean() > 0.6   # most slots stay
    twice = np.bincount(sharding.lookup_table(["a", "b"], 101, [2, 1]))
    assert 1.8 < twice[0] / twice[1] < 2.2
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 100)


def test_toxicity_learns_and_scores(spark):
    rng = np.random.default_rng(2)
    plain = ["".join(rng.choice(list("abcdef"), rng.integers(2, 6))) for _ in range(300)]
    rows, labels = [], []
    for i in range(260):
        w = list(rng.choice(plain, rng.integers(5, 120)))
        bad = i % 3 == 0
        for at in range(0, len(w), 25) if bad else []:
            w[at] = "zonk" + str(rng.choice(plain))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(900, None), (901, ""), (902, "..."), (None, "zonk " * 9), (903, "a " * 40_000), (0, rows[0][1])]
    labels += [(3, None), (904, 1), (None, 1), (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = rows_of(toxicity.scored(docs, toxicity.fit(docs, known)).withColumn("h", toxicity.held_out()))
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["h"] and r["doc_id"] is not None and r["doc_id"] < 260]
    assert len(held) > 30
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 3 == 0) for r in held]) > 0.9
    assert all(r["score"] == 0 for r in out if r["doc_id"] in (900, 901, 902))
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out if r["doc_id"] is not None)


def test_windows_cover_every_word():
    for n in (1, 47, 48, 49, 80, 81, 500):
        s = toxicity.starts(n)
        assert {i for k in s for i in range(k, min(n, k + toxicity.WINDOW))} == set(range(n))


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity._new(rng).items()}
    x = rng.normal(size=(9, toxicity.DIM))
    pos = rng.integers(0, 9, (5, 3))
    mask = np.ones((5, 3), dtype=bool)
    mask[3:, 1] = False
    up = rng.normal(size=3)
    _, kept = toxicity._forward(p, x, pos, mask, keep=True)
    g, d_x = toxicity._backward(p, x, pos, mask, up, kept)
    loss = lambda: float(toxicity._forward(p, x, pos, mask)[0] @ up)
    for name, d in [*g.items(), ("x", d_x)]:
        a = x if name == "x" else p[name]
        at = tuple(rng.integers(0, n) for n in a.shape)
        old, h = a[at], 1e-3
        a[at] = old + h
        hi = loss()
        a[at] = old - h
        lo = loss()
        a[at] = old
        assert d[at] == pytest.approx((hi - lo) / (2 * h), abs=2e-3), name


def test_empty_tables(spark, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(no_docs, none) is None
    for out in (simhash.near_duplicates(no_docs), simhash.keep_one(no_docs), mixing.mix(no_docs),
                mixing.mixed_rows(no_docs), substring.remove_repeats(no_docs), packing.placed(no_docs),
                toxicity.scored(no_docs, None), sharding.place(no_docs, "doc_id", ["a"]), licenses.scan(no_docs)):
        assert out.count() == 0

"""The near-duplicate stage against brute force on planted near copies."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline as cp
from dockwatch.llm import near, simhash
from dockwatch.session import stage


def _sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def _groups(texts):
    sets = [_sets(t) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if group[i] != group[j] and (_alike(sets[i], sets[j]) if sets[i] or sets[j] else True):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    members = defaultdict(list)
    for i, g in enumerate(group):
        members[g].append(i)
    return members


def test_near_copies_leave_one(spark):
    rng = random.Random(11)
    texts = []
    for n in [30, 60, 60, 120, 200, 200, 200, 400, 600]:
        base = [f"w{rng.randrange(5000)}" for _ in range(n)]
        texts.append(" ".join(base))
        for edits in (1, 2, 4, 6, 13):
            w = list(base)
            for at in rng.sample(range(n), edits):
                w[at] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(w))
            texts.append(" ".join(w[:-1]))
    texts += [None, "", " \n", "one", "One", "two words", texts[0].upper()]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (3, texts[3])]
    got = cp.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "")
    members = _groups(texts)
    assert max(len(m) for m in members.values()) > 4
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(min(m) for m in members.values())


def _kept(spark, texts):
    df = spark.createDataFrame([(i, t, i, "k", "r") for i, t in enumerate(texts)],
                               "doc_id long, text string, n long, key string, root string").repartition(3)
    out = near.keep_one(df)
    assert out.columns == df.columns
    return sorted(r["doc_id"] for r in out.collect())


def test_copies_of_an_absent_and_of_a_present_original(spark):
    """Copies at 0.85 of their original and 0.73 of each other: one group only where the original is there."""
    rng = random.Random(5)
    texts = []
    for keep in (True, False):
        base = [f"b{rng.randrange(10**6)}" for _ in range(205)]
        texts += [" ".join(base)] if keep else []
        for _ in range(25):
            w = list(base)
            for at in range(2, 205, 68):
                w[at + rng.randrange(60)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    assert _kept(spark, texts) == sorted(min(m) for m in _groups(texts).values())


def test_texts_that_share_a_passage_are_few_candidates(spark):
    """Half of each text is one passage: no links, and no work that grows with the square of their number."""
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [passage + " " + " ".join(f"u{rng.randrange(10**7)}" for _ in range(60)) for _ in range(300)]
    texts.append("long " * 40_000)
    assert _kept(spark, texts) == list(range(301))


def test_no_rows(spark):
    assert near.keep_one(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_whole_table(spark):
    """All pairs of a given table, as it is."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    want = [min(rows[i][0] for i in m) for m in _groups([t for _, t in rows]).values()]
    assert sorted(r["doc_id"] for r in near.keep_one(docs).collect()) == sorted(want) and len(want) < len(rows)


def test_close_fingerprints_are_candidates_of_their_own(spark):
    """Without any bands, alike texts within three bits are in one group, and no group holds others."""
    rng = random.Random(12)
    texts = []
    for _ in range(8):
        base = [f"w{rng.randrange(5000)}" for _ in range(300)]
        texts.append(" ".join(base))
        for _ in range(9):
            w = list(base)
            w[rng.randrange(300)] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    d = near.keyed(df).select("doc_id", "_id", "_key", near._sketch("text").alias("s"),
                              simhash.fingerprint("text").alias("fp"))
    d = stage(d.select("doc_id", "_id", "_key", "s.node", "s.n", F.array().cast("array<long>").alias("bands"), "fp"), "t")
    root = {r["node"]: r["root"] for r in near.groups(df, d).collect()}
    of = {r["doc_id"]: root.get(r["node"], r["node"]) for r in d.collect()}
    sets = [_sets(t) for t in texts]
    fp = [simhash.text_fingerprint(t) for t in texts]
    linked = [(i, j) for i in range(len(texts)) for j in range(i)
              if (fp[i] ^ fp[j]).bit_count() <= 3 and _alike(sets[i], sets[j])]
    assert len(linked) > 20 and all(of[i] == of[j] for i, j in linked)
    for m in _groups(texts).values():
        assert not {of[i] for i in m} & {of[i] for i in range(len(texts)) if i not in m}


def test_members_far_from_the_original_meet_few_others(spark, monkeypatch):
    """Copies with four changed words link to nothing: they are ruled out without meeting every other copy."""
    rng = random.Random(13)
    base = [f"b{rng.randrange(10**6)}" for _ in range(150)]
    texts = [" ".join(base)]
    for k in range(240):
        w = list(base)
        for at in range(5, 150, 37):
            w[at + rng.randrange(30)] = f"x{rng.randrange(10**7)}"
        texts.append(" ".join(w if k % 3 else w[:80] + base[80:]))
    seen = []
    compared = near._compared

    def counted(pairs, sets):
        seen.append(pairs.count())
        return compared(pairs, sets)

    monkeypatch.setattr(near, "_compared", counted)
    members = _groups(texts)
    assert len(members) > 100
    assert _kept(spark, texts) == sorted(min(m) for m in members.values())
    assert sum(seen) < 8 * len(texts)

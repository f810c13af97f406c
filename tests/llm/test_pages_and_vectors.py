"""WARC round trips, top-k search and vector joins against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from dockwatch.llm import embedding_dedup, topk, warc

PAGES = "page_id long, url string, html string, digest string, n int"
VECTORS = "vec_id long, embedding array<float>, label int, pos int, z string"


def page_rows():
    long, text = "<p>" + "ä" * 120 + "</p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nxyz", "short"
    rows = [(5, "http://a.example/x?y=1#z", long), (3, "http://b.example", long), (9, None, long),
            (1, "http://c.example/", text), (2, "http://d.example/\r\nX-Bad: 1", text), (4, "", None),
            (6, "http://e.example/", ""), (None, "http://f.example/", long), (None, None, "q" * 500),
            (7, "http://g.example/", "z" * 2_000_000), (8, "http://h.example/", "k" * 99),
            (10, "http://h.example/", "k" * 99), (3, "http://b.example", long)]
    return [(*r, "x", 1) for r in rows]


def test_warc_round_trip(spark, tmp_path):
    rows = page_rows()
    path = f"{tmp_path}/archives"
    warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(3), path)
    got = [r.asDict(recursive=True) for r in warc.captures(warc.read_archives(spark, path)).collect()]
    assert len(got) == len(rows)
    seen = []
    for r in got:
        res, fields = r["response"], r["metadata"]["fields"] or {}
        page = int(fields["page_id"]) if "page_id" in fields else None
        refers = int(fields["refers_to"]) if "refers_to" in fields else None
        assert r["request"]["record_id"] != r["record_id"]
        if res["type"] == "response":
            assert hashlib.sha256(bytes(res["payload"])).hexdigest() == res["payload_digest"]
            assert len(res["payload"]) == res["payload_bytes"]
        seen.append((page, res["payload_bytes"], res["payload_digest"], res["type"], refers))
    want = []
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        first = min((p for p, _, h, *_ in rows if h == html and p is not None), default=None)
        again = len(data) >= 100 and first is not None and page != first
        want.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response",
                     first if again else None))
    key = lambda r: tuple(map(str, r))
    assert sorted(seen, key=key) == sorted(want, key=key)


def vector_rows():
    rng = np.random.default_rng(4)
    rows, n = [], 0

    def add(v, label, vid=None):
        nonlocal n
        n += 1
        rows.append((n if vid is None else vid, None if v is None else [None if x is None else float(x) for x in v],
                     label, 1, "x"))

    for label in (0, 1):
        for _ in range(60):
            base = rng.normal(size=8)
            for k in range(rng.integers(1, 5)):
                add(base + rng.normal(size=8) * 0.05 * k, label)
    chain = [[np.cos(a), np.sin(a), 0, 0, 0, 0, 0, 0] for a in np.arange(0, 1.5, 0.15)]
    for v in chain:
        add(v, 3)
    for _ in range(5):
        add([1, 2, 3, 4, 5, 6, 7, 8], 0)
    rows.append(rows[0])
    add([1, 2, 3], 0)
    for odd in (None, [], [0] * 8, [float("nan")] + [1] * 7, [float("inf")] + [1] * 7, [None] + [1] * 7):
        add(odd, 0)
    add([1, 2, 3, 4, 5, 6, 7, 8], None)
    rows.append((None, [float(x) for x in range(1, 9)], 0, 1, "x"))
    return rows


def clean(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def padded(v):
    return np.array([*np.float32(v).astype(float), *[0.0] * (8 - len(v))])


def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 50)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 7)
    rows = vector_rows()
    df = spark.createDataFrame(rows, VECTORS)
    z = [(vid, np.floor(256 * padded(v)).astype(np.int64)) for vid, v, *_ in rows if vid is not None and clean(v)]
    z += [(10, z[0][1] + 1)]                                    # an id with two vectors
    df = df.unionByName(spark.createDataFrame([(10, [float(x) for x in z[-1][1] / 256], 0, 1, "x")], VECTORS))
    want = Counter()
    for n, (q, x) in enumerate(z):
        if q % 5 == 0:
            s = sorted((-int(x @ y), c) for m, (c, y) in enumerate(z) if m != n)[:5]
            want.update((q, k + 1, c, -score) for k, (score, c) in enumerate(s))
    assert sum(q == 10 for q, *_ in want.elements()) == 10
    got = topk.top_k(topk.clean(df), topk.F.col("vec_id") % 5 == 0).collect()
    assert Counter(map(tuple, got)) == want
    few = topk.top_k(topk.clean(df.filter("vec_id < 4")), topk.F.col("vec_id") == 2).collect()
    assert [r["vec_id"] for r in few] == [3, 1, 1]              # fewer candidates than k; a repeated row is one more
    assert topk.top_k(topk.clean(df.limit(0)), topk.F.col("vec_id") > 0).count() == 0


@pytest.mark.parametrize("block", [256, 4])
def test_vector_links_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)        # 4: several levels of intervals
    monkeypatch.setattr(embedding_dedup, "TOP", 8)
    rows = vector_rows()
    n = len(rows)
    link = np.zeros((n, n), dtype=bool)
    ok = [clean(v) and any(v) and label is not None for _, v, label, *_ in rows]
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and rows[i][2] == rows[j][2]:
                a, b = padded(rows[i][1]), padded(rows[j][1])
                link[i, j] = a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98
    root = np.arange(n)
    while True:
        new = np.array([min(root[i], *root[link[i]]) if link[i].any() else root[i] for i in range(n)])
        if (new == root).all():
            break
        root = new
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[root[i]] = min(least.get(root[i], 1 << 60), rows[i][0])
    want = sorted((str(rows[i][0]), int(link[i].sum()), least.get(root[i]), rows[i][0] == least.get(root[i]))
                  for i in range(n))
    out = embedding_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS).repartition(3))
    assert sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in out.collect()) == want
    assert link.sum() > 100


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], VECTORS)
    assert embedding_dedup.near_duplicates(none).count() == 0
    path = f"{tmp_path}/none"
    warc.write_archives(spark.createDataFrame([], PAGES), path)
    assert warc.captures(warc.read_archives(spark, path)).count() == 0

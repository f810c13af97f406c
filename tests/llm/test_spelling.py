"""Spelling variants against brute force, on whole words, typos and odd rows."""

import random
import re
import zlib
from collections import Counter

from dockwatch.llm import spelling as sp


def _near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _brute(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    near = {w: [v for v in n if _near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, form[w], root(w), n[w], len(near[w]), form[w] and n[form[w]]) for w in n)


def _texts():
    rng = random.Random(9)
    letters = "aabbcdeé"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(60)]
    base += ["a" * k for k in range(4, 14)] + ["abcabc" * 3, "abcabc" * 3 + "a", "xÀÿxÀÿx", "xÀÿxàÿx", "x" * 3000,
                                               "x" * 2999, "x" * 1500 + "y" + "x" * 1499]
    words = list(base)
    for w in base[:60]:
        for _ in range(6):
            at = rng.randrange(len(w))
            words.append(rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice(letters) + w[at:],
                                     w[:at] + rng.choice(letters) + w[at + 1:], w + rng.choice(letters)]))
    out = []
    for k, w in enumerate(words):
        out += [w if rng.random() < 0.7 else w.capitalize()] * rng.choice([2, 5, 5, 7, 30, 200])
    # A chain of forms: each occurs five times as often as the one before.
    for w, k in [("chainaaaa", 5), ("chainaaab", 25), ("chainaabb", 125), ("chainabbb", 625), ("chainbbbb", 3125)]:
        out += [w] * k
    rng.shuffle(out)
    return out


def _rows():
    words, rows, at = _texts(), [], 0
    rng = random.Random(2)
    while at < len(words):
        k = rng.randint(1, 60)
        rows.append((len(rows), rng.choice([" ", ", ", "\n", "1"]).join(words[at:at + k])))
        at += k
    return rows + [(None, "chainbbbb chainbbbb"), (7, None), (8, ""), (9, "  9 ×"), rows[0], rows[0]]


def test_matches_brute_force(spark):
    rows = _rows()
    df = spark.createDataFrame([(*r, 1, "w", "f") for r in rows],
                               "doc_id long, text string, n int, word string, node string").repartition(5)
    got = sorted(map(tuple, sp.variants(df).collect()))
    want = _brute(rows)
    assert max(r[4] for r in want) > 5 and sum(r[1] is not None and r[1] != r[2] for r in want) >= 3
    assert got == want


def test_few_words_and_none(spark):
    df = spark.createDataFrame([(1, "single " * 9), (2, None)], "doc_id long, text string")
    assert [tuple(r) for r in sp.variants(df).collect()] == [("single", None, "single", 9, 0, None)]
    assert sp.variants(df.limit(0)).collect() == []

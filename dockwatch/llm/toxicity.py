"""Toxicity of whole texts by a bidirectional gated recurrent network.

A text is read in overlapping windows of WINDOW words. A word enters as the sum
of two inputs, its own vector (frequent words of the sample) and the vectors of
its character 3-grams, so unseen words are read by their spelling. Two gated
recurrent layers read a window forwards and backwards, attention pools their
states, one logit comes out. A text's logit is the largest of all its windows,
made a probability by a two-parameter calibration.

The network is trained here, in numpy, on a bounded sample of labelled rows
(TOXIC_ROWS and CLEAN_ROWS, chosen by a hash of the id, never from the held-out
fifth). In a toxic text not every window is toxic: after two rounds only its
most toxic window counts, and clean texts show theirs. A fifth of the sample is
kept to calibrate. Scoring covers every word of every text.

Defined cases: texts without words, null texts included, score 0; rows without
doc_id are held out; label rows that repeat an id count as toxic if one says so,
null labels are ignored; with no toxic or no clean row to learn from every score
is 0; rows that repeat score equally; an empty table gives no rows; columns
other than the text are never read by the network.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from dockwatch.llm.common import table
from dockwatch.session import stage

WINDOW, STRIDE = 48, 32
#: Rows of the bounded sample that the network is fitted on.
TOXIC_ROWS, CLEAN_ROWS = 1500, 3000
#: Windows of a sampled text that training sees in a round.
TEXT_WINDOWS = 6
WORDS, GRAMS, DIM, HIDDEN = 4096, 4096, 16, 12
ROUNDS, BATCH, RATE = 6, 128, 0.006
#: From this round on, toxic rows that still look clean are left out as wrongly labelled.
TRUST = 4
#: Steps at least; a small sample is seen in more rounds.
STEPS = 350
#: Words whose inputs a task keeps, windows scored at a time.
CACHE, AT_ONCE = 300_000, 512
#: Words whose inputs are computed at a time.
PART = 8192

_words = re.compile(r"[^\W_]+").findall
Params = dict[str, np.ndarray]


def words(text: str | None) -> list[str]:
    return _words(text.lower()) if text else []


def starts(n: int) -> list[int]:
    """Where the windows of a text of n words begin; the last one ends with the text."""
    if n <= WINDOW:
        return [0]
    out = list(range(0, n - WINDOW, STRIDE))
    return [*out, n - WINDOW]


def grams(word: str) -> list[int]:
    """Buckets of the character 3-grams of a word with its edges."""
    w = f"<{word}>"
    return [zlib.crc32(w[i:i + 3].encode()) % GRAMS for i in range(len(w) - 2)] or [0]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _new(rng: np.random.Generator) -> Params:
    f = np.float32
    p = {"word": rng.normal(0, 0.1, (WORDS + 1, DIM)), "gram": rng.normal(0, 0.1, (GRAMS, DIM)),
         "att": rng.normal(0, 0.2, (2 * HIDDEN, HIDDEN)), "ask": rng.normal(0, 0.2, HIDDEN),
         "out": rng.normal(0, 0.2, 2 * HIDDEN), "bias": np.zeros(1)}
    for d in "fb":
        p |= {f"w{d}": rng.normal(0, DIM ** -0.5, (DIM, 3 * HIDDEN)), f"c{d}": np.zeros(3 * HIDDEN),
              f"u{d}": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, 3 * HIDDEN))}
    return {k: v.astype(f) for k, v in p.items()}


def _inputs(p: Params, lexicon: dict[str, int], distinct: list[str]) -> tuple[np.ndarray, tuple]:
    """Input vectors of distinct words, and what their gradients need."""
    ids = np.array([lexicon.get(w, 0) for w in distinct], dtype=np.int64)
    lists = [grams(w) for w in distinct]
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    flat = np.array([g for x in lists for g in x], dtype=np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    scale = (sizes ** -0.5).astype(np.float32)
    x = p["word"][ids] * (ids > 0)[:, None] + np.add.reduceat(p["gram"][flat], at, axis=0) * scale[:, None]
    return x.astype(np.float32), (ids, flat, sizes, scale)


def _read(x: np.ndarray, mask: np.ndarray, u: np.ndarray, back: bool, keep: bool) -> tuple:
    """One direction: x (time, batch, 3 hidden) are the inputs already multiplied out."""
    n, b, _ = x.shape
    h, states, trace = np.zeros((b, HIDDEN), np.float32), np.empty((n, b, HIDDEN), np.float32), {}
    for t in range(n - 1, -1, -1) if back else range(n):
        a = h @ u
        zr = _sigmoid(x[t, :, :2 * HIDDEN] + a[:, :2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(x[t, :, 2 * HIDDEN:] + r * a[:, 2 * HIDDEN:])
        new = c + z * (h - c)
        if not mask[t].all():
            new = np.where(mask[t][:, None], new, h)
        if keep:
            trace[t] = (h, a, z, r, c)
        h = states[t] = new
    return states, trace


def _forward(p: Params, x: np.ndarray, pos: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple:
    """Logits of windows. x: inputs of distinct words, pos (time, batch): which word where."""
    hs, traces = [], []
    for d in "fb":
        s, tr = _read((x @ p[f"w{d}"] + p[f"c{d}"])[pos], mask, p[f"u{d}"], d == "b", keep)
        hs.append(s)
        traces.append(tr)
    h = np.concatenate(hs, axis=2)
    e = np.tanh(h @ p["att"])
    s = np.where(mask, e @ p["ask"], np.float32(-1e9))
    s = np.exp(s - s.max(axis=0))
    w = s / s.sum(axis=0)
    pooled = (w[:, :, None] * h).sum(axis=0)
    return pooled @ p["out"] + p["bias"], (h, e, w, pooled, traces)


def _backward(p: Params, x: np.ndarray, pos: np.ndarray, mask: np.ndarray, d_logit: np.ndarray,
              kept: tuple) -> tuple[Params, np.ndarray]:
    h, e, w, pooled, traces = kept
    g = {"out": pooled.T @ d_logit, "bias": d_logit.sum(keepdims=True)}
    d_pool = d_logit[:, None] * p["out"]
    d_h = w[:, :, None] * d_pool
    d_w = (h * d_pool).sum(axis=2)
    d_s = w * (d_w - (w * d_w).sum(axis=0))
    g["ask"] = (d_s[:, :, None] * e).sum(axis=(0, 1))
    d_e = d_s[:, :, None] * p["ask"] * (1 - e * e)
    g["att"] = np.einsum("tbi,tbj->ij", h, d_e)
    d_h = d_h + d_e @ p["att"].T
    d_x = np.zeros_like(x)
    for d, tr, part in zip("fb", traces, (d_h[:, :, :HIDDEN], d_h[:, :, HIDDEN:])):
        u, n = p[f"u{d}"], len(pos)
        carry = np.zeros_like(part[0])
        d_in, d_u = np.zeros((*pos.shape, 3 * HIDDEN), np.float32), np.zeros_like(u)
        for t in range(n) if d == "b" else range(n - 1, -1, -1):
            h0, a, z, r, c = tr[t]
            full = part[t] + carry
            now = full * mask[t][:, None]
            d_c = now * (1 - z) * (1 - c * c)
            d_z = now * (h0 - c) * z * (1 - z)
            d_r = d_c * a[:, 2 * HIDDEN:] * r * (1 - r)
            d_a = np.concatenate([d_z, d_r, d_c * r], axis=1)
            d_in[t] = np.concatenate([d_z, d_r, d_c], axis=1)
            d_u += h0.T @ d_a
            carry = d_a @ u.T + now * z + (full - now)
        g[f"u{d}"], g[f"c{d}"] = d_u, d_in.sum(axis=(0, 1))
        per_word = np.zeros((len(x), 3 * HIDDEN), np.float32)
        np.add.at(per_word, pos.ravel(), d_in.reshape(-1, 3 * HIDDEN))
        g[f"w{d}"] = x.T @ per_word
        d_x += per_word @ p[f"w{d}"].T
    return g, d_x


def _layout(windows: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    distinct: dict[str, int] = {}
    pos = np.zeros((max(map(len, windows)), len(windows)), dtype=np.int64)
    mask = np.zeros(pos.shape, dtype=bool)
    for b, w in enumerate(windows):
        pos[:len(w), b] = [distinct.setdefault(x, len(distinct)) for x in w]
        mask[:len(w), b] = True
    return list(distinct), pos, mask


class Model:
    """Parameters, the lexicon of frequent words, and the calibration (slope, shift)."""

    def __init__(self, params: Params, lexicon: dict[str, int], slope: float = 1.0, shift: float = 0.0):
        self.params, self.lexicon, self.slope, self.shift = params, lexicon, slope, shift
        self.seen: dict[str, int] = {}
        self.table: np.ndarray | None = None

    def __getstate__(self):
        return self.params, self.lexicon, self.slope, self.shift

    def __setstate__(self, state):
        self.__init__(*state)

    def _lookup(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Word numbers of texts; new words get their inputs computed once."""
        if len(self.seen) > CACHE:
            self.seen, self.table = {}, None
        seen, old = self.seen, len(self.seen)
        ids = [np.array([seen.setdefault(w, len(seen)) for w in t], dtype=np.int64) for t in texts]
        if len(seen) > old:
            # In parts: the grams of many words at once are large lists.
            new = list(islice(seen, old, None))
            fresh = [_inputs(self.params, self.lexicon, new[k:k + PART])[0] for k in range(0, len(new), PART)]
            self.table = np.concatenate(fresh if self.table is None else [self.table, *fresh])
        return ids

    def logits(self, texts: list[list[str]]) -> np.ndarray:
        """The largest window logit of each text; minus infinity without words."""
        out = np.full(len(texts), -np.inf)
        ids = self._lookup(texts)
        jobs: dict[int, list[tuple[int, int]]] = {}
        for i, t in enumerate(ids):
            for s in starts(len(t)) if len(t) else []:
                jobs.setdefault(min(len(t), WINDOW), []).append((i, s))
        # Windows of equal length together, short ones padded up to the next multiple of 8.
        groups: dict[int, list[tuple[int, int]]] = {}
        for n, js in jobs.items():
            groups.setdefault(-(-n // 8) * 8, []).extend(js)
        for width, js in groups.items():
            for at in range(0, len(js), AT_ONCE):
                some = js[at:at + AT_ONCE]
                pos = np.zeros((width, len(some)), dtype=np.int64)
                mask = np.zeros(pos.shape, dtype=bool)
                for b, (i, s) in enumerate(some):
                    w = ids[i][s:s + width]
                    pos[:len(w), b] = w
                    mask[:len(w), b] = True
                distinct, inverse = np.unique(pos, return_inverse=True)
                got, _ = _forward(self.params, self.table[distinct], inverse.reshape(pos.shape), mask)
                np.maximum.at(out, [i for i, _ in some], got)
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = self.logits([words(t) for t in texts])
        return np.where(np.isfinite(x), _sigmoid(self.slope * np.clip(x, -40, 40) + self.shift), 0.0)


def _adam(p: Params, g: Params, m: Params, v: Params, step: int) -> None:
    for k, d in g.items():
        m[k] = 0.9 * m[k] + 0.1 * d
        v[k] = 0.99 * v[k] + 0.01 * d * d
        p[k] = (p[k] - RATE * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-6)
                ).astype(np.float32)


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve.

    It crosses one half in the middle of the widest of the gaps between logits
    that split the classes with fewest errors, which a few wrong labels do not
    move; the slope is that of smoothed targets.
    """
    x = np.clip(x, -40, 40)
    order = np.argsort(x, kind="stable")
    xs, ys = x[order], y[order]
    errors = np.cumsum(ys)[:-1] + (1 - ys).sum() - np.cumsum(1 - ys)[:-1]
    gap = np.diff(xs)
    best = np.flatnonzero((errors == errors[gap > 0].min()) & (gap > 0)) if (gap > 0).any() else [0]
    k = max(best, key=lambda i: gap[i])
    middle = (xs[k] + xs[k + 1]) / 2 if len(xs) > 1 else 0.0
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    slope, d = 1.0, x - middle
    for _ in range(50):
        q = _sigmoid(slope * d)
        step = (d @ (q - t) + 1e-3 * slope) / ((d * d) @ (q * (1 - q)) + 1e-3)
        slope = min(8.0, max(0.05, slope - step))
        if abs(step) < 1e-8:
            break
    return float(slope), float(-slope * middle)


def train(texts: Iterable[str], labels: list[int], seed: int = 5) -> Model | None:
    """The network of a sample of texts; None if a class is missing."""
    rng = np.random.default_rng(seed)
    same: dict[str, str] = {}           # one object per word keeps the driver small
    split = [[same.setdefault(w, w) for w in words(t)] for t in texts]
    del same
    rows = [i for i in range(len(split)) if split[i]]
    labels_ = np.array(labels)
    check = [i for k, i in enumerate(rows) if k % 10 in (3, 7)]
    fit = [i for k, i in enumerate(rows) if k % 10 not in (3, 7)]
    if len({*labels_[fit].tolist()}) < 2:
        return None
    often = Counter(w for i in fit for w in set(split[i]))
    lexicon = {w: k + 1 for k, (w, n) in enumerate(sorted(often.items(), key=lambda e: (-e[1], e[0]))[:WORDS])
               if n > 2}
    del often
    p = _new(rng)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    step = 0
    r = 0
    while r < ROUNDS or step < STEPS:
        shown = []
        for i in fit:
            s = starts(len(split[i]))
            shown.append([split[i][s[k]:s[k] + WINDOW] for k in rng.permutation(len(s))[:TEXT_WINDOWS]])
        if r >= 2:
            got = iter(Model(p, lexicon).logits([w for win in shown for w in win]))
            for i, win in zip(fit, shown):
                logit = [next(got) for _ in win]
                win.insert(0, win.pop(int(np.argmax(logit))))
                doubtful = labels_[i] and r >= TRUST and max(logit) < 0
                del win[0 if doubtful else 1 if labels_[i] else 2:]
        jobs = [(w, int(labels_[i])) for i, win in zip(fit, shown)
                for w in (win if labels_[i] else win[:2])]
        weight = {1: len(jobs) / (2 * max(1, sum(y for _, y in jobs))),
                  0: len(jobs) / (2 * max(1, sum(1 - y for _, y in jobs)))}
        order = sorted(rng.permutation(len(jobs)), key=lambda k: len(jobs[k][0]) // 8)
        batches = [order[k:k + BATCH] for k in range(0, len(order), BATCH)]
        for k in rng.permutation(len(batches)):
            batch = [jobs[j] for j in batches[k]]
            distinct, pos, mask = _layout([w for w, _ in batch])
            x, (ids, flat, sizes, scale) = _inputs(p, lexicon, distinct)
            logit, kept = _forward(p, x, pos, mask, keep=True)
            y = np.array([b for _, b in batch], dtype=np.float32)
            wt = np.array([weight[b] for _, b in batch], dtype=np.float32)
            g, d_x = _backward(p, x, pos, mask, ((_sigmoid(logit) - y) * wt / len(batch)).astype(np.float32), kept)
            g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
            np.add.at(g["word"], ids, d_x * (ids > 0)[:, None])
            np.add.at(g["gram"], flat, np.repeat(d_x * scale[:, None], sizes, axis=0))
            step += 1
            _adam(p, g, m, v, step)
        r += 1
    model = Model(p, lexicon)
    use = check if len({*labels_[check].tolist()}) == 2 else fit
    slope, shift = _calibrate(model.logits([split[i] for i in use]), labels_[use].astype(float))
    return Model(p, lexicon, slope, shift)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model of the labelled rows outside the held-out fifth, from a bounded sample."""
    known = (labels.filter(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id")
             .agg(F.max(F.col("toxic").cast("int")).alias("_toxic")))
    # A join before the limits: only ids that have a text use up the sample.
    known = known.join(docs.select("doc_id").distinct(), "doc_id")
    rank = F.xxhash64("doc_id")
    known = stage(known, "toxic-labels")
    chosen = known.filter("_toxic = 1").orderBy(rank, "doc_id").limit(TOXIC_ROWS).unionByName(
        known.filter("_toxic = 0").orderBy(rank, "doc_id").limit(CLEAN_ROWS))
    # At most TOXIC_ROWS + CLEAN_ROWS ids.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(
        F.max("text").alias("text"), F.max("_toxic").alias("toxic"))
    rows = sorted(((r["doc_id"], r["text"], r["toxic"]) for r in sample.toLocalIterator()),
                  key=lambda r: zlib.crc32(str(r[0]).encode()))
    toxic = [r[2] for r in rows]
    # Handed over one by one, so that a text goes when its words are there.
    rows.reverse()
    return train((rows.pop()[1] or "" for _ in range(len(rows))), toxic)


def scored(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """``docs`` with the score of their text."""
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    cell = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        out = [cell.value.scores([t if isinstance(t, str) else None for t in texts[k:k + 256]])
               for k in range(0, len(texts), 256)]
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.withColumn(name, score("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored for toxicity."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score",
                                      (F.col("score") >= 0.5).cast("int").alias("predicted"))

"""A bit-packed FM-index over sequences of words, searched for many patterns at once."""

from __future__ import annotations

import numpy as np

#: Suffixes are sorted by so many words; patterns must be shorter.
DEPTH = 128


class WaveletMatrix:
    """Ranks in a sequence of numbers: one packed bit vector for each binary digit, highest first."""

    def __init__(self, seq: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        self.words, self.before, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = ((seq >> level) & 1).astype(np.uint8)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view("<u8")
            self.words.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(int(len(bit) - bit.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def step(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where positions ``at`` go when only entries equal to ``symbols`` are followed."""
        for k in range(self.levels):
            q = at >> 6
            low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.before[k][q] + np.bitwise_count(self.words[k][q] & low).astype(np.int64)
            up = (symbols >> (self.levels - 1 - k)) & 1 == 1
            at = np.where(up, self.zeros[k] + ones, at - ones)
        return at


class FMIndex:
    """Index of weighted units (sequences of word hashes).

    The suffix order is that of the first DEPTH words, which is all that
    backward search of shorter patterns uses. The weight of an interval is the
    sum of the weights of the units its suffixes lie in.
    """

    def __init__(self, units: list[np.ndarray], weights: np.ndarray):
        sizes = np.array([len(u) for u in units], dtype=np.int64)
        flat = np.concatenate(units)
        alphabet, codes = np.unique(flat, return_inverse=True)
        self.n_symbols = len(alphabet) + 1
        # One separator, code 0, ends every unit.
        n = len(flat) + len(units)
        text = np.zeros(n, dtype=np.int64)
        owner = np.repeat(np.arange(len(units)), sizes)
        text[np.arange(len(flat)) + owner] = codes + 1
        self.text, self.sizes = text, sizes
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        order, rank, width = None, text, 1
        while width <= DEPTH:
            nxt = np.zeros(n, dtype=np.int64)
            nxt[:-width if width < n else 0] = rank[width:] + 1 if width < n else 0
            key = rank * (n + 2) + nxt
            order = np.argsort(key, kind="stable")
            new = np.empty(n, dtype=np.int64)
            ordered = key[order]
            new[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            rank, width = new, width * 2
            if rank.max() == n - 1:
                break
        bwt = text[order - 1]
        self.tree = WaveletMatrix(bwt, self.n_symbols - 1)
        count = np.bincount(text, minlength=self.n_symbols)
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        symbols = np.arange(self.n_symbols)
        self.base = first - self.tree.step(symbols, np.zeros(self.n_symbols, dtype=np.int64))
        load = np.zeros(n, dtype=np.int64)
        load[np.arange(len(flat)) + owner] = np.asarray(weights, dtype=np.int64)[owner]
        self.load = np.concatenate([[0], np.cumsum(load[order])])
        self.n = n

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more word in front."""
        both = self.tree.step(np.concatenate([symbols, symbols]), np.concatenate([lo, hi]))
        base = self.base[symbols]
        return both[:len(lo)] + base, both[len(lo):] + base

    def weight(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return self.load[hi] - self.load[lo]


def repeated_intervals(index: FMIndex, threshold: int, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, first, last): maximal stretches of at least ``threshold`` words of a unit that
    weigh ``least`` or more in the index.

    All units are read at once, each from its right end to the left: the match is
    extended word by word until it would occur too seldom, at p. What lies right
    of p matches. Stretches over p must end sooner; how much sooner is found by
    trying ever longer pieces that begin at p, until one occurs too seldom.
    """
    m = len(index.sizes)
    unit = np.arange(m)
    end = index.sizes - 1                       # right end of the present attempt
    at = end.copy()                             # word to be read next
    lo, hi = np.zeros(m, np.int64), np.full(m, index.n, np.int64)
    probe = np.full(m, -1, np.int64)            # where a trial piece begins, -1: no trial
    limit = np.zeros(m, np.int64)               # known too-seldom end of a piece that begins there
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    live = end >= threshold - 1
    unit, end, at, lo, hi, probe, limit = (x[live] for x in (unit, end, at, lo, hi, probe, limit))

    def restart(k: np.ndarray, new_end: np.ndarray) -> None:
        end[k], at[k], lo[k], hi[k] = new_end, new_end, 0, index.n

    while len(unit):
        symbol = index.text[index.starts[unit] + at]
        lo2, hi2 = index.extend(symbol, lo, hi)
        good = index.weight(lo2, hi2) >= least
        lo, hi, at = np.where(good, lo2, lo), np.where(good, hi2, hi), np.where(good, at - 1, at)
        trial = probe >= 0
        done = np.zeros(len(unit), dtype=bool)
        # A plain attempt ends at the unit's left end or at a word too many.
        ended = ~trial & ((at < 0) | ~good)
        if ended.any():
            k = np.flatnonzero(ended)
            long = k[end[k] - at[k] >= threshold]
            out.append((unit[long], at[long] + 1, end[long]))
            whole = at[k] < 0
            done[k[whole]] = True
            k = k[~whole]
            short = end[k] - at[k] <= 3
            restart(k[short], end[k[short]] - 1)
            k = k[~short]
            probe[k], limit[k] = at[k], end[k]
            restart(k, np.minimum(at[k] + 2, limit[k] - 1))
        # A trial piece probe..end that occurs often enough calls for a longer one.
        fits = trial & good & (at < probe)
        if fits.any():
            k = np.flatnonzero(fits)
            longer = np.minimum(probe[k] + 2 * (end[k] - probe[k] + 1), limit[k] - 1)
            same = longer == end[k]             # the known limit is the shortest there is
            stop = k[same]
            restart(stop, limit[stop] - 1)
            probe[stop] = -1
            restart(k[~same], longer[~same])
        fails = trial & ~good
        if fails.any():
            k = np.flatnonzero(fails)
            restart(k, end[k] - 1)
            probe[k] = -1
        done |= (probe < 0) & (end < threshold - 1)
        # Pieces over the probe that end below the threshold leave nothing to find.
        done |= (probe >= 0) & (limit - 1 < threshold - 1)
        if done.any():
            unit, end, at, lo, hi, probe, limit = (x[~done] for x in (unit, end, at, lo, hi, probe, limit))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*out))

"""A run-length index of many short byte strings, and the streaming of matching statistics against it.

The strings stand in one text, each followed by a separator. Of the Burrows-Wheeler
transform only the runs are kept: the symbol and first row of each, where it leads
under the last-to-first mapping, and the text positions of its first and last row. The
suffix array itself is dropped after the build. Repeats of the text fall into the same
runs, so the index grows with what differs.

Matching statistics go through a pattern from its end. The state is a row, its text
position and the length matched. If the row's run has the next symbol, the row follows
the mapping; if not, the state moves to the nearest run end with that symbol whose
sample shares more with what is matched so far, and the length becomes what they share.
Many patterns are followed at once.

Rows that share their first ``window`` symbols form a class; for each the smallest
owner is kept, so a match of that length tells at once who holds it first.
"""

from __future__ import annotations

import numpy as np

#: Symbols of the first ranking: seven of nine bits fit a long.
_PACK, _BITS = 7, 9
#: Packed symbols that differ by less than these agree in their first six, five, ..., one.
_LIMITS = np.int64(1) << (_BITS * np.arange(1, _PACK))


class Marks:
    """Marked places among n, as bits: which mark is the last at or before a place."""

    def __init__(self, at: np.ndarray, n: int):
        bits = np.zeros(-(-n // 64) * 64, dtype=np.uint8)
        bits[at] = 1
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        count = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(count) - count - 1

    def rank(self, place: np.ndarray) -> np.ndarray:
        word = place >> 6
        upto = self.words[word] << (63 - (place & 63)).astype(np.uint64)
        return self.before[word] + np.bitwise_count(upto)


class RunIndex:
    """Index of ``units`` (bytes, and their lengths); ``owner`` is a number of each unit."""

    def __init__(self, data: np.ndarray, lengths: np.ndarray, owner: np.ndarray, window: int):
        if not 4 * _PACK <= window <= 8 * _PACK:
            raise ValueError("window must be 28 to 56")
        self.window = window
        lengths = np.asarray(lengths, dtype=np.int64)
        n = int(lengths.sum()) + len(lengths)
        text = np.zeros(n, dtype=np.int16)
        inside = np.ones(n, dtype=bool)
        inside[np.cumsum(lengths + 1) - 1] = False
        text[inside] = data.astype(np.int16) + 1
        self.text = text
        sa, prefix = self._sorted()
        last = text[sa - 1]                         # row 0 wraps to the last separator
        starts = np.flatnonzero(np.concatenate([[True], last[1:] != last[:-1]]))
        ends = np.append(starts[1:], n)
        self.run_start, self.run_symbol = starts, last[starts]
        self._runs = Marks(starts, n)
        self.first_sample, self.last_sample = sa[starts], sa[ends - 1]
        self.run_end = ends - 1
        # Where the first row of each run leads: rows of smaller symbols, then earlier runs of its own.
        order = np.argsort(self.run_symbol, kind="stable")
        size = (ends - starts)[order]
        self.leads_to = np.empty(len(starts), dtype=np.int64)
        self.leads_to[order] = np.cumsum(size) - size
        self._by_symbol = np.sort(self.run_symbol.astype(np.int64) * (len(starts) + 1) + np.arange(len(starts)))
        # Classes of rows by their first ``window`` symbols.
        rest = np.minimum(sa + window - 4 * _PACK, n)
        a, b = prefix[sa], prefix[rest]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        first = np.flatnonzero(new)
        self._classes = Marks(first, n)
        unit = np.repeat(np.arange(len(lengths)), lengths + 1)
        self.class_owner = np.minimum.reduceat(np.asarray(owner)[unit][sa], first)

    def _sorted(self) -> tuple[np.ndarray, np.ndarray]:
        """The suffix array by doubling, and the rank of each position by its first 28 symbols.

        A rank is one more than the first row of those that agree so far; only these are sorted on.
        """
        n = len(self.text)
        padded = np.concatenate([self.text, np.zeros(_PACK, np.int16)]).astype(np.int64)
        key = np.zeros(n, dtype=np.int64)
        for i in range(_PACK):
            key <<= _BITS
            key |= padded[i:i + n]
        self.packed = key
        rank = np.zeros(n + 1, dtype=np.int64)              # rank 0 lies beyond the text
        order, row, width, prefix = np.arange(n), np.arange(n), _PACK, None
        while True:
            by = np.argsort(key)
            place, key = order[row][by], key[by]
            order[row] = place
            new = np.concatenate([[True], key[1:] != key[:-1]])
            rank[place] = np.maximum.accumulate(np.where(new, row, 0)) + 1
            row = row[~(new & np.append(new[1:], True))]
            if prefix is None and (width == 4 * _PACK or not len(row)):
                prefix = rank.copy()
            if not len(row):
                return order, prefix
            place = order[row]
            key = rank[place] * (n + 1) + rank[np.minimum(place + width, n)]
            width *= 2

    @property
    def runs(self) -> int:
        return len(self.run_start)

    def _run_of(self, row: np.ndarray) -> np.ndarray:
        return self._runs.rank(row)

    def _shared(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many symbols the text has in common at ``a`` and ``b``, up to ``most``."""
        out = np.zeros(len(a), dtype=np.int64)
        live = np.flatnonzero(most > 0)
        while len(live):
            # What is matched at ``a`` holds no separator, so neither place runs over the end of the text.
            differ = self.packed[a[live] + out[live]] ^ self.packed[b[live] + out[live]]
            out[live] += np.where(differ == 0, _PACK, _PACK - 1 - np.searchsorted(_LIMITS, differ, side="right"))
            live = live[(differ == 0) & (out[live] < most[live])]
        return np.minimum(out, most)

    def _turn(self, symbol: np.ndarray, row: np.ndarray, at: np.ndarray, length: np.ndarray):
        """For states whose run has another symbol: the better of the run ends before and after.

        Gives the run, whether its last row is meant, and the length that stays.
        """
        runs = len(self.run_start) + 1
        place = np.searchsorted(self._by_symbol, symbol.astype(np.int64) * runs + self._run_of(row))
        before = self._by_symbol[np.maximum(place - 1, 0)]
        after = self._by_symbol[np.minimum(place, len(self._by_symbol) - 1)]
        kept, chosen, at_end = np.full(len(row), -1), np.zeros(len(row), np.int64), np.zeros(len(row), bool)
        for found, sample, end in ((before, self.last_sample, True), (after, self.first_sample, False)):
            ok = np.flatnonzero(found // runs == symbol)
            run = found[ok] % runs
            shared = self._shared(at[ok], sample[run], length[ok])
            better = shared > kept[ok]
            kept[ok[better]], chosen[ok[better]], at_end[ok[better]] = shared[better], run[better], end
        return kept, chosen, at_end

    def stream(self, data: np.ndarray, lengths: np.ndarray):
        """Matching statistics of patterns, as (place, pattern numbers, lengths matched, rows).

        Yields once for each distance from the end of the patterns; ``place`` counts
        from a pattern's end, 1 for its last symbol.
        """
        lengths = np.asarray(lengths, dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        ends = np.cumsum(lengths)[order]
        sizes = lengths[order]
        row = np.zeros(len(order), dtype=np.int64)
        at = np.full(len(order), self.first_sample[0], dtype=np.int64)
        length = np.zeros(len(order), dtype=np.int64)
        for place in range(1, int(sizes.max(initial=0)) + 1):
            m = int(np.searchsorted(-sizes, -place, side="right"))
            symbol = data[ends[:m] - place].astype(np.int64) + 1
            run = self._run_of(row[:m])
            goes = self.run_symbol[run] == symbol
            start = row[:m] - self.run_start[run]
            length[:m] = np.where(goes, length[:m] + 1, length[:m])
            at[:m] = np.where(goes, at[:m] - 1, at[:m])
            turn = np.flatnonzero(~goes)
            if len(turn):
                kept, chosen, at_end = self._turn(symbol[turn], row[turn], at[turn], length[turn])
                run[turn] = chosen
                start[turn] = np.where(at_end, self.run_end[chosen] - self.run_start[chosen], 0)
                at[turn] = np.where(at_end, self.last_sample[chosen], self.first_sample[chosen]) - 1
                length[turn] = kept + 1
            row[:m] = self.leads_to[run] + start
            lost = turn[length[turn] == 0]                  # the symbol stands nowhere
            row[lost], at[lost] = 0, self.first_sample[0]
            yield place, order[:m], length[:m], row[:m]

    def first_owners(self, data: np.ndarray, lengths: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
        """For every window of every pattern the smallest owner of it, or ``none``.

        Gives one flat array and where each pattern's windows start in it.
        """
        lengths = np.asarray(lengths, dtype=np.int64)
        windows = np.maximum(lengths - self.window + 1, 0)
        offset = np.cumsum(windows) - windows
        out = np.full(int(windows.sum()), none, dtype=np.int64)
        for place, pattern, length, row in self.stream(data, lengths):
            if place >= self.window:
                hit = length >= self.window
                owner = self.class_owner[self._classes.rank(row[hit])]
                p = pattern[hit]
                out[offset[p] + lengths[p] - place] = owner
        return out, offset

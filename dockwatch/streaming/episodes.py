"""Episode durations as a keyed state (K5); batch twin: plans.alerts.episodes.

Files arrive late and in any order. A station's state holds its readings of the look-back
and of the time that a reading may be late; each batch merges its readings into them,
times all of them again in one pass over the sorted slots, and emits what is new or has
changed, under a number that grows with each batch of the station. ``current`` keeps the
newest word on each slot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dockwatch.functions import status as st, timefn as tf
from dockwatch.functions.cols import c
from dockwatch.schemas import ALERT_WINDOW_HOURS

OUT = "station_id long, slot long, kind string, duration_min int, duration_capped boolean, late boolean, seq long"
STATE = "seq long, slots array<long>, bikes array<int>, docks array<int>"
REACH = ALERT_WINDOW_HOURS * 2
_KINDS = np.array([None, "empty", "full"], dtype=object)


def durations(slots: np.ndarray, bikes: np.ndarray, docks: np.ndarray) -> tuple[np.ndarray, ...]:
    """Kind (1 empty, 2 full, 0 neither), minutes and whether the start was out of sight, by ascending slot."""
    kind = np.where(bikes == 0, 1, np.where(docks == 0, 2, 0))
    first = slots[np.searchsorted(slots, slots - REACH, side="right")] if len(slots) else slots
    minutes, capped = np.zeros(len(slots), np.int64), np.zeros(len(slots), bool)
    for code, value in ((1, bikes), (2, docks)):
        before = np.maximum.accumulate(np.where(value != 0, slots, np.iinfo(np.int64).min // 2))
        seen = before > slots - REACH
        here = kind == code
        minutes[here] = ((slots - np.where(seen, before, first)) * 30)[here]
        capped[here] = ~seen[here]
    return kind, minutes, capped


def merged(old: tuple[np.ndarray, ...], fresh: np.ndarray) -> tuple[np.ndarray, ...]:
    """Readings by slot; a fresh one replaces an old one, of several fresh ones the greatest counts."""
    fresh = fresh[np.lexsort((fresh[:, 2], fresh[:, 1], fresh[:, 0]))]
    rows = np.concatenate([np.column_stack(old), fresh])
    order = np.argsort(rows[:, 0], kind="stable")
    rows = rows[order]
    last = np.append(rows[1:, 0] != rows[:-1, 0], True)
    return tuple(rows[last].T)


def _advance(late: int) -> Callable:
    def run(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        none = np.zeros(0, np.int64)
        seq, old = 0, (none, none, none)
        if state.exists:
            seq, *lists = state.get
            old = tuple(np.array(x, np.int64) for x in lists)
        fresh = np.concatenate([p[["slot", "bikes", "docks_avail"]].to_numpy(np.int64) for p in chunks])
        # Older than this a reading has lost the readings around it; what came with it does not count.
        edge = old[0].max() - late if len(old[0]) else np.iinfo(np.int64).min
        shut = fresh[fresh[:, 0] <= edge]
        now = merged(old, fresh[fresh[:, 0] > edge])
        newest = now[0].max()
        was, is_ = durations(*old), durations(*now)
        at = np.searchsorted(old[0], now[0])
        known = np.zeros(len(now[0]), bool)
        known[at < len(old[0])] = old[0][at[at < len(old[0])]] == now[0][at < len(old[0])]
        at = np.minimum(at, max(len(old[0]) - 1, 0))
        same = known.copy()
        for a, b in zip(was, is_):
            same[known] &= a[at[known]] == b[known]
        told = np.zeros(len(now[0]), bool)
        told[known] = was[0][at[known]] > 0
        # What lies before the oldest reading that may still come has been settled.
        out = ~same & ((is_[0] > 0) | told) & (now[0] > edge)
        seq += 1
        kind, minutes, capped = (x[out] for x in is_)
        yield pd.DataFrame({
            "station_id": key[0], "slot": np.concatenate([now[0][out], shut[:, 0]]),
            "kind": np.concatenate([_KINDS[kind], np.full(len(shut), None)]),
            "duration_min": np.concatenate([minutes, np.zeros(len(shut), np.int64)]).astype(np.int32),
            "duration_capped": np.concatenate([capped, np.zeros(len(shut), bool)]),
            "late": np.repeat([False, True], [int(out.sum()), len(shut)]), "seq": seq})
        keep = now[0] > newest - late - REACH
        state.update((seq, *[x[keep].tolist() for x in now]))
    return run


def episode_stream(slots: DataFrame, late_hours: int = 24) -> DataFrame:
    """Durations for a stream of slot readings, and corrections of them.

    A row without kind takes an earlier one back; one that is ``late`` came more than
    ``late_hours`` after a newer reading of its station and changed nothing.
    """
    valid = slots.filter(st.is_valid(c.bikes, c.docks, c.total)).select(
        "station_id", tf.slot_index(F.col("ts")).alias("slot"),
        c.bikes.cast("int").alias("bikes"), c.docks.cast("int").alias("docks_avail"))
    return valid.groupBy("station_id").applyInPandasWithState(
        _advance(late_hours * 2), OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def current(emitted: DataFrame) -> DataFrame:
    """The newest word on each slot: station_id, slot, kind, duration_min, duration_capped."""
    word = F.max_by(F.struct("kind", "duration_min", "duration_capped"), "seq").alias("w")
    return (emitted.filter(~F.col("late")).groupBy("station_id", "slot").agg(word)
            .select("station_id", "slot", "w.*").filter(F.col("kind").isNotNull()))


def late_counts(emitted: DataFrame) -> DataFrame:
    """How many readings of each station came too late to count."""
    return emitted.filter("late").groupBy("station_id").agg(F.count("*").alias("n_late"))

"""Stateful processors for ``transformWithStateInPandas``.

``ProjectedClock`` keeps, per shard, the projected time ``s2`` and the
offset ``d`` (two longs, checkpointed with the query) and stamps every real
row and heartbeat with ``s2``. ``IdleClose`` keeps the best record of every
open window of a key and closes windows either when the key's own event
time passes their end or when the key has been quiet for ``idle_ms`` of
processing time, so an answer never waits for the next message.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming.stateful_processor import (ExpiredTimerInfo, StatefulProcessor,
                                                      StatefulProcessorHandle, TimerValues)

from hushwin.schema import REANCHOR_INTERVALS

CLOCK_OUT = ("shard int, seq long, p long, t long, is_real boolean, key int, value double, "
             "s2 long, d long, reanchored int")

WINDOW_OUT = ("key int, window_start_ms long, window_end_ms long, event_time_ms long, value double, "
              "seq long, closed_by string")


def project_batch(real: np.ndarray, t: np.ndarray, s2: int, d: int, band: int):
    """One shard's rows in arrival order through the projected clock.

    ``real``: bool per row; ``t``: event time of a real row or the tick of a
    heartbeat; ``s2``, ``d``: the state before the batch. Returns per-row
    ``s2``, ``d``, ``reanchored`` and the state after the batch.

    A real row that follows a real row re-anchors on ``|t - t_prev| >=
    band`` alone, so those rows are vectorized; only heartbeats and the
    first real row after one (or the first row of the batch) read the
    carried offset, and only they are walked one by one.
    """
    n = len(t)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32), s2, d
    t = t.astype(np.int64)
    prev_real = np.concatenate(([False], real[:-1]))
    prev_t = np.concatenate(([0], t[:-1]))
    indep = real & prev_real
    big = indep & (np.abs(t - prev_t) >= band)
    jump = np.where(big, t - prev_t, 0)
    cum = np.cumsum(jump)
    events = np.flatnonzero(~indep)
    ev_d = np.empty(len(events), np.int64)
    ev_re = np.zeros(len(events), np.int32)
    ev_s2 = np.empty(len(events), np.int64)
    base = 0
    cur_s2 = s2
    for k, i in enumerate(events.tolist()):
        d += int(cum[i]) - base   # jumps of the vectorized rows since the last walked row
        base = int(cum[i])
        if real[i]:
            ti = int(t[i])
            if abs(ti - cur_s2) >= band:
                d += ti - cur_s2
                ev_re[k] = 1
            cur_s2 = ti
        else:
            cur_s2 = d + int(t[i])
        ev_d[k] = d
        ev_s2[k] = cur_s2
    last = np.searchsorted(events, np.arange(n), side="right") - 1
    ds = ev_d[last] + cum - cum[events[last]]
    s2s = np.where(real, t, ev_s2[last])
    res = np.where(indep, big.astype(np.int32), 0)
    res[events] = ev_re
    return s2s, ds, res, int(s2s[-1]), int(ds[-1])


class ProjectedClock(StatefulProcessor):
    """Per shard: heartbeat tick ``f`` projects ``s2 = d + f``; a real event
    ``t`` re-anchors (``d += t - s2``) when ``|t - s2| >= 3 * idle_ms``, then
    ``s2 = t``. Rows of one call carry no order, so they are sorted by
    arrival (a tick first at the same instant); the batch is then walked by
    ``project_batch``."""

    def __init__(self, idle_ms: int):
        if idle_ms <= 0:
            raise ValueError("idle interval must be > 0")
        self.band = REANCHOR_INTERVALS * idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clock = handle.getValueState("clock", "s2 long, d long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        pdf = pdf.sort_values(["p", "is_real", "seq"], kind="stable").reset_index(drop=True)
        s2, d = (0, 0)
        if self.clock.exists():
            s2, d = self.clock.get()
        s2s, ds, res, s2, d = project_batch(pdf["is_real"].to_numpy(bool), pdf["t"].to_numpy(np.int64),
                                            int(s2), int(d), self.band)
        self.clock.update((s2, d))
        yield pdf.assign(s2=s2s, d=ds, reanchored=res)[
            ["shard", "seq", "p", "t", "is_real", "key", "value", "s2", "d", "reanchored"]]

    def close(self) -> None:
        pass


def fold_windows(t: np.ndarray, v: np.ndarray, q: np.ndarray, size: int, late: int, top: int, closed: int,
                 stored) -> tuple[dict, int]:
    """One key's rows (in arrival order) folded into its open windows.

    Rows whose window has closed (``end <= closed`` or ``end + late <=``
    the largest event time before them) are dropped; each remaining
    window's record is the reference's keep-max fold over its stored record
    (``stored(start)`` -> ``(t, value, seq, first_nan)`` or ``None``) and
    its new rows. One sort by window, then Python runs once per window
    on that window's rows.
    Returns ``{start: (t, value, seq, first_nan)}`` and the new top.
    """
    if len(t) == 0:
        return {}, top
    start = t - t % size
    end = start + size
    before = np.maximum.accumulate(np.concatenate(([top], t)))[:-1]
    keep = ~((end <= closed) | (end + late <= before))
    out = {}
    by_window = np.flatnonzero(keep)
    by_window = by_window[np.argsort(start[by_window], kind="stable")]   # arrival order within a window
    cuts = np.flatnonzero(np.diff(start[by_window])) + 1
    for rows in np.split(by_window, cuts) if len(by_window) else ():
        w, tv, vv, qv = start[rows[0]], t[rows], v[rows], q[rows]
        cur = stored(int(w))
        if cur is None:
            if np.isnan(vv[0]):
                out[int(w)] = (int(tv[0]), float(vv[0]), int(qv[0]), True)
                continue
            cur = (int(tv[0]), float(vv[0]), int(qv[0]), False)
        if cur[3]:
            out[int(w)] = cur       # a NaN that came first stays
            continue
        finite = ~np.isnan(vv)
        if finite.any():
            i = int(np.flatnonzero(finite)[np.argmax(vv[finite])])   # first arrival among equal maxima
            if cur[1] < vv[i]:                                       # strict <: ties keep the earlier one
                cur = (int(tv[i]), float(vv[i]), int(qv[i]), False)
        out[int(w)] = cur
    return out, int(max(top, int(t.max())))


def due(before: int, top: int, size: int, late: int, n_open: int) -> range | None:
    """The starts of the windows open before a batch that its event times may
    close, as the latest goes from ``before`` to ``top``; ``None`` if there
    are more of these than open windows.

    A window that is open has ``start + size + late > before`` and, as a row
    made it, ``start <= before``."""
    if n_open == 0 or top <= before:
        return range(0)
    first = (before - size - late) // size * size + size
    starts = range(first, min(top - size - late, before) + 1, size)
    return starts if len(starts) <= n_open else None


class IdleClose(StatefulProcessor):
    """Per key: the keep-max record of each open window (first arrival wins
    ties; NaN only if it came first).

    A window closes when the key's largest event time reaches
    ``end + lateness_ms`` (``closed_by = 'event_time'``), or, after
    ``idle_ms`` of processing time without input for the key, every open
    window closes at once (``'idle_timeout'``). A row is late, and
    dropped, when its window has closed: ``end + L <= max event time
    before it``, or ``end <= closed`` where ``closed`` is the largest end
    emitted by an idle timeout. So each window is emitted once.

    A batch reads the windows its rows fall into and those that may close by
    its event times (``due``), not all that are open.
    """

    def __init__(self, size_ms: int, idle_ms: int, lateness_ms: int = 0):
        if size_ms <= 0 or idle_ms <= 0 or lateness_ms < 0:
            raise ValueError("size and idle must be > 0, lateness >= 0")
        self.size, self.idle, self.late = size_ms, idle_ms, lateness_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.windows = handle.getMapState("windows", "start long",
                                          "t long, value double, seq long, first_nan boolean")
        self.progress = handle.getValueState("progress", "max_t long, closed long")
        self.n_open = handle.getValueState("n_open", "n long")

    def _emit(self, key, items) -> pd.DataFrame:
        rows = [(int(key), s, s + self.size, t, v, q, why) for s, t, v, q, why in items]
        return pd.DataFrame(rows, columns=["key", "window_start_ms", "window_end_ms", "event_time_ms",
                                           "value", "seq", "closed_by"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        k = key[0]
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["p", "seq"], kind="stable")
        none = -(1 << 62)
        before, closed = self.progress.get() if self.progress.exists() else (none, none)
        n_open = int(self.n_open.get()[0]) if self.n_open.exists() else sum(1 for _ in self.windows.keys())
        known = set()

        def stored(start):
            if not self.windows.containsKey((start,)):
                return None
            known.add(start)
            return tuple(self.windows.getValue((start,)))

        best, top = fold_windows(pdf["t"].to_numpy(np.int64), pdf["value"].to_numpy(float),
                                 pdf["seq"].to_numpy(np.int64), self.size, self.late, int(before), int(closed), stored)
        self.progress.update((top, closed))
        starts = due(int(before), top, self.size, self.late, n_open)
        if starts is None:
            old = ((int(k[0]), tuple(rec)) for k, rec in list(self.windows.iterator()))
        else:
            old = ((s, stored(s)) for s in starts if s not in best)
        over = lambda s: top >= s + self.size + self.late
        closing = {s: rec for s, rec in old if rec is not None and over(s)} | {s: rec for s, rec in best.items() if over(s)}
        n_open += len(best.keys() - known)
        for s, rec in best.items():
            if s not in closing:
                self.windows.updateValue((s,), rec)
        for s in closing:
            if s in known or s not in best:
                self.windows.removeKey((s,))
        self.n_open.update((n_open - len(closing),))
        done = [(s, rec[0], rec[1], rec[2], "event_time") for s, rec in sorted(closing.items())]
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        if done:
            yield self._emit(k, done)

    def handleExpiredTimer(self, key, timerValues: TimerValues,
                           expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        k = key[0]
        done = [(s, rec[0], rec[1], rec[2], "idle_timeout") for (s,), rec in self.windows.iterator()]
        self.windows.clear()
        self.n_open.update((0,))
        if done:
            top, closed = self.progress.get()
            self.progress.update((top, max([closed] + [s + self.size for s, *_ in done])))
            yield self._emit(k, done)

    def close(self) -> None:
        pass

"""The vectorized batch walk of the streaming clock equals the plain
row-by-row rule, across batch boundaries."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from hushwin.streaming.processors import project_batch

BAND = 90_000


def walk(real, t, s2, d):
    out = []
    for r, x in zip(real, t):
        re = 0
        if r:
            if abs(x - s2) >= BAND:
                d += x - s2
                re = 1
            s2 = x
        else:
            s2 = d + x
        out.append((s2, d, re))
    return out, s2, d


steps = st.lists(st.tuples(st.booleans(), st.sampled_from([-100_000, -90_000, -89_999, 0, 10, 30_000, 89_999,
                                                           90_000, 400_000])), min_size=0, max_size=80)


@settings(max_examples=300, deadline=None)
@given(steps, st.integers(min_value=0, max_value=80))
def test_batches_equal_walk(trace, cut):
    real = [r for r, _ in trace]
    t, x, f = [], 1_614_556_800_000, 0
    for r, dx in trace:
        if r:
            x += dx
            t.append(x)
        else:
            f += 30_000
            t.append(f)
    want, _, _ = walk(real, t, 0, 0)
    got, s2, d = [], 0, 0
    for lo, hi in ((0, min(cut, len(t))), (min(cut, len(t)), len(t))):
        s2s, ds, res, s2, d = project_batch(np.array(real[lo:hi], bool), np.array(t[lo:hi], np.int64), s2, d, BAND)
        got += list(zip(s2s.tolist(), ds.tolist(), res.tolist()))
    assert got == want


def fold_rows(rows, size, late, top, closed, stored):
    """The row-by-row rule of the idle-close processor."""
    best = dict(stored)
    for t, v, q in rows:
        s = t - t % size
        if s + size <= closed or s + size + late <= top:
            continue
        cur = best.get(s)
        if cur is None:
            best[s] = (t, v, q, v != v)
        elif not cur[3] and cur[1] < v:
            best[s] = (t, v, q, False)
        top = max(top, t)
    return best


vals = st.sampled_from([float("nan"), float("-inf"), 0.0, 1.0, 1.0, 2.0, 5.0])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60_000), vals), max_size=40),
       st.lists(st.tuples(st.integers(0, 5), vals), max_size=3),
       st.sampled_from([0, 5_000]), st.sampled_from([-(1 << 62), 20_000]), st.sampled_from([-(1 << 62), 10_000]))
def test_fold_windows_equal_row_rule(rows, prior, late, top, closed):
    from hushwin.streaming.processors import fold_windows
    size = 10_000
    stored = {w * size: (w * size + 1, v, -1 - w, v != v) for w, v in prior}
    rows = [(t, v, q) for q, (t, v) in enumerate(rows)]
    want = fold_rows(rows, size, late, top, closed, stored)
    got, _ = fold_windows(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float),
                          np.array([r[2] for r in rows], np.int64), size, late, top, closed, stored.get)
    merged = dict(stored)
    merged.update(got)

    def norm(d):
        return {k: (a, "nan" if b != b else b, c, e) for k, (a, b, c, e) in d.items()}
    assert norm(merged) == norm(want)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(-5, 200), max_size=4), max_size=8), st.sampled_from([0, 7, 40, 200]))
def test_due_covers_every_window_that_closes(batches, late):
    """Of the windows open before a batch, ``due`` names all that it closes."""
    from hushwin.streaming.processors import due, fold_windows
    size, none = 10, -(1 << 62)
    open_, top = set(), none
    for times in batches:
        t = np.array(times, np.int64)
        best, new = fold_windows(t, np.ones(len(t)), t, size, late, top, none, lambda s: None)
        starts = due(top, new, size, late, len(open_))
        closing = {s for s in open_ if new >= s + size + late}
        if starts is not None:
            assert closing <= set(starts) and len(starts) <= len(open_)
            assert all(new >= s + size + late for s in starts)
        open_ = {s for s in open_ | set(best) if new < s + size + late}
        top = new


def test_due_does_not_grow_with_the_open_windows():
    from hushwin.streaming.processors import due
    size, late = 10, 1_000_000
    assert len(due(2_000_000, 2_000_010, size, late, 100_000)) == 1
    assert len(due(2_000_000, 2_000_004, size, late, 100_000)) <= 1
    assert due(2_000_000, 3_000_000, size, late, 10) is None         # few open windows, a long way: walk them

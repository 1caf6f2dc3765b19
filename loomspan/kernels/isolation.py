"""NumPy kernels for readings of many sources at once (arrays sources x readings, short rows padded at the end)."""

from __future__ import annotations

import numpy as np

WINDOW = 15  # readings whose median is the nearby level
END_WINDOW = 9


def _windows(x: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Median of the ``window`` readings around each one, the window moved inwards at the ends."""
    width = x.shape[1]
    start = np.clip(np.arange(width)[None, :] - window // 2, 0, np.maximum(n - window, 0)[:, None])
    med = np.median(np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, 0), (0, window))), window, axis=1)[:, :width], axis=2)
    return np.take_along_axis(med, start, 1)


def nearby_level(x: np.ndarray, n: np.ndarray, window: int = WINDOW, end_window: int = END_WINDOW) -> np.ndarray:
    """Median of the ``window`` readings around each one; of ``end_window`` within half a window of the ends, where a
    window can't lie around the reading; of all readings where there are fewer."""
    width = x.shape[1]
    out = np.zeros_like(x)
    full = n >= window
    if full.any():
        at = np.arange(width)[None, :]
        near = (at < window // 2) | (at >= (n[full] - window // 2)[:, None])
        out[full] = np.where(near, _windows(x[full], n[full], end_window), _windows(x[full], n[full], window))
    for i in np.flatnonzero(~full & (n > 0)):
        out[i] = np.median(x[i, : n[i]])
    return out


def pack_left(x: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept readings of each row moved to the left, and their number."""
    order = np.argsort(~keep, axis=1, kind="stable")
    return np.take_along_axis(np.where(keep, x, 0), order, 1), keep.sum(1)


def row_median(x: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Median of the kept readings of each row (0 where there is none)."""
    srt = np.sort(np.where(keep, x, np.inf), axis=1)
    n = keep.sum(1)
    a = np.take_along_axis(srt, np.maximum((n - 1) // 2, 0)[:, None], 1)[:, 0]
    b = np.take_along_axis(srt, np.minimum(n // 2, x.shape[1] - 1)[:, None], 1)[:, 0]
    return np.where(n > 0, 0.5 * (np.where(n > 0, a, 0) + np.where(n > 0, b, 0)), 0.0)


def deviations(x: np.ndarray, n: np.ndarray, usable: np.ndarray, unit: float) -> np.ndarray:
    """Deviation of each reading from its nearby level in units of the source's usual scatter (median absolute deviation).
    Level and scatter come from the ``usable`` readings only; the others are held against the level next to them."""
    packed, m = pack_left(x, usable)
    level = nearby_level(packed, m)
    where = np.clip(np.cumsum(usable, axis=1) - 1, 0, None)
    level = np.take_along_axis(level, where, 1)
    r = x - level
    return r / np.maximum(1.4826 * row_median(np.abs(r), usable), unit)[:, None]


def unpack(packed: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Inverse of ``pack_left``; 0 (False) for readings that were not kept."""
    at = np.clip(np.cumsum(keep, axis=1) - 1, 0, None)
    return np.where(keep, np.take_along_axis(packed, at, 1), packed.dtype.type(0))


def stretches(packed: np.ndarray, member: float, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and end (exclusive) of the stretches of at most ``longest`` readings on one side of the level, each
    ``member`` scatters away; what stands behind a row's readings is 0."""
    found = []
    for sign in (1, -1):
        inside = np.pad(sign * packed > member, ((0, 0), (1, 1)))
        row, start = np.nonzero(inside[:, 1:] & ~inside[:, :-1])
        _, end = np.nonzero(~inside[:, 1:] & inside[:, :-1])
        short = end - start <= longest
        found.append((row[short], start[short], end[short]))
    row, start, end = (np.concatenate(c) for c in zip(*found))
    return row, start, end


def within(shape: tuple[int, int], row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mask of the readings of the stretches."""
    edges = np.zeros((shape[0], shape[1] + 1), np.int32)
    np.add.at(edges, (row, start), 1)
    np.add.at(edges, (row, end), -1)
    return np.cumsum(edges, axis=1)[:, :-1] > 0


def run_lengths(x: np.ndarray, t: np.ndarray, n: np.ndarray, unit: float) -> np.ndarray:
    """For each reading the length of the longest run of successive volumes it is in whose values lie within one ``unit``."""
    s, width = x.shape
    at = np.arange(width)[None, :]
    valid = at < n[:, None]
    best = np.ones((s, width), np.int32)
    joined = np.zeros((s, width), bool)
    if width > 1:
        joined[:, 1:] = (np.abs(np.diff(x, axis=1)) <= unit * 1.001) & (np.diff(t, axis=1) == 1) & valid[:, 1:]
    # runs of neighbours within a unit are few; inside them the whole run has to lie within one unit
    for i, j in zip(*np.nonzero(joined & ~np.pad(joined, ((0, 0), (1, 0)))[:, :-1])):
        end = j
        while end + 1 < width and joined[i, end + 1]:
            end += 1
        a = j - 1
        if end - a + 1 < 3:
            best[i, a : end + 1] = np.maximum(best[i, a : end + 1], end - a + 1)
            continue
        v = x[i, a : end + 1]
        lo = 0
        for hi in range(len(v)):
            while v[lo : hi + 1].max() - v[lo : hi + 1].min() > unit * 1.001:
                lo += 1
            best[i, a + lo : a + hi + 1] = np.maximum(best[i, a + lo : a + hi + 1], hi - lo + 1)
    return best


def seasonal_residual(r: np.ndarray, n: np.ndarray, lags: range = range(2, 13)) -> np.ndarray:
    """Deviation of each reading from those one period before and after; the period is the source's lag of greatest
    autocorrelation."""
    s, width = r.shape
    rr = np.where(np.arange(width)[None, :] < n[:, None], np.clip(r, -5, 5), 0.0)
    usable = [k for k in lags if k < width]
    if not usable:
        return np.abs(r)
    corr = np.stack([np.einsum("ij,ij->i", rr[:, k:], rr[:, :-k]) / np.maximum(n - k, 1) for k in usable])
    period = np.asarray(usable)[np.argmax(corr, axis=0)]
    at = np.arange(width)[None, :]
    before = np.take_along_axis(rr, np.maximum(at - period[:, None], 0), 1)
    after = np.take_along_axis(rr, np.minimum(at + period[:, None], np.maximum(n - 1, 0)[:, None]), 1)
    return np.abs(r - 0.5 * (before + after))


def _c(m: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among m points."""
    m = np.asarray(m, float)
    big = np.maximum(m, 2.0)
    return np.where(m > 1, 2 * (np.log(big - 1 + (big == 2) * 1e-12) + 0.5772156649) * (m > 2) + (m == 2) * 1.0 - 2 * (big - 1) / big * (m > 2), 0.0)


def isolation_paths(features: np.ndarray, valid: np.ndarray, probe: np.ndarray, watched: np.ndarray | None = None, trees: int = 16, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Isolation forests, one for each source: mean path lengths of all readings (sources x readings), of the source's
    probe (sources), and the mean path length to expect of as many readings (sources).

    ``features``: k x sources x readings; ``probe``: k x sources, a made-up reading that falls through the trees without
    counting. Trees are grown on all readings of their source. A node is cut on a random feature at a random place between
    its least and its greatest reading, down to single readings, equal ones, or ceil(log2(readings)) cuts. The nodes of
    all sources grow together, a level at a time: readings stand sorted by node, and each node is split in place."""
    s, width = valid.shape
    k = len(features)
    row, col = np.nonzero(valid)
    n_src = valid.sum(1).astype(np.int32)
    expected = _c(n_src)
    paths = np.where(valid, expected[:, None], 0.0)
    if watched is not None:  # the other sources' readings stay at what is to be expected
        inside = (watched & valid).any(1)
        row, col = row[inside[row]], col[inside[row]]
    some = np.unique(row).astype(np.int32)
    m = len(row)
    x = np.ascontiguousarray(features[:, row, col], dtype=np.float32).reshape(-1)
    watch = None if watched is None else watched[row, col]
    probe = np.asarray(probe, np.float32)
    limit = np.ceil(np.log2(np.maximum(n_src, 2))).astype(np.int32)
    total, probe_total = np.zeros(m), np.zeros(s)
    rng = np.random.default_rng(seed)
    if m:  # a source's features that vary, first, and their number
        first = (np.cumsum(n_src[some]) - n_src[some]).astype(np.int64)
        varies = np.stack([np.maximum.reduceat(c, first) > np.minimum.reduceat(c, first) for c in x.reshape(k, m)], axis=1)
        n_use = np.zeros(s, np.int32)
        n_use[some] = np.maximum(varies.sum(1), 1)
        use = np.zeros((s, k), np.int32)
        use[some] = np.argsort(~varies, axis=1, kind="stable")
    for _ in range(trees if m else 0):
        order = np.arange(m, dtype=np.int32)
        source, size = some, n_src[some]  # of each node
        depth, tries = np.zeros(len(some), np.int32), np.zeros(len(some), np.int32)
        at = np.full(s, -1, np.int32)  # node of the source's probe
        at[some] = np.arange(len(some), dtype=np.int32)
        while len(order):
            nodes = np.arange(len(size), dtype=np.int32)
            stop = np.cumsum(size, dtype=np.int32)
            start = stop - size
            seg = np.repeat(nodes, size)
            f = use[source, (rng.random(len(size), dtype=np.float32) * n_use[source]).astype(np.int32)]
            v = x[(f * m)[seg] + order]
            lo, hi = np.minimum.reduceat(v, start), np.maximum.reduceat(v, start)
            cut = lo + (hi - lo) * rng.random(len(size), dtype=np.float32)
            cut = np.where(cut >= hi, lo, cut)  # both sides get a reading
            right = v > cut[seg]
            so_far = np.cumsum(right, dtype=np.int32)
            base = so_far[start] - right[start]
            n_right = so_far[stop - 1] - base
            rank = so_far - right - base[seg]  # readings of the right side before this one, within the node
            split = n_right > 0
            to = np.arange(len(order), dtype=np.int32) - rank
            np.copyto(to, (stop - n_right)[seg] + rank, where=right)
            moved = np.empty_like(order)
            moved[to] = order
            # the nodes of the next level: both sides of those that were cut, the others (alike in this feature) as they are
            kids = 1 + split
            child = np.cumsum(kids, dtype=np.int32) - kids
            node = np.repeat(nodes, kids)
            new_size = (size - n_right)[node]
            new_size[child[split] + 1] = n_right[split]
            new_depth, new_source = (depth + split)[node], source[node]
            tries = np.where(split, 0, tries + 1)[node]  # on features in which the node is alike
            done = (new_size <= 1) | (new_depth >= limit[new_source]) | (tries >= 3 * k)
            held = np.flatnonzero(at >= 0)
            mine = at[held]
            at[held] = child[mine] + (split[mine] & (probe[f[mine], held] > cut[mine]))
            if watch is not None:
                of_interest = np.logical_or.reduceat(watch[moved], np.cumsum(new_size) - new_size)
                of_interest[at[held]] = True
                done |= ~of_interest
            order, size, depth, source = moved, new_size, new_depth, new_source
            if done.any():
                path = new_depth + _c(new_size)
                ended = np.repeat(done, new_size)
                total[moved[ended]] += np.repeat(path[done], new_size[done])
                out = done[at[held]]
                probe_total[held[out]] += path[at[held[out]]]
                renumbered = np.cumsum(~done, dtype=np.int32) - 1
                at[held] = np.where(out, -1, renumbered[at[held]])
                order, size, depth, source, tries = moved[~ended], new_size[~done], new_depth[~done], new_source[~done], tries[~done]
    paths[row, col] = total / max(trees, 1)
    return paths, probe_total / max(trees, 1), expected


def isolation_score(path: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Score in (0, 1) of mean path lengths; 0 where nothing is to be expected (a single reading)."""
    return np.where(expected > 0, np.exp2(-path / np.maximum(expected, 1e-9)), 0.0)

"""Elastic distance kernels.

Dynamic programs run over a padded batch of pairs at once: each anti-diagonal of
the cost matrix is one numpy operation over all pairs of the batch, and the value
of a pair is read at its own last cell. Values that must equal those of the
reference engine (cost terms, defaults, results for empty series) are noted at
each kernel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

#: Fixed value: the cost of cells outside a band.
FAR = np.finfo(np.float64).max


def pad(series: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of the series with zeros behind, and their lengths."""
    length = np.array([len(s) for s in series])
    shape = (len(series), max(1, int(length.max(initial=0))))
    tail = series[0].shape[1:] if len(series) else ()
    out = np.zeros(shape + tail)
    for i, s in enumerate(series):
        out[i, : len(s)] = s
    return out, length


def across(v: np.ndarray) -> np.ndarray:
    """Places first, pairs behind: cells of one anti-diagonal lie beside each other."""
    return np.ascontiguousarray(np.moveaxis(v, 0, 1))


def before(v: np.ndarray) -> np.ndarray:
    """The value one place earlier; the first stays."""
    return np.concatenate([v[:1], v[:-1]])


def same(v: np.ndarray) -> np.ndarray:
    """One entry in place of many equal ones."""
    return v[:1] if len(v) and (v == v[0]).all() else v


def sweep(left: list[np.ndarray], na: np.ndarray, right: list[np.ndarray], nb: np.ndarray, step: Callable, first: float = np.inf, edges: Callable | None = None, limit: float | None = None, rows: tuple[np.ndarray, np.ndarray] | None = None, kind: type = float) -> np.ndarray:
    """Fill D over anti-diagonals for all pairs at once and return D[na, nb].

    ``left`` and ``right`` are arrays over (place, pair); one column meets all pairs.
    ``D`` has a border row and column: D[0, 0] = 0 and ``first`` elsewhere, or what
    ``edges(k)`` gives as (D[k, 0], D[0, k]). ``step(x, y, i, j, diag, up, left)`` gets the
    values of both sides at the cells, their 1-based places and the three neighbours.
    Cells outside ``rows``, the first and last place on the left for each anti-diagonal
    (``hull``), are inf. A pair leaves with inf when no way through its cells is within
    ``limit``: every way meets one of two neighbouring diagonals, and costs never fall along
    it. For the same reason cells that no pair reaches within ``limit`` are passed over.
    ``kind``: the type of D.
    """
    n, m = len(left[0]), len(right[0])
    pairs = max(len(na), len(nb))
    na, nb = np.broadcast_to(na, pairs), np.broadcast_to(nb, pairs)
    out = np.full(pairs, np.nan if limit is None else np.inf)
    last = na + nb
    out[last == 0] = 0.0
    back, here = [r[::-1] for r in right], np.arange(pairs)
    prev2, prev, cur = (np.empty((n + 1, pairs), kind) for _ in range(3))
    prev[0] = 0
    low = np.zeros(pairs)
    least, most, was = 1, n, (1, 0)
    for d in range(1, n + m + 1):
        lo, hi = max(0, d - m), min(n, d)
        if lo == 0:
            cur[0] = edges(d)[1] if edges else first
        if hi == d:
            cur[d] = edges(d)[0] if edges else first
        top, end = max(1, lo), min(n, d - 1)
        i0, i1 = max(top, least), min(end, most)
        if rows is not None:
            i0, i1 = max(i0, rows[0][d]), min(i1, rows[1][d])
        if top < i0 <= i1:
            cur[i0 - 1] = np.inf
        if i0 <= i1 < end:
            cur[i1 + 1] = np.inf
        if i0 <= i1:
            i = np.arange(i0, i1 + 1)[:, None]
            x, y = [v[i0 - 1 : i1] for v in left], [v[m - d + i0 : m - d + i1 + 1] for v in back]
            cur[i0 : i1 + 1] = step(x, y, i, d - i, prev2[i0 - 1 : i1], prev[i0 - 1 : i1], prev[i0 : i1 + 1])
        elif top <= end:
            cur[top : end + 1] = np.inf
        done = np.flatnonzero(last == d)
        if len(done):
            found = cur[na[done], done]
            if limit is not None or rows is not None:
                found = np.where((na[done] >= i0) & (na[done] <= i1), found, np.inf)
            out[here[done]] = found
        most += 1
        if limit is not None and d % 4 in (3, 0) and i0 <= i1:
            now = cur[i0 : i1 + 1].min(axis=0)
            stay = np.minimum(low, now) <= limit
            low = now
            if d % 4 == 0:
                # Next come cells below or beside those of this diagonal, or across from the one before.
                alive, lived = (i0 + np.flatnonzero((cur[i0 : i1 + 1] <= limit).any(axis=1))).tolist(), (was[0] + 1 + np.flatnonzero((prev[was[0] : was[1] + 1] <= limit).any(axis=1))).tolist()
                if not alive and not lived:
                    break
                least, most = max(least, min(alive[:1] + lived[:1])), min(most, max([1 + k for k in alive[-1:]] + lived[-1:]))
                if stay.mean() < 0.7:
                    keep = np.flatnonzero(stay & (last > d))
                    if not len(keep):
                        break
                    here, na, nb, last, low = here[keep], na[keep], nb[keep], last[keep], low[keep]
                    left = [v if v.shape[1] == 1 else v[:, keep] for v in left]
                    back = [v if v.shape[1] == 1 else v[:, keep] for v in back]
                    prev2, prev, cur = (v[:, keep] for v in (prev2, prev, cur))
        was = i0, i1
        prev2, prev, cur = prev, cur, prev2
    return out


def hull(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """The first and last row of the cells ``inside`` on each anti-diagonal, for ``sweep``:
    the first never falls and the last grows by one at most, so that a step finds inf beside
    them. None if the last cell is outside."""
    n, m = inside.shape
    if not inside.size or not inside[-1, -1]:
        return None
    i, j = np.nonzero(inside)
    first, end = np.full(n + m + 1, n + m), np.full(n + m + 1, -n - m)
    np.minimum.at(first, i + j + 2, i + 1)
    np.maximum.at(end, i + j + 2, i + 1)
    at = np.arange(n + m + 1)
    return np.minimum.accumulate(first[::-1])[::-1], np.maximum.accumulate((end - at)[::-1])[::-1] + at


def _empty(values: np.ndarray, na: np.ndarray, nb: np.ndarray, either: float, both: float | None = None) -> np.ndarray:
    values = np.where((na == 0) | (nb == 0), either, values)
    return values if both is None else np.where((na == 0) & (nb == 0), both, values)


def _cheapest(g: np.ndarray, u: np.ndarray, l: np.ndarray) -> np.ndarray:
    least = np.minimum(g, u)
    return np.minimum(least, l, out=least)


def _gap(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    gap = x - y
    return np.abs(gap, out=gap)


def _dtw_step(x, y, i, j, g, u, l):
    return _cheapest(g, u, l) + _gap(x[0], y[0])


def dtw(a, na, b, nb, limit: float | None = None):
    return _empty(sweep([across(a)], na, [across(b)], nb, _dtw_step, limit=limit), na, nb, np.inf)


def _cells(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """0-based places of all cells, if all pairs have one shape."""
    if (na == a.shape[1]).all() and (nb == b.shape[1]).all():
        return np.arange(a.shape[1])[:, None], np.arange(b.shape[1])[None, :]
    return None


def dtw_sakoe_chiba(a, na, b, nb, window: int = 10):
    """The band is the larger of ``window`` and the difference in length."""
    band = same(np.maximum(window, np.abs(na - nb)))
    at = _cells(a, na, b, nb)
    rows = hull(np.abs(at[0] - at[1]) <= band[0]) if at else None

    def step(x, y, i, j, g, u, l):
        v = _dtw_step(x, y, i, j, g, u, l)
        return v if len(band) == 1 and (np.abs(i - j) <= band).all() else np.where(np.abs(i - j) <= band, v, np.inf)

    return _empty(np.where(np.isinf(v := sweep([across(a)], na, [across(b)], nb, step, rows=rows)), FAR, v), na, nb, np.inf)


def dtw_itakura(a, na, b, nb, max_slope: float = 2.0):
    """Cells inside the parallelogram of slopes max_slope and 1 / max_slope."""
    n, m = same(na).astype(float), same(nb).astype(float)

    def within(x, y):
        rx, ry = n - 1 - x, m - 1 - y
        return (y <= max_slope * x) & (y >= x / max_slope) & (ry <= max_slope * rx) & (ry >= rx / max_slope)

    at = _cells(a, na, b, nb)
    rows = hull(within(*(v.astype(float) for v in at))) if at else None

    def step(s, t, i, j, g, u, l):
        inside, v = within((i - 1).astype(float), (j - 1).astype(float)), _dtw_step(s, t, i, j, g, u, l)
        return v if inside.shape[1] == 1 and inside.all() else np.where(inside, v, np.inf)

    return _empty(np.where(np.isinf(v := sweep([across(a)], na, [across(b)], nb, step, rows=rows)), FAR, v), na, nb, np.inf)


def _banded(x: np.ndarray, y: np.ndarray, low: np.ndarray, high: np.ndarray, ways: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Costs and, if ``ways``, steps (0 diagonal, 1 along x, 2 along y) of pairs of one shape,
    for the cells of row i from low[i] to high[i]. Places stand first, pairs behind."""
    (n, pairs), m = x.shape, len(y)
    way = np.zeros((n, m, pairs), np.int8) if ways else None
    back, odd = y[::-1], not (np.isfinite(x).all() and np.isfinite(y).all())
    kind = np.int8 if n + m < 127 else np.int16 if n + m < 32_767 else np.int64
    # Cells of a row in terms of the anti-diagonal: from low + i to high + i.
    at = np.arange(n)[:, None]
    start, stop = (low + at + 2).astype(kind), (high + at + 2).astype(kind)
    first, end = start.min(axis=1), stop.max(axis=1)
    full = (start.max(axis=1) == first) & (stop.min(axis=1) == end)
    prev2, prev, cur = (np.full((n + 1, pairs), np.inf) for _ in range(3))
    prev2[0] = 0.0
    for d in range(2, n + m + 1):
        lo, hi = max(1, d - m), min(n, d - 1)
        on = np.flatnonzero((first[lo - 1 : hi] <= d) & (d <= end[lo - 1 : hi]))
        cur.fill(np.inf)
        if len(on):
            i0, i1 = lo + int(on[0]), lo + int(on[-1])
            g, u, l, now = prev2[i0 - 1 : i1], prev[i0 - 1 : i1], prev[i0 : i1 + 1], cur[i0 : i1 + 1]
            np.minimum(np.minimum(g, u, out=now), l, out=now)
            if ways:
                i = np.arange(i0, i1 + 1)
                way[i - 1, d - i - 1] = np.stack([g, u, l]).argmin(0) if odd else (g > now) * ((u > now).view(np.int8) + np.int8(1))
            now += _gap(x[i0 - 1 : i1], back[m - d + i0 : m - d + i1 + 1])
            if not full[i0 - 1 : i1].all() or len(on) <= i1 - i0:
                now[(start[i0 - 1 : i1] > d) | (stop[i0 - 1 : i1] < d)] = np.inf
        prev2, prev, cur = prev, cur, prev2
    return prev[n], way


def _fast(x: np.ndarray, y: np.ndarray, radius: int, ways: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """FastDTW of pairs of one shape: the path at half the resolution, widened by
    ``radius``, bounds the cells. Places stand first, pairs behind."""
    (n, pairs), m = x.shape, len(y)
    if n <= radius + 2 or m <= radius + 2:
        return _banded(x, y, np.zeros((n, pairs), int), np.full((n, pairs), m - 1), ways)
    half = lambda v: np.concatenate([v[: len(v) // 2 * 2].reshape(-1, 2, v.shape[1]).mean(axis=1), v[len(v) // 2 * 2 :]])
    _, way = _fast(half(x), half(y), radius, True)
    p, q, r = np.full(pairs, len(way) - 1), np.full(pairs, way.shape[1] - 1), np.arange(pairs)
    # The first and last place of y on the path for each place of x.
    least, most = np.full((len(way), pairs), m), np.full((len(way), pairs), -1)
    while len(r):
        least[p, r] = q
        most[p, r] = np.maximum(most[p, r], q)
        step = way[p, q, r]
        p, q = p - (step < 2), q - (step != 1)
        on = (p >= 0) & (q >= 0)
        if not on.all():
            r, p, q = r[on], p[on], q[on]
    # A cell of the path reaches the rows up to ``radius`` of its own scale away.
    near = np.arange(-radius, radius + 1)[:, None] + np.arange(len(way))
    inside = ((near >= 0) & (near < len(way)))[..., None]
    near = np.clip(near, 0, len(way) - 1)
    low, high = np.where(inside, least[near], m).min(axis=0), np.where(inside, most[near], -1).max(axis=0)
    low = np.where(low == m, m, np.maximum(0, 2 * (low - radius)))
    high = np.where(high < 0, -1, np.minimum(m - 1, 2 * (high + radius) + 1))
    return _banded(x, y, np.repeat(low, 2, axis=0)[:n], np.repeat(high, 2, axis=0)[:n], ways)


def fast_dtw(a, na, b, nb, radius: int = 5, batch_cells: int = 4_000_000):
    pairs = max(len(a), len(b))
    a, b, na, nb = (np.broadcast_to(v, (pairs, *v.shape[1:])) for v in (a, b, na, nb))
    out = np.full(pairs, np.inf)
    for n, m in {(int(n), int(m)) for n, m in zip(na, nb) if n and m}:
        alike = np.flatnonzero((na == n) & (nb == m))
        for take in np.array_split(alike, -(-len(alike) * n * m // batch_cells)):
            out[take] = _fast(across(a[take, :n]), across(b[take, :m]), radius)[0]
    return out


def derivative(v: np.ndarray) -> np.ndarray:
    """Keogh and Pazzani's derivative, its ends repeated."""
    mid = ((v[..., 1:-1] - v[..., :-2]) + (v[..., 2:] - v[..., :-2]) / 2) / 2
    return np.concatenate([mid[..., :1], mid, mid[..., -1:]], axis=-1)


def _derivatives(v: np.ndarray, length: np.ndarray) -> np.ndarray:
    if v.shape[1] >= 3 and (length == v.shape[1]).all():
        return derivative(v)
    return pad([derivative(r[:n]) if n >= 3 else np.zeros(n) for r, n in zip(v, length)])[0]


def ddtw(a, na, b, nb):
    return np.where((na < 3) | (nb < 3), np.inf, dtw(_derivatives(a, na), na, _derivatives(b, nb), nb))


def wdtw(a, na, b, nb, g: float = 0.05):
    """Squared cost times a logistic weight of the index gap, centred at half the
    longer length."""
    middle = same(np.maximum(na, nb)) / 2

    def step(x, y, i, j, d, u, l):
        weight = 1 / (1 + np.exp(-g * (np.abs(i - j) - middle)))
        return weight * (x[0] - y[0]) ** 2 + _cheapest(d, u, l)

    return _empty(sweep([across(a)], na, [across(b)], nb, step), na, nb, np.inf)


def _msm_side(v: np.ndarray) -> list[np.ndarray]:
    """The values and, signed, how far the value before lies below and above them."""
    back = before(v) - v
    return [v, np.minimum(back, 0.0), np.maximum(back, 0.0)]


@lru_cache(maxsize=512)
def _detours(n: int, m: int, more: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows, for ``sweep``, of the cells that a way from the first to the last cell meets
    with ``more`` steps each way beyond the difference in length."""
    ahead = np.arange(n)[:, None] - np.arange(m)
    return hull((ahead >= min(0, n - m) - more) & (ahead <= max(0, n - m) + more))


def msm(a, na, b, nb, c: float = 1.0, gain: int = 5000):
    """Move-split-merge; empty series give 0. A split or merge costs ``c`` and the distance
    from the interval between the value before and the other series' value, which is the gap
    to the latter, cut at the step to the former.

    Moves along the diagonal and then the edge are one way, and bound the distance from above.
    A way off it pays ``c`` for each step off and back again, so pairs of one shape fill only
    the cells that this bound lets them reach. Those that reach far go apart from the others
    when this saves ``gain`` steps over all pairs. Pairs of several shapes, and those with a
    missing or infinite value, fill all cells."""

    def step(s, t, i, j, g, u, l):
        (x, xl, xh), (y, yl, yh) = s, t
        gap = x - y
        left = np.minimum(gap, yh)
        np.maximum(left, yl, out=left)
        np.abs(left, out=left)
        left += c
        left += l
        up = np.minimum(gap, xh)
        np.maximum(up, xl, out=up)
        np.abs(up, out=up)
        up += c
        up += u
        np.minimum(left, up, out=left)
        np.abs(gap, out=gap)
        gap += g
        return np.minimum(gap, left, out=left)

    s, t = _msm_side(across(a)), _msm_side(across(b))
    s = [s[0], -s[2], -s[1]]  # the gap has the other sign there
    (n, m), pairs = (len(s[0]), len(t[0])), max(len(na), len(nb))
    if not c > 0 or _cells(a, na, b, nb) is None:
        return _empty(sweep(s, na, t, nb, step), na, nb, 0.0)
    k = min(n, m)
    bound = np.abs(s[0][:k] - t[0][:k]).sum(axis=0) + np.abs(s[0][k:] - t[0][-1]).sum(axis=0) + np.abs(s[0][-1] - t[0][k:]).sum(axis=0)
    # A little more than the bound, for what sums are rounded by; NaN and inf reach all cells.
    more = np.where(bound < 2.0 * c * k, bound * (1 + 1e-9) / (2 * c), k).astype(int)
    out, done, size = np.empty(pairs), -1, np.frexp(more)[1]
    furthest = [int(more[size == level].max()) for level in np.unique(size)]
    for here, there in zip(furthest, [*furthest[1:], np.inf]):
        at = np.flatnonzero((more > done) & (more <= here))
        if len(at) * (there - here) < gain:
            continue
        one, two = ([v if len(at) == pairs or v.shape[1] == 1 else v[:, at] for v in side] for side in (s, t))
        out[at] = sweep(one, np.full(len(at), n), two, np.full(len(at), m), step, rows=_detours(n, m, here))
        done = here
    return out


def erp(a, na, b, nb, g: float = 0.0):
    x, y = across(a), across(b)
    ca, cb = np.abs(x - g), np.abs(y - g)
    ga, gb = np.cumsum(ca, axis=0), np.cumsum(cb, axis=0)
    edges = lambda k: (ga[min(k, len(ga)) - 1], gb[min(k, len(gb)) - 1])

    def step(x, y, i, j, d, u, l):
        v = _gap(x[0], y[0])
        v += d
        w = u + x[1]
        np.minimum(v, w, out=v)
        return np.minimum(v, np.add(l, y[1], out=w), out=v)

    return sweep([x, ca], na, [y, cb], nb, step, edges=edges)


def lcss(a, na, b, nb, epsilon: float = 1.0):
    """1 - LCSS / min(n, m), as a least number of unmatched steps; empty gives 1. Counts are
    whole numbers, in the smallest type that holds them."""

    def step(x, y, i, j, d, u, l):
        # A match is never worse than what is above or on the left, nor is that worse than the diagonal.
        return _cheapest(d - (_gap(x[0], y[0]) <= epsilon).view(np.int8), u, l)

    longest = min(a.shape[1], b.shape[1])
    value = -sweep([across(a)], na, [across(b)], nb, step, first=0, kind=np.int8 if longest < 128 else np.int32)
    return _empty(1 - value / np.maximum(np.minimum(na, nb), 1), na, nb, 1.0)


def edr(a, na, b, nb, epsilon: float = 0.1):
    def step(x, y, i, j, d, u, l):
        return np.minimum(d + (_gap(x[0], y[0]) > epsilon), np.minimum(u, l) + 1)

    value = sweep([across(a)], na, [across(b)], nb, step, edges=lambda k: (float(k), float(k)))
    return _empty(value / np.maximum(np.maximum(na, nb), 1), na, nb, 1.0)


def twe(a, na, b, nb, nu: float = 0.001, lambda_: float = 1.0):
    """Time-warp edit; a zero stands before the first sample, and the stiffness of
    a match is nu * min(|i - j|, 2 nu)."""

    def side(v):
        v = across(v)
        held = np.concatenate([np.zeros_like(v[:1]), v[:-1]])
        return [v, held, np.abs(v - held) + nu + lambda_]

    def step(s, t, i, j, d, u, l):
        (x, xp, cx), (y, yp, cy) = s, t
        match = d + _gap(x, y) + _gap(xp, yp) + nu * np.minimum(np.abs(i - j), 2 * nu)
        return np.minimum(np.minimum(match, u + cx), l + cy)

    return sweep(side(a), na, side(b), nb, step)


def frechet(a, na, b, nb):
    def step(x, y, i, j, d, u, l):
        v = _cheapest(d, u, l)
        return np.maximum(_gap(x[0], y[0]), v, out=v)

    return _empty(sweep([across(a)], na, [across(b)], nb, step), na, nb, np.inf)


#: Length up to which shifts are a product of matrices.
SHIFTED = 256


def sbd(a, na, b, nb):
    """1 - the largest cross-correlation over the product of norms (without
    z-normalisation); a zero norm gives 1, an empty series 2. One series meets others of one
    length as a product with the matrix of its shifts, while that is cheaper than a
    transform; else all shifts come from one
    transform, and those at which the series do not meet do not count."""
    pairs, (n, m) = max(len(a), len(b)), (a.shape[1], b.shape[1])
    if len(a) == 1 and max(n, m) <= SHIFTED and na[0] == n and (nb == m).all():
        wide = np.zeros(n + 2 * (m - 1))
        wide[m - 1 : m - 1 + n] = a[0]
        most = (np.lib.stride_tricks.sliding_window_view(wide, m).copy() @ b.T).max(axis=0)
        norm = np.linalg.norm(a[0]) * np.sqrt(np.einsum("ij,ij->i", b, b))
        return np.where(norm > 0, 1 - most / np.where(norm > 0, norm, 1), 1.0)
    size = 1 << (n + m - 2).bit_length()
    na, nb = np.broadcast_to(na, pairs), np.broadcast_to(nb, pairs)
    cc = np.fft.irfft(np.fft.rfft(a, size) * np.conj(np.fft.rfft(b, size)), size)
    if (na == n).all() and (nb == m).all():
        most = cc[:, :n].max(axis=1)
        most = np.maximum(most, cc[:, size - m + 1 :].max(axis=1)) if m > 1 else most
    else:
        at = np.arange(size)
        most = np.where((at < na[:, None]) | (at > size - nb[:, None]), cc, -np.inf).max(axis=1)
    norm = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
    return _empty(np.where(norm > 0, 1 - most / np.where(norm > 0, norm, 1), 1.0), na, nb, 2.0)


def dtw_multi(a, na, b, nb, metric: str = "manhattan"):
    def step(x, y, i, j, d, u, l):
        gap = x[0] - y[0]
        cost = np.sqrt((gap**2).sum(-1)) if metric == "euclidean" else np.abs(gap).sum(-1)
        return cost + _cheapest(d, u, l)

    return _empty(sweep([across(a)], na, [across(b)], nb, step), na, nb, np.inf)


def msm_multi(a, na, b, nb, c: float = 1.0):
    """Dependent move-split-merge on points, with squared costs: a point lies
    between two others when it is within half their squared distance of the middle."""
    square = lambda p, q: ((p - q) ** 2).sum(-1)

    def cost(new, before, other):
        diameter = square(before, other)
        near = square((before + other) / 2, new)
        return np.where(near <= diameter / 2, c, c + np.minimum(square(new, before), square(new, other)))

    def step(s, t, i, j, g, u, l):
        (x, xp), (y, yp) = s, t
        corner = (i == 1) & (j == 1)
        edge = ((i == 1) | (j == 1)) & ~corner
        move = np.where(corner, 0.0, g) + square(x, y)
        up = np.where(i == 1, np.inf, u + cost(x, xp, y))
        left = np.where(j == 1, np.inf, l + cost(y, x, yp))
        return np.minimum(np.minimum(np.where(edge, np.inf, move), up), left)

    x, y = across(a), across(b)
    return _empty(sweep([x, before(x)], na, [y, before(y)], nb, step), na, nb, 0.0)


#: name: (kernel, allowed keywords, several dimensions)
KERNELS: dict[str, tuple[Callable, tuple[str, ...], bool]] = {
    "dtw": (dtw, (), False), "sakoe_chiba": (dtw_sakoe_chiba, ("window",), False), "itakura": (dtw_itakura, ("max_slope",), False), "fast_dtw": (fast_dtw, ("radius",), False),
    "ddtw": (ddtw, (), False), "wdtw": (wdtw, ("g",), False), "msm": (msm, ("c",), False), "erp": (erp, ("g",), False), "lcss": (lcss, ("epsilon",), False),
    "twe": (twe, ("nu", "lambda_"), False), "sbd": (sbd, (), False), "frechet": (frechet, (), False), "edr": (edr, ("epsilon",), False),
    "dtw_multi": (dtw_multi, ("metric",), True), "msm_multi": (msm_multi, ("c",), True),
}


def distances(name: str, left: list[np.ndarray], right: list[np.ndarray], batch_cells: int = 4_000_000, **options) -> np.ndarray:
    """The distance of each pair (left[i], right[i])."""
    kernel = KERNELS[name][0]
    out = np.empty(len(left))
    order = np.argsort([len(x) + len(y) for x, y in zip(left, right)], kind="stable")
    at = 0
    while at < len(order):
        longest = max(len(left[order[min(at + 255, len(order) - 1)]]), len(right[order[min(at + 255, len(order) - 1)]]), 1)
        take = order[at : at + max(1, min(2048, batch_cells // (longest * 8)))]
        a, na = pad([left[i] for i in take])
        b, nb = pad([right[i] for i in take])
        out[take] = kernel(a, na, b, nb, **options)
        at += len(take)
    return out


#: Bands of values in which ``travelled`` sums up changes.
BANDS = 32


def travelled(series: list[np.ndarray], cuts: np.ndarray) -> np.ndarray:
    """The sums of absolute changes of each series within each band between ``cuts``.

    Warping repeats values, which changes no sum, and the bands share out each difference of
    two matched values. A match takes part in the change before and after it, the first and the last match in
    one. So the sums of two series differ, over all bands, by at most twice their DTW distance
    less the gaps of the first and the last values."""
    edges = np.concatenate([[-np.inf], cuts, [np.inf]])
    flat = np.concatenate(series) if series else np.empty(0)
    length = np.array([len(s) for s in series], int)
    owner = np.repeat(np.arange(len(series)), length)
    inner = owner[1:] == owner[:-1]
    return np.stack([np.bincount(owner[1:][inner], np.abs(np.diff(np.clip(flat, lo, hi)))[inner], len(series)) for lo, hi in zip(edges, edges[1:])])


def near_pairs(left: list[np.ndarray], right: list[np.ndarray], keep: Callable | None, within: float, batch: int = 2048) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``block_distances`` of DTW, where larger distances than ``within`` are left out or inf.
    Pairs that their ends and ``travelled`` keep apart are not warped; the others are, many left series
    at a time."""
    if not left or not right:
        return
    values = np.concatenate([*left, *right])
    values = values[np.isfinite(values)]
    cuts = np.quantile(values, np.arange(1, BANDS) / BANDS) if len(values) else np.zeros(0)
    ways = [travelled(v, cuts) for v in (left, right)]
    total = [w.sum(axis=0) for w in ways]
    size, limit = np.array([len(y) for y in right]), within * (1 + 1e-9)
    ends = np.array([[y[0], y[-1]] if len(y) else [np.nan, np.nan] for y in right])
    order = np.argsort(size, kind="stable")

    def solve(waiting: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        to = np.concatenate([take for _, take in waiting])
        a, na = pad([left[at] for at, _ in waiting])
        times = [len(take) for _, take in waiting]
        b, nb = pad([right[k] for k in to])
        d = dtw(np.repeat(a, times, axis=0), np.repeat(na, times), b, nb, limit=limit)
        for (at, take), found in zip(waiting, np.split(d, np.cumsum(times)[:-1])):
            yield at, take, found

    waiting, n = [], 0
    for at, x in enumerate(left):
        if not len(x):
            continue
        gaps = np.abs(x[0] - ends[:, 0]) + np.where((len(x) > 1) | (size > 1), np.abs(x[-1] - ends[:, 1]), 0.0)
        apart = np.abs(ways[0][:, at, None] - ways[1]).sum(axis=0) + gaps
        wanted = ~(gaps > limit) & ~(apart > 2 * limit + 1e-10 * (total[0][at] + total[1])) & (size > 0)
        if keep is not None:
            wanted &= keep(at)
        take = order[wanted[order]]
        for part in np.array_split(take, -(-len(take) // batch)) if len(take) else []:
            waiting.append((at, part))
            n += len(part)
            if n >= batch:
                yield from solve(waiting)
                waiting, n = [], 0
    if waiting:
        yield from solve(waiting)


def block_distances(name: str, left: list[np.ndarray], right: list[np.ndarray], keep: np.ndarray | None = None, within: float | None = None, batch: int | None = None, **options) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Every left series with every right one, a batch of pairs at a time: the place of a left
    series, places of right series and their distances. ``keep(place)`` masks the right ones
    that are wanted. ``within``: larger distances may be left out or inf."""
    if name == "dtw" and within is not None:
        yield from near_pairs(left, right, keep, within)
        return
    kernel, batch = KERNELS[name][0], batch or (2048 if name == "msm" else 1024)  # few cells of a pair: more pairs
    order = np.argsort([len(y) for y in right], kind="stable")
    packs = [(take, *pad([right[i] for i in take]), []) for take in np.array_split(order, -(-len(order) // batch))] if len(order) else []

    def solve(b: np.ndarray, nb: np.ndarray, waiting: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        times = [len(on) for _, _, on in waiting]
        a, na = pad([left[at] for at, _, _ in waiting])
        if len(waiting) > 1:  # else one column meets all pairs
            a, na = np.repeat(a, times, axis=0), np.repeat(na, times)
        on = np.concatenate([on for _, _, on in waiting])
        whole = len(on) == len(b) and len(waiting) == 1
        d = kernel(a, na, b if whole else b[on], nb if whole else nb[on], **options)
        for (at, places, _), found in zip(waiting, np.split(d, np.cumsum(times)[:-1])):
            yield at, places, found
        waiting.clear()

    for at in np.argsort([len(x) for x in left], kind="stable").tolist():
        mask = None if keep is None else keep(at)
        for take, b, nb, waiting in packs:
            on = np.arange(len(take)) if mask is None else np.flatnonzero(mask[take])
            if len(on):
                waiting.append((at, take[on], on))
                # Few pairs of one series wait for those of the next, where that pays.
                if name == "sbd" or sum(len(w[2]) for w in waiting) > batch // 2:
                    yield from solve(b, nb, waiting)
    for _, b, nb, waiting in packs:
        if waiting:
            yield from solve(b, nb, waiting)

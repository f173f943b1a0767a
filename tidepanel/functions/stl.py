"""Local regression and seasonal-trend decomposition of many series at once.

Series of equal length are the rows of a matrix; every step works on all of them.
The steps are those of Cleveland et al. (1990), without jumps, and the turns over
several periods those of Bandara et al. (2021).
"""

from __future__ import annotations

import math

import numpy as np

#: Cells of one block of windows (series x places x window), about 16 MB each array.
_CELLS = 2_000_000


def odd_from(x: float) -> int:
    """The least odd integer that is not below x."""
    n = math.ceil(x)
    return n + 1 - n % 2


def loess(y: np.ndarray, window: int, degree: int = 1, weights: np.ndarray | None = None, places: np.ndarray | None = None) -> np.ndarray:
    """Local regression of every row of ``y`` (series, n) over 0..n-1, evaluated at
    ``places`` (integers, also just outside; all of 0..n-1 by default).

    At a place the ``window`` nearest points are weighed by the tricube of their
    distance over the largest of them (widened by half of what a window longer
    than the series lacks), times ``weights`` of the shape of ``y``. The fit is a
    weighted mean (degree 0) or line (1); a line that its points do not determine
    is a mean; without any weight the value at the nearest point is kept."""
    series, n = y.shape
    places = np.arange(n) if places is None else np.asarray(places)
    q = min(window, n)
    first = np.clip(places - (q - 1) // 2, 0, n - q)
    # The block of q nearest points: the clipped centre is it, for odd windows and equal steps.
    at = first[:, None] + np.arange(q)[None, :]
    d = (at - places[:, None]).astype(float)
    reach = np.abs(d).max(1) + (max(0, window - n) // 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.where(reach[:, None] > 0, np.abs(d) / reach[:, None], 0.0)
    base = np.where(r <= 0.999, np.where(r <= 0.001, 1.0, (1 - r**3) ** 3), 0.0)
    out = np.empty((series, len(places)))
    step = max(1, _CELLS // max(1, series * q))
    for low in range(0, len(places), step):
        cut = slice(low, low + step)
        w = base[cut][None] if weights is None else base[cut][None] * weights[:, at[cut]]
        v = y[:, at[cut]]
        s0 = w.sum(2)
        mean = (w * v).sum(2)
        if degree:
            dd = d[cut][None]
            s1, s2 = (w * dd).sum(2), (w * dd * dd).sum(2)
            cross = (w * dd * v).sum(2)
            det = s0 * s2 - s1 * s1
            # The spread of the weighed points, against that of the whole series.
            line = det > (0.001 * (n - 1)) ** 2 * s0 * s0
            with np.errstate(divide="ignore", invalid="ignore"):
                fit = np.where(line, (s2 * mean - s1 * cross) / det, mean / s0)
        else:
            with np.errstate(divide="ignore", invalid="ignore"):
                fit = mean / s0
        near = y[:, np.clip(places[cut], 0, n - 1)]
        out[:, cut] = np.where(s0 > 0, fit, near)
    return out


def _moving_mean(y: np.ndarray, k: int) -> np.ndarray:
    total = np.cumsum(np.pad(y, ((0, 0), (1, 0))), axis=1)
    return (total[:, k:] - total[:, :-k]) / k


def _phases(y: np.ndarray, period: int, window: int, degree: int, weights: np.ndarray | None) -> np.ndarray:
    """Every phase smoothed over its cycles and continued by one cycle at both
    ends: (series, n + 2 periods)."""
    series, n = y.shape
    out = np.empty((series, n + 2 * period))
    # Phases have one of two lengths; those of one length are smoothed together.
    for low, high in ((0, n % period), (n % period, period)):
        if low == high:
            continue
        phases = np.arange(low, high)
        k = len(range(low, n, period))
        at = phases[:, None] + period * np.arange(k)[None, :]
        stack = y[:, at].reshape(-1, k)
        own = None if weights is None else weights[:, at].reshape(-1, k)
        smooth = loess(stack, window, degree, own, np.arange(-1, k + 1)).reshape(series, len(phases), k + 2)
        out[:, phases[:, None] + period * np.arange(k + 2)[None, :]] = smooth
    return out


def stl(y: np.ndarray, period: int, seasonal_window: int, trend_window: int | None = None, seasonal_degree: int = 0, inner: int = 2, robust: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seasonal, trend, weights) of every row of ``y`` (series, n), n >= 2 periods.

    ``inner`` rounds smooth the phases, take out what of them is low-pass, and
    smooth the rest for the trend. ``robust`` times after that, points are weighed
    down by the bisquare of their remainder over six median remainders."""
    series, n = y.shape
    trend_window = trend_window or odd_from(1.5 * period / (1 - 1.5 / seasonal_window))
    low_window = odd_from(period)
    trend = np.zeros_like(y)
    weights = None
    for outer in range(robust + 1):
        for _ in range(inner):
            cycle = _phases(y - trend, period, seasonal_window, seasonal_degree, weights)
            low = loess(_moving_mean(_moving_mean(_moving_mean(cycle, period), period), 3), low_window, 1)
            seasonal = cycle[:, period : period + n] - low
            trend = loess(y - seasonal, trend_window, 1, weights)
        if outer < robust:
            rest = np.abs(y - seasonal - trend)
            scale = 6 * np.median(rest, axis=1, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                r = np.where(scale > 0, rest / scale, 0.0)
            weights = np.where(r <= 0.001, 1.0, np.where(r <= 0.999, (1 - r**2) ** 2, 0.0))
    return seasonal, trend, np.ones_like(y) if weights is None else weights


def mstl(y: np.ndarray, periods: list[int], seasonal_windows: list[int] | None = None, rounds: int = 2, robust: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(trend, seasonal (periods, series, n)). Periods take turns, shortest first,
    each on what the others leave; a period of which a series holds less than two
    cycles has no part in it. Without any, the trend is one local line."""
    series, n = y.shape
    seasonal = np.zeros((len(periods), series, n))
    order = [i for i in np.argsort(periods, kind="stable") if 2 * periods[i] <= n]
    windows = seasonal_windows or [7 + 4 * (k + 1) for k in range(len(periods))]
    if not order:
        return (loess(y, odd_from(max(3, n / 2)), 1) if n else y.copy()), seasonal
    # Windows grow with the periods' ranks, as periods do.
    rank = {i: k for k, i in enumerate(np.argsort(periods, kind="stable"))}
    trend = np.zeros_like(y)
    rest = y.copy()
    for _ in range(rounds if len(order) > 1 else 1):
        for i in order:
            rest = rest + seasonal[i]
            seasonal[i], trend, _ = stl(rest, periods[i], windows[rank[i]], robust=robust)
            rest = rest - seasonal[i]
    return trend, seasonal

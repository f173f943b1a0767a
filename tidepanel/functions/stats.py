"""Special functions, distributions and small optimisers in numpy."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np

normal_quantile = NormalDist().inv_cdf
normal_cdf = NormalDist().cdf


def gamma_p(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * front
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - h * front


def chi2_sf(x: float, k: float) -> float:
    return 1 - gamma_p(k / 2, x / 2) if x > 0 else 1.0


def beta_i(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h / a


def f_sf(x: float, d1: float, d2: float) -> float:
    return beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * x)) if x > 0 else 1.0


def student_t_cdf(t: float, df: float) -> float:
    tail = 0.5 * beta_i(df / 2, 0.5, df / (df + t * t))
    return 1 - tail if t > 0 else tail


def student_t_logpdf(x, df, loc, scale):
    z = (x - loc) / scale
    lg = np.vectorize(math.lgamma)
    return lg((df + 1) / 2) - lg(df / 2) - 0.5 * np.log(df * np.pi) - np.log(scale) - (df + 1) / 2 * np.log1p(z * z / df)


def logsumexp(x: np.ndarray, axis=None):
    top = np.max(x, axis=axis, keepdims=True)
    out = np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top
    return out.squeeze() if axis is None else out.squeeze(axis)


def nelder_mead(fn: Callable[[np.ndarray], float], start: np.ndarray, max_iter: int = 200, step: float = 0.1, tol: float = 1e-8) -> tuple[np.ndarray, float]:
    start = np.asarray(start, float)
    simplex = [start] + [start + np.eye(len(start))[i] * (step * abs(start[i]) or step) for i in range(len(start))]
    points = sorted(((fn(x), i, x) for i, x in enumerate(simplex)), key=lambda p: p[0])
    points = [(f, x) for f, _, x in points]
    for _ in range(max_iter * max(1, len(start))):
        if abs(points[-1][0] - points[0][0]) <= tol * (abs(points[0][0]) + tol):
            break
        centre = np.mean([x for _, x in points[:-1]], axis=0)
        worst = points[-1]
        for factor in (1.0,):
            x = centre + factor * (centre - worst[1])
            f = fn(x)
        if f < points[0][0]:
            x2 = centre + 2 * (centre - worst[1])
            f2 = fn(x2)
            points[-1] = (f2, x2) if f2 < f else (f, x)
        elif f < points[-2][0]:
            points[-1] = (f, x)
        else:
            x2 = centre + (0.5 if f < worst[0] else -0.5) * (centre - worst[1])
            f2 = fn(x2)
            if f2 < min(f, worst[0]):
                points[-1] = (f2, x2)
            else:
                points = [points[0]] + [(fn(y), y) for y in (points[0][1] + 0.5 * (x - points[0][1]) for _, x in points[1:])]
        points.sort(key=lambda p: p[0])
    return points[0][1], points[0][0]


def simplex_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 3000) -> np.ndarray:
    """Weights >= 0 with sum 1 that minimise |a w - b|."""
    return simplex_quadratic(a.T @ a, a.T @ b, rounds)


def simplex_quadratic(gram: np.ndarray, lin: np.ndarray, rounds: int = 3000) -> np.ndarray:
    """Weights >= 0 with sum 1 that minimise w'Gw / 2 - l'w: accelerated projection
    finds which are above 0, and the minimum is solved for exactly among them."""
    n = len(lin)
    rate = 1 / max(np.linalg.eigvalsh(gram)[-1], 1e-12)
    w = z = np.full(n, 1 / n)
    t = 1.0
    for _ in range(rounds):
        nxt = project_simplex(z - rate * (gram @ z - lin))
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z = nxt + (t - 1) / t2 * (nxt - w)
        near = np.abs(nxt - w).max() < 1e-12
        w, t = nxt, t2
        if near:
            break
    return _among_active(gram, lin, w)


def _among_active(gram: np.ndarray, lin: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Active sets from a point of the simplex: a step to the minimum over the weights
    above 0, cut where one reaches 0; another joins where that lowers the value."""
    n, small = len(w), 1e-10 * max(np.abs(gram).max(), 1e-300)
    on = w > 1e-9
    w = np.where(on, w, 0) / w[on].sum()
    for _ in range(20 * n + 20):
        top = int(np.argmax(w))
        rest = np.flatnonzero(on & (np.arange(n) != top))
        e = np.zeros((n, len(rest)))
        e[rest, np.arange(len(rest))], e[top] = 1.0, -1.0
        step = e @ np.linalg.lstsq(e.T @ gram @ e, e.T @ (lin - gram @ w), rcond=None)[0] if len(rest) else np.zeros(n)
        falls = np.flatnonzero(on & (w + step < 0))
        if len(falls):
            share = w[falls] / -step[falls]
            w = np.maximum(w + share.min() * step, 0)
            gone = falls[share.argmin()]
            on[gone], w[gone] = False, 0.0
            continue
        w = np.maximum(w + step, 0)
        gain = gram @ w - lin
        gain = np.where(on, np.inf, gain - gain[on].mean())
        if gain.min() >= -small:
            break
        on[gain.argmin()] = True
    return w / w.sum()


def project_simplex(v: np.ndarray) -> np.ndarray:
    u = np.sort(v)[::-1]
    total = np.cumsum(u) - 1
    k = np.flatnonzero(u - total / np.arange(1, len(u) + 1) > 0)[-1]
    return np.maximum(v - total[k] / (k + 1), 0)


def ridge(x: np.ndarray, y: np.ndarray, alpha: float = 1.0, intercept: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and intercept; the intercept is not penalised."""
    mx, my = (x.mean(axis=0), y.mean(axis=0)) if intercept else (np.zeros(x.shape[1]), 0.0)
    xc, yc = x - mx, y - my
    if x.shape[1] <= x.shape[0]:
        coef = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
    else:
        coef = xc.T @ np.linalg.solve(xc @ xc.T + alpha * np.eye(len(x)), yc)
    return coef, my - mx @ coef


class Ridge:
    """A linear estimator with fit and predict."""

    def __init__(self, alpha: float = 1e-6):
        self.alpha = alpha

    def fit(self, x, y):
        self.coef_, self.intercept_ = ridge(np.asarray(x, float), np.asarray(y, float), self.alpha)
        return self

    def predict(self, x):
        return np.asarray(x, float) @ self.coef_ + self.intercept_


def kmeans(x: np.ndarray, k: int, seed: int = 42, inits: int = 10, rounds: int = 100) -> np.ndarray:
    """Labels by Lloyd's algorithm with k-means++ starts, the best of several."""
    rng, best, labels = np.random.default_rng(seed), np.inf, np.zeros(len(x), int)
    for _ in range(inits):
        c = x[[rng.integers(len(x))]]
        while len(c) < k:
            d = ((x[:, None] - c[None]) ** 2).sum(-1).min(1)
            c = np.vstack([c, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))]])
        for _ in range(rounds):
            d = ((x[:, None] - c[None]) ** 2).sum(-1)
            near = d.argmin(1)
            new = np.array([x[near == j].mean(0) if (near == j).any() else x[d.min(1).argmax()] for j in range(k)])
            if np.allclose(new, c):
                break
            c = new
        cost = d.min(1).sum()
        if cost < best - 1e-12:
            best, labels = cost, near
    return labels


def random_walk_mh(logpost: Callable[[np.ndarray], float], start: np.ndarray, n_samples: int, burn_in: int, seed: int) -> np.ndarray:
    """Metropolis-Hastings with proposals that adapt during the burn-in."""
    rng = np.random.default_rng(seed)
    x, at = np.asarray(start, float), logpost(np.asarray(start, float))
    scale, out, taken = np.maximum(np.abs(x), 0.1) * 0.1, [], 0
    for i in range(n_samples + burn_in):
        y = x + scale * rng.standard_normal(len(x))
        new = logpost(y)
        if math.log(rng.random() + 1e-300) < new - at:
            x, at, taken = y, new, taken + 1
        if i < burn_in and i % 50 == 49:
            scale *= 1.2 if taken > 15 else 0.8
            taken = 0
        if i >= burn_in:
            out.append(x)
    return np.array(out)

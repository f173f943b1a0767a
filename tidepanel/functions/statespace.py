"""State-space filters, structural models, Gaussian processes and samplers."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from tidepanel.functions.stats import nelder_mead, normal_quantile, random_walk_mh


@dataclass
class KalmanResult:
    filtered_states: np.ndarray
    filtered_covs: np.ndarray
    predicted_states: np.ndarray
    predicted_covs: np.ndarray
    smoothed_states: np.ndarray | None
    smoothed_covs: np.ndarray | None
    log_likelihood: float


class KalmanFilter:
    """Linear Gaussian filter and smoother; NaN observations are not updated on."""

    def __init__(self, F, H, Q, R, x0=None, P0=None):
        self.F, self.H, self.Q, self.R = (np.atleast_2d(np.asarray(m, float)) for m in (F, H, Q, R))
        n = len(self.F)
        self.x0 = np.zeros(n) if x0 is None else np.asarray(x0, float)
        self.P0 = 1e6 * np.eye(n) if P0 is None else np.atleast_2d(np.asarray(P0, float))

    def step(self, x, p, y):
        """(predicted state, cov, updated state, cov, log density)."""
        xp, pp = self.F @ x, self.F @ p @ self.F.T + self.Q
        y = np.atleast_1d(y)
        if np.isnan(y).any():
            return xp, pp, xp, pp, 0.0
        e, s = y - self.H @ xp, self.H @ pp @ self.H.T + self.R
        gain = np.linalg.solve(s, self.H @ pp).T
        like = -0.5 * (len(y) * math.log(2 * math.pi) + np.linalg.slogdet(s)[1] + e @ np.linalg.solve(s, e))
        keep = np.eye(len(x)) - gain @ self.H
        return xp, pp, xp + gain @ e, keep @ pp @ keep.T + gain @ self.R @ gain.T, float(like)

    def filter(self, y) -> KalmanResult:
        x, p, total, rows = self.x0, self.P0, 0.0, []
        for v in np.asarray(y, float):
            xp, pp, x, p, like = self.step(x, p, v)
            total += like
            rows.append((x, p, xp, pp))
        a, b, c, d = (np.array(r) for r in zip(*rows)) if rows else (np.zeros((0, len(self.F))),) * 4
        return KalmanResult(a, b, c, d, None, None, total)

    def smooth(self, y) -> KalmanResult:
        r = self.filter(y)
        xs, ps = r.filtered_states.copy(), r.filtered_covs.copy()
        for t in range(len(xs) - 2, -1, -1):
            g = np.linalg.solve(r.predicted_covs[t + 1].T, self.F @ r.filtered_covs[t].T).T
            xs[t] = xs[t] + g @ (xs[t + 1] - r.predicted_states[t + 1])
            ps[t] = ps[t] + g @ (ps[t + 1] - r.predicted_covs[t + 1]) @ g.T
        r.smoothed_states, r.smoothed_covs = xs, ps
        return r


class UnscentedKalmanFilter:
    """Sigma points through user functions f and h."""

    def __init__(self, f: Callable, h: Callable, Q, R, x0, P0, alpha: float = 1e-3, beta: float = 2.0, kappa: float = 0.0):
        self.f, self.h, self.Q, self.R = f, h, np.atleast_2d(Q), np.atleast_2d(R)
        self.x0, self.P0 = np.asarray(x0, float), np.atleast_2d(np.asarray(P0, float))
        n = len(self.x0)
        lam = alpha**2 * (n + kappa) - n
        self.spread = n + lam
        self.wm = np.full(2 * n + 1, 0.5 / (n + lam))
        self.wc = self.wm.copy()
        self.wm[0], self.wc[0] = lam / (n + lam), lam / (n + lam) + 1 - alpha**2 + beta

    def _points(self, x, p):
        root = np.linalg.cholesky((p + p.T) / 2 * self.spread + 1e-9 * np.eye(len(x)))
        return np.vstack([x, x + root.T, x - root.T])

    def filter(self, y) -> KalmanResult:
        x, p, total, rows = self.x0, self.P0, 0.0, []
        for v in np.asarray(y, float):
            z = np.array([self.f(s) for s in self._points(x, p)])
            xp = self.wm @ z
            pp = (z - xp).T @ ((z - xp) * self.wc[:, None]) + self.Q
            x, p = xp, pp
            if not np.isnan(v).any():
                z = self._points(xp, pp)
                o = np.array([np.atleast_1d(self.h(s)) for s in z])
                mean = self.wm @ o
                s = (o - mean).T @ ((o - mean) * self.wc[:, None]) + self.R
                gain = ((z - xp).T @ ((o - mean) * self.wc[:, None])) @ np.linalg.inv(s)
                e = np.atleast_1d(v) - mean
                x, p = xp + gain @ e, pp - gain @ s @ gain.T
                total += float(-0.5 * (len(e) * math.log(2 * math.pi) + np.linalg.slogdet(s)[1] + e @ np.linalg.solve(s, e)))
            rows.append((x, p, xp, pp))
        a, b, c, d = (np.array(r) for r in zip(*rows))
        return KalmanResult(a, b, c, d, None, None, total)


class EnsembleKalmanFilter:
    """Stochastic ensemble filter with perturbed observations."""

    def __init__(self, f: Callable, h: Callable, Q, R, x0, P0, n_ensemble: int = 50, seed: int = 42):
        self.f, self.h, self.Q, self.R = f, h, np.atleast_2d(Q), np.atleast_2d(R)
        self.x0, self.P0, self.n, self.seed = np.asarray(x0, float), np.atleast_2d(np.asarray(P0, float)), n_ensemble, seed

    def filter(self, y) -> KalmanResult:
        rng = np.random.default_rng(self.seed)
        e = rng.multivariate_normal(self.x0, self.P0, self.n)
        rows = []
        for v in np.asarray(y, float):
            e = np.array([self.f(s) for s in e]) + rng.multivariate_normal(np.zeros(len(self.Q)), self.Q, self.n)
            xp, pp = e.mean(0), np.atleast_2d(np.cov(e.T))
            if not np.isnan(v).any():
                o = np.array([np.atleast_1d(self.h(s)) for s in e])
                de, do = e - e.mean(0), o - o.mean(0)
                gain = (de.T @ do / (self.n - 1)) @ np.linalg.inv(do.T @ do / (self.n - 1) + self.R)
                noisy = np.atleast_1d(v) + rng.multivariate_normal(np.zeros(len(self.R)), self.R, self.n)
                e = e + (noisy - o) @ gain.T
            rows.append((e.mean(0), np.atleast_2d(np.cov(e.T)), xp, pp))
        a, b, c, d = (np.array(r) for r in zip(*rows))
        return KalmanResult(a, b, c, d, None, None, float("nan"))


class BSTS:
    """Level or local linear trend with seasonal dummies, as a Kalman model."""

    def __init__(self, trend: str = "local_linear", seasonal: int | None = None, sigma_obs: float = 1.0, sigma_level: float = 0.1, sigma_trend: float = 0.01, sigma_seasonal: float = 0.01):
        trend = "local_level" if trend == "level" else trend
        if trend not in ("local_level", "local_linear"):
            raise ValueError(f"unknown trend {trend!r}")
        n = 1 if trend == "local_level" else 2
        m = (seasonal - 1) if seasonal else 0
        f, q, h = np.zeros((n + m, n + m)), np.zeros((n + m, n + m)), np.zeros((1, n + m))
        f[0, 0], h[0, 0], q[0, 0] = 1, 1, sigma_level**2
        if n == 2:
            f[0, 1] = f[1, 1] = 1
            q[1, 1] = sigma_trend**2
        if m:
            f[n, n:] = -1
            f[n + 1 :, n : n + m - 1] = np.eye(m - 1)
            h[0, n], q[n, n] = 1, sigma_seasonal**2
        self.n, self.m = n, m
        self.kf = KalmanFilter(f, h, q, [[sigma_obs**2]])

    def fit(self, y) -> BSTS:
        self.result = self.kf.smooth(np.asarray(y, float))
        s = self.result.smoothed_states
        self.level, self.trend = s[:, 0], s[:, 1] if self.n == 2 else np.zeros(len(s))
        self.seasonal = s[:, self.n] if self.m else np.zeros(len(s))
        return self

    def forecast(self, h: int) -> tuple[np.ndarray, np.ndarray]:
        x, p = self.result.filtered_states[-1], self.result.filtered_covs[-1]
        mean, var = [], []
        for _ in range(h):
            x, p = self.kf.F @ x, self.kf.F @ p @ self.kf.F.T + self.kf.Q
            mean.append(float((self.kf.H @ x)[0]))
            var.append(float((self.kf.H @ p @ self.kf.H.T + self.kf.R)[0, 0]))
        return np.array(mean), np.array(var)


# -- particles -------------------------------------------------------------


def local_level_transition(sigma_level: float = 1.0):
    return lambda x, rng: x + rng.normal(0, sigma_level, x.shape)


def local_level_loglik(sigma_obs: float = 1.0):
    return lambda y, x: -0.5 * math.log(2 * math.pi * sigma_obs**2) - 0.5 * ((y - x) / sigma_obs) ** 2


def ar1_transition(phi: float = 0.9, sigma: float = 1.0, mu: float = 0.0):
    return lambda x, rng: mu + phi * (x - mu) + rng.normal(0, sigma, x.shape)


def stochastic_volatility_transition(phi: float = 0.95, sigma_v: float = 0.2, mu: float = 0.0):
    return ar1_transition(phi, sigma_v, mu)


def stochastic_volatility_loglik():
    return lambda y, x: -0.5 * (math.log(2 * math.pi) + x + y**2 * np.exp(-x))


def local_level_density(sigma_level: float = 1.0):
    """Logarithm of the density of the next state, for the smoother; up to a constant."""
    return lambda after, x: -0.5 * ((after - x) / sigma_level) ** 2


def ar1_density(phi: float = 0.9, sigma: float = 1.0, mu: float = 0.0):
    return lambda after, x: -0.5 * ((after - mu - phi * (x - mu)) / sigma) ** 2


@dataclass
class ParticleFilterResult:
    """With a stored history, (times, particles): ``particles_history`` before a
    resampling and its ``weights_history``, and ``ancestors``: row t holds, for every
    particle moved on from time t, the place at t that it was copied from."""

    filtered_mean: np.ndarray
    filtered_var: np.ndarray
    ess: np.ndarray
    log_likelihood: float
    particles_history: np.ndarray | None = None
    weights_history: np.ndarray | None = None
    ancestors: np.ndarray | None = None

    def genealogies(self) -> np.ndarray:
        """(times, particles): the path that led to each last particle, read
        backwards through the ancestors."""
        if self.ancestors is None:
            raise ValueError("the filter ran without store_history")
        out = self.particles_history.copy()
        place = np.arange(out.shape[1])
        for t in range(len(out) - 2, -1, -1):
            place = self.ancestors[t][place]
            out[t] = self.particles_history[t][place]
        return out

    def smoothed_paths(self, density, paths: int = 200, seed: int = 42) -> np.ndarray:
        """(times, paths): draws from the smoothing distribution by backward
        simulation. ``density(after, x)`` is the logarithm of the transition density."""
        if self.particles_history is None:
            raise ValueError("the filter ran without store_history")
        rng, x, w = np.random.default_rng(seed), self.particles_history, self.weights_history
        out = np.empty((len(x), paths))
        for t in range(len(x) - 1, -1, -1):
            lw = np.log(w[t] + 1e-300)[None, :]
            lw = np.broadcast_to(lw, (paths, x.shape[1])) if t == len(x) - 1 else lw + density(out[t + 1][:, None], x[t][None, :])
            total = np.cumsum(np.exp(lw - lw.max(axis=1, keepdims=True)), axis=1)
            u = rng.random(paths) * total[:, -1]
            out[t] = x[t][np.minimum((total < u[:, None]).sum(axis=1), x.shape[1] - 1)]
        return out


class ParticleFilter:
    """Bootstrap filter; weights carry over until a resampling."""

    def __init__(self, n_particles: int = 1000, transition_fn=None, observation_loglik=None, resample_method: str = "systematic", resample_threshold: float = 0.5, seed: int = 42, store_history: bool = False):
        if n_particles < 2 or not 0 < resample_threshold <= 1 or resample_method not in ("systematic", "multinomial"):
            raise ValueError("two particles, a resample_threshold in (0, 1] and a systematic or multinomial resample_method are needed")
        self.n, self.transition, self.loglik = n_particles, transition_fn or local_level_transition(), observation_loglik or local_level_loglik()
        self.method, self.threshold, self.seed, self.store_history = resample_method, resample_threshold, seed, store_history

    def filter(self, y, initial_particles: np.ndarray | None = None) -> ParticleFilterResult:
        rng, y = np.random.default_rng(self.seed), np.asarray(y, float)
        known = y[~np.isnan(y)]
        x = rng.normal(known[0] if len(known) else 0.0, 1.0, self.n) if initial_particles is None else np.asarray(initial_particles, float).copy()
        w, total, rows = np.full(self.n, 1 / self.n), 0.0, []
        kept = (np.empty((len(y), self.n)), np.empty((len(y), self.n)), np.empty((len(y), self.n), int)) if self.store_history else None
        for t, v in enumerate(y):
            x = self.transition(x, rng)
            if not np.isnan(v):
                lw = np.log(w + 1e-300) + self.loglik(v, x)
                top = lw.max()
                w = np.exp(lw - top)
                total += float(top + math.log(w.sum()))
                w /= w.sum()
            mean = float(w @ x)
            ess = 1 / float(w @ w)
            rows.append((mean, float(w @ (x - mean) ** 2), ess))
            place = None
            if ess < self.threshold * self.n:
                u = (rng.random() + np.arange(self.n)) / self.n if self.method == "systematic" else np.sort(rng.random(self.n))
                place = np.minimum(np.searchsorted(np.cumsum(w), u), self.n - 1)
            if kept is not None:
                kept[0][t], kept[1][t], kept[2][t] = x, w, np.arange(self.n) if place is None else place
            if place is not None:
                x, w = x[place], np.full(self.n, 1 / self.n)
        a, b, c = (np.array(r) for r in zip(*rows)) if rows else (np.zeros(0),) * 3
        return ParticleFilterResult(a, b, c, total, *(kept or ()))


# -- Gaussian processes ----------------------------------------------------


class Kernel:
    """Parameters are positive and optimised on the log scale."""

    names: tuple[str, ...] = ()

    def __init__(self, **params: float):
        self.params = np.array([params.get(n, 1.0) for n in self.names], float)

    def n_params(self) -> int:
        return len(self.params)

    def get_params(self) -> np.ndarray:
        return np.log(self.params)

    def set_params(self, logs) -> None:
        self.params = np.exp(np.clip(np.asarray(logs, float), -20, 20))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.value(np.abs(a[:, None] - b[None]))

    def __add__(self, other: Kernel) -> Kernel:
        return SumKernel(self, other)

    def __mul__(self, other: Kernel) -> Kernel:
        return ProductKernel(self, other)


class RBFKernel(Kernel):
    names = ("variance", "lengthscale")

    def value(self, r):
        return self.params[0] * np.exp(-0.5 * (r / self.params[1]) ** 2)


class Matern32Kernel(RBFKernel):
    def value(self, r):
        z = math.sqrt(3) * r / self.params[1]
        return self.params[0] * (1 + z) * np.exp(-z)


class Matern52Kernel(RBFKernel):
    def value(self, r):
        z = math.sqrt(5) * r / self.params[1]
        return self.params[0] * (1 + z + z * z / 3) * np.exp(-z)


class PeriodicKernel(Kernel):
    names = ("variance", "lengthscale", "period")

    def value(self, r):
        return self.params[0] * np.exp(-2 * (np.sin(np.pi * r / self.params[2]) / self.params[1]) ** 2)


class SpectralMixtureKernel(Kernel):
    def __init__(self, n_mixtures: int = 3):
        self.n = n_mixtures
        self.params = np.concatenate([np.full(n_mixtures, 1 / n_mixtures), np.linspace(0.05, 0.5, n_mixtures), np.full(n_mixtures, 0.1)])

    def value(self, r):
        w, mu, s = np.split(self.params, 3)
        return sum(a * np.exp(-2 * (np.pi * r * c) ** 2) * np.cos(2 * np.pi * r * b) for a, b, c in zip(w, mu, s))


class SumKernel(Kernel):
    join = staticmethod(np.add)

    def __init__(self, k1: Kernel, k2: Kernel):
        self.k1, self.k2 = k1, k2

    def n_params(self):
        return self.k1.n_params() + self.k2.n_params()

    def get_params(self):
        return np.concatenate([self.k1.get_params(), self.k2.get_params()])

    def set_params(self, logs):
        self.k1.set_params(logs[: self.k1.n_params()])
        self.k2.set_params(logs[self.k1.n_params() :])

    def __call__(self, a, b):
        return self.join(self.k1(a, b), self.k2(a, b))


class ProductKernel(SumKernel):
    join = staticmethod(np.multiply)


KERNELS = {"rbf": RBFKernel, "matern32": Matern32Kernel, "matern52": Matern52Kernel, "periodic": PeriodicKernel, "spectral_mixture": SpectralMixtureKernel}


def make_kernel(name: str, **params) -> Kernel:
    if name not in KERNELS:
        raise ValueError(f"unknown kernel {name!r}; one of {sorted(KERNELS)}")
    return KERNELS[name](**params)


class GaussianProcess:
    """On the index 0, 1, ... of a standardised series."""

    def __init__(self, kernel: str | Kernel = "rbf", optimize: bool = True, noise_var: float = 0.1):
        self.kernel = make_kernel(kernel) if isinstance(kernel, str) else kernel
        self.optimize, self.noise = optimize, noise_var

    def fit(self, y) -> GaussianProcess:
        y = np.asarray(y, float)
        self.mean, self.scale = y.mean(), y.std() or 1.0
        self.x, z = np.arange(len(y)) / max(len(y) - 1, 1) * 10, (y - y.mean()) / (y.std() or 1.0)

        def loss(p):
            self.kernel.set_params(p[:-1])
            try:
                low = np.linalg.cholesky(self.kernel(self.x, self.x) + (np.exp(p[-1]) + 1e-8) * np.eye(len(z)))
            except np.linalg.LinAlgError:
                return 1e10
            a = np.linalg.solve(low, z)
            return float(0.5 * a @ a + np.log(np.diag(low)).sum() + 0.01 * (p @ p))

        p = np.append(self.kernel.get_params(), math.log(self.noise))
        if self.optimize:
            p, _ = nelder_mead(loss, p, max_iter=25, step=0.5)
        self.kernel.set_params(p[:-1])
        self.noise = float(np.exp(p[-1]))
        self.low = np.linalg.cholesky(self.kernel(self.x, self.x) + (self.noise + 1e-8) * np.eye(len(z)))
        self.alpha = np.linalg.solve(self.low.T, np.linalg.solve(self.low, z))
        self.step = 10 / max(len(y) - 1, 1)
        return self

    def predict(self, h: int) -> tuple[np.ndarray, np.ndarray]:
        new = self.x[-1] + self.step * np.arange(1, h + 1)
        k = self.kernel(new, self.x)
        v = np.linalg.solve(self.low, k.T)
        var = np.diag(self.kernel(new, new)) - (v * v).sum(0)
        return self.mean + self.scale * (k @ self.alpha), self.scale * np.sqrt(np.maximum(var, 0))


# -- MCMC ------------------------------------------------------------------


@dataclass
class MCMCResult:
    samples: np.ndarray
    paths: np.ndarray
    point_forecast: np.ndarray
    lower: np.ndarray
    upper: np.ndarray


def mcmc_series(v: np.ndarray, h: int, model: str = "local_level", p: int = 1, season_length: int = 12, coverage: float = 0.9, n_samples: int = 1000, burn_in: int = 500, seed: int = 42) -> MCMCResult:
    """Posterior paths of a local level, an autoregression or a seasonal level."""
    rng, mean, std = np.random.default_rng(seed + 1), v.mean(), v.std() or 1.0
    z = (v - mean) / std
    if model == "ar":
        x = np.column_stack([np.ones(len(z) - p), *[z[p - k : len(z) - k] for k in range(1, p + 1)]])

        def post(b):
            e = z[p:] - x @ b[:-1]
            return float(-len(e) * b[-1] - 0.5 * np.exp(-2 * b[-1]) * (e @ e) - 0.5 * (b @ b) / 9)

        s = random_walk_mh(post, np.zeros(p + 2), n_samples, burn_in, seed)
        paths = []
        for b in s:
            path = list(z[-p:])
            for _ in range(h):
                path.append(b[0] + sum(c * path[-k] for k, c in enumerate(b[1:-1], 1)) + rng.normal(0, np.exp(b[-1])))
            paths.append(path[p:])
    elif model in ("local_level", "seasonal"):
        season = np.zeros(max(season_length, 1))
        if model == "seasonal" and len(z) >= 2 * season_length:
            season = np.array([z[k::season_length].mean() for k in range(season_length)])
            season -= season.mean()
        bare = z - season[np.arange(len(z)) % len(season)]

        def post(b):
            return KalmanFilter([[1.0]], [[1.0]], [[np.exp(2 * b[0])]], [[np.exp(2 * b[1])]], [bare[0]], [[1.0]]).filter(bare).log_likelihood - 0.5 * (b @ b) / 9

        s = random_walk_mh(post, np.array([-1.0, -0.5]), n_samples, burn_in, seed)
        paths, known = [], {}
        for b in s:
            key = tuple(b)
            if key not in known:
                r = KalmanFilter([[1.0]], [[1.0]], [[np.exp(2 * b[0])]], [[np.exp(2 * b[1])]], [bare[0]], [[1.0]]).filter(bare)
                known[key] = (r.filtered_states[-1, 0], r.filtered_covs[-1, 0, 0])
            m, c = known[key]
            level = m + math.sqrt(max(c, 0)) * rng.normal() + np.cumsum(rng.normal(0, np.exp(b[0]), h))
            paths.append(level + rng.normal(0, np.exp(b[1]), h) + season[(len(z) + np.arange(h)) % len(season)])
    else:
        raise ValueError(f"unknown model {model!r}")
    paths = np.array(paths) * std + mean
    half = (1 - coverage) / 2
    return MCMCResult(s, paths, np.median(paths, 0), np.quantile(paths, half, 0), np.quantile(paths, 1 - half, 0))


@dataclass
class ETSPriors:
    """Beta priors of the rates, normal of the states, inverse gamma of the noise."""

    alpha_a: float = 2.0
    alpha_b: float = 2.0
    beta_a: float = 2.0
    beta_b: float = 5.0
    gamma_a: float = 2.0
    gamma_b: float = 5.0
    sigma_shape: float = 2.0
    sigma_scale: float = 1.0


@dataclass
class BayesianETSResult:
    map_params: dict = field(default_factory=dict)
    posterior_samples: np.ndarray | None = None


def bayesian_ets_series(v: np.ndarray, h: int, model: str = "ses", inference: str = "map", season_length: int = 1, priors: ETSPriors | None = None, coverage: float = 0.9, n_samples: int = 500, burn_in: int = 250, seed: int = 42) -> dict:
    from tidepanel.operators.forecasting import _smooth_run

    pr, kind = priors or ETSPriors(), {"ses": "ses", "holt": "holt", "holt_winters": "hw"}[model]
    n, scale = {"ses": 1, "holt": 2, "hw": 3}[kind], v.std() or 1.0
    ab = np.array([(pr.alpha_a, pr.alpha_b), (pr.beta_a, pr.beta_b), (pr.gamma_a, pr.gamma_b)])[:n]
    rate = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def post(x):
        r, s = rate(x[:n]), np.exp(np.clip(x[n], -20, 20))
        e = _smooth_run(v, r, kind, season_length, 0)[1] / scale
        like = -len(e) * np.log(s) - 0.5 * (e @ e) / s**2
        return float(like + (ab[:, 0] * np.log(r + 1e-12) + ab[:, 1] * np.log(1 - r + 1e-12)).sum() - 2 * pr.sigma_shape * np.log(s) - pr.sigma_scale / s**2)

    best, _ = nelder_mead(lambda x: -post(x), np.append(np.full(n, -1.0), 0.0), max_iter=80, step=0.5)
    ahead = _smooth_run(v, rate(best[:n]), kind, season_length, h)[0]
    width = normal_quantile(0.5 + coverage / 2) * np.exp(best[n]) * scale * np.sqrt(np.arange(1, h + 1))
    low, high = ahead - width, ahead + width
    if inference == "mcmc":
        rng = np.random.default_rng(seed)
        s = random_walk_mh(post, best, n_samples, burn_in, seed)
        paths = np.array([_smooth_run(v, rate(x[:n]), kind, season_length, h)[0] + np.cumsum(rng.normal(0, np.exp(x[n]) * scale, h)) for x in s])
        half = (1 - coverage) / 2
        ahead, low, high = np.median(paths, 0), np.quantile(paths, half, 0), np.quantile(paths, 1 - half, 0)
    return {"y_hat": ahead, "y_hat_lower": low, "y_hat_upper": high}


# -- Bayesian VAR ----------------------------------------------------------


@dataclass
class MinnesotaPrior:
    lambda1: float = 0.2
    lambda2: float = 0.5
    lambda3: float = 1.0


@dataclass
class NormalWishartPrior:
    tightness: float = 10.0
    nu0: float | None = None


class BayesianVAR:
    """Minnesota or normal-Wishart prior; moments X'X, X'Y are all it needs."""

    def __init__(self, target_cols: list[str], p: int = 1, prior: str = "minnesota", inference: str = "analytical", minnesota_prior: MinnesotaPrior | None = None, nw_prior: NormalWishartPrior | None = None, coverage: float = 0.9, n_samples: int = 1000, burn_in: int = 500, seed: int = 42):
        if prior not in ("minnesota", "normal_wishart"):
            raise ValueError(f"unknown prior {prior!r}")
        self.target_cols, self.p, self.prior, self.inference = target_cols, p, prior, inference
        self.mn, self.nw = minnesota_prior or MinnesotaPrior(), nw_prior or NormalWishartPrior()
        self.coverage, self.n_samples, self.burn_in, self.seed = coverage, n_samples, burn_in, seed

    def fit_moments(self, xx, xy, yy, n: int, last: np.ndarray) -> BayesianVAR:
        k, p = len(self.target_cols), self.p
        size = k * p + 1
        ols = np.linalg.lstsq(xx, xy, rcond=None)[0]
        s = np.diag((yy - ols.T @ xy) / max(n - size, 1)).clip(1e-10)
        b0 = np.zeros((size, k))
        b0[:k] = np.eye(k)
        post, chol = np.zeros((size, k)), []
        for j in range(k):
            v = np.full(size, 1e6)
            for lag in range(1, p + 1):
                for i in range(k):
                    own = self.mn.lambda1 / lag**self.mn.lambda3
                    v[(lag - 1) * k + i] = own**2 if i == j else (own * self.mn.lambda2) ** 2 * s[j] / s[i]
            if self.prior == "normal_wishart":
                v = np.full(size, self.nw.tightness)
            prec = np.diag(s[j] / v) if self.prior == "minnesota" else np.diag(1 / v)
            a = xx + prec
            post[:, j] = np.linalg.solve(a, xy[:, j] + prec @ b0[:, j])
            chol.append(np.linalg.cholesky(np.linalg.inv(a) * s[j] + 1e-14 * np.eye(size)))
        e = yy - post.T @ xy - xy.T @ post + post.T @ xx @ post
        self.B_post, self.Sigma_post = post, (e + 1e-9 * np.eye(k)) / max(n - 1, 1)
        self.chol, self.nu, self.last = chol, max(n, k + 2), np.asarray(last, float)
        return self

    def _sigma(self, rng) -> np.ndarray:
        """An inverse-Wishart draw by Bartlett's decomposition."""
        k = len(self.Sigma_post)
        low = np.linalg.cholesky(np.linalg.inv(self.Sigma_post * self.nu))
        a = np.tril(rng.normal(size=(k, k)), -1) + np.diag(np.sqrt(rng.chisquare(self.nu - np.arange(k))))
        return np.linalg.inv(low @ a @ a.T @ low.T)

    def predict(self, horizon: int) -> dict[str, np.ndarray]:
        rng, k, paths = np.random.default_rng(self.seed), len(self.target_cols), []
        for _ in range(self.n_samples):
            b = self.B_post + np.column_stack([c @ rng.normal(size=len(c)) for c in self.chol])
            low = np.linalg.cholesky(self._sigma(rng) if self.inference != "analytical" else self.Sigma_post)
            values = list(self.last)
            for _ in range(horizon):
                x = np.concatenate([*[values[-i] for i in range(1, self.p + 1)], [1.0]])
                values.append(np.clip(x @ b + low @ rng.normal(size=k), -1e12, 1e12))
            paths.append(values[-horizon:])
        paths, half = np.array(paths), (1 - self.coverage) / 2
        return {"mean": np.median(paths, 0), "lower": np.quantile(paths, half, 0), "upper": np.quantile(paths, 1 - half, 0)}

    def irf(self, horizon: int = 10) -> np.ndarray:
        """Responses (step, variable, shock) to one standard deviation."""
        k, p = len(self.target_cols), self.p
        comp = np.zeros((k * p, k * p))
        comp[:k] = self.B_post[:-1].T
        comp[k:, :-k] = np.eye(k * (p - 1))
        low, power, out = np.linalg.cholesky(self.Sigma_post), np.eye(k * p), []
        for _ in range(horizon + 1):
            out.append(power[:k, :k] @ low)
            power = comp @ power
        return np.array(out)

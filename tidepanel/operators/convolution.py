"""Random and fixed convolution kernels as features of series."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.panel import ID, TIME, Y, as_series


def _windows(x: np.ndarray, taps: int, dilation: int) -> np.ndarray | None:
    span = (taps - 1) * dilation + 1
    if x.shape[1] < span:
        return None
    return np.lib.stride_tricks.sliding_window_view(x, span, axis=1)[:, :, ::dilation]


def _padded(series: list[np.ndarray], width: int) -> np.ndarray:
    return np.array([np.pad(s[:width], (0, max(0, width - len(s)))) for s in series]) if series else np.zeros((0, width))


class Rocket:
    """Random kernels (7, 9 or 11 centred normal taps, exponential dilation,
    uniform bias): share of positive values and maximum of each; kernels longer
    than the series give 0 and 0."""

    def __init__(self, n_kernels: int = 500, seed: int = 42):
        self.n_kernels, self.seed = n_kernels, seed

    def fit(self, series: list[np.ndarray], width: int | None = None) -> Rocket:
        rng = np.random.default_rng(self.seed)
        self.width = width or max(map(len, series))
        self.kernels = []
        for _ in range(self.n_kernels):
            n = int(rng.choice([7, 9, 11]))
            w = rng.normal(0, 1, n)
            w -= w.mean()
            most = max(0.0, np.log2(max((self.width - 1) / (n - 1), 1)))
            self.kernels.append((w, int(2 ** rng.uniform(0, most)), float(rng.uniform(-1, 1))))
        return self

    def transform(self, series: list[np.ndarray]) -> np.ndarray:
        x = _padded(series, self.width)
        out = np.zeros((len(x), 2 * self.n_kernels))
        for k, (w, dilation, bias) in enumerate(self.kernels):
            view = _windows(x, len(w), dilation)
            if view is not None:
                y = view @ w + bias
                out[:, 2 * k], out[:, 2 * k + 1] = (y > 0).mean(1), y.max(1)
        return out


class MiniRocket:
    """The 84 fixed kernels of nine taps (three of +2, six of -1) with log-spaced
    dilations; biases are quantiles of the output on training series."""

    def __init__(self, n_kernels: int = 500, seed: int = 42):
        self.n_kernels, self.seed = n_kernels, seed

    def fit(self, series: list[np.ndarray], width: int | None = None) -> MiniRocket:
        rng = np.random.default_rng(self.seed)
        self.width = width or max(map(len, series))
        x = _padded(series, self.width)
        patterns = [np.array([2.0 if i in c else -1.0 for i in range(9)]) for c in combinations(range(9), 3)]
        most = max(0.0, np.log2(max((self.width - 1) / 8, 1)))
        steps = max(1, -(-self.n_kernels // len(patterns)))
        dilations = [int(2**e) for e in np.linspace(0, most, steps)]
        self.kernels = []
        for k in range(self.n_kernels):
            w, dilation = patterns[k % len(patterns)], dilations[k // len(patterns)]
            view = _windows(x[[int(rng.integers(len(x)))]], 9, dilation)
            bias = float(np.quantile(view @ w, rng.uniform())) if view is not None else 0.0
            self.kernels.append((w, dilation, bias))
        return self

    def transform(self, series: list[np.ndarray]) -> np.ndarray:
        x = _padded(series, self.width)
        out = np.zeros((len(x), self.n_kernels))
        for k, (w, dilation, bias) in enumerate(self.kernels):
            view = _windows(x, 9, dilation)
            if view is not None:
                out[:, k] = (view @ w > bias).mean(1)
        return out


def _features(df: DataFrame, kind, prefix: str, n_kernels: int, target_col: str, id_col: str, time_col: str, seed: int, as_array: bool) -> DataFrame:
    s = as_series(df, target_col, id_col, time_col) if "series" not in df.columns else df.select(id_col, "series")
    width = s.agg(F.max(F.size("series"))).first()[0] or 1
    # Biases of the fixed kernels come from a bounded hash sample of series.
    sample = [np.array(r[0], float) for r in s.select("series").orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(256).collect()]
    kernels = kind(n_kernels, seed).fit(sample or [np.zeros(width)], width)

    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(list(kernels.transform([np.asarray(x, float) for x in v])))

    rows = s.select(id_col, run("series").alias(prefix))
    if as_array:
        return rows
    n = n_kernels * (2 if kind is Rocket else 1)
    return rows.select(id_col, *[F.get(prefix, F.lit(i)).alias(f"{prefix}_{i}") for i in range(n)])


def rocket_features(df: DataFrame, n_kernels: int = 500, target_col: str = Y, id_col: str = ID, time_col: str = TIME, seed: int = 42, as_array: bool = False) -> DataFrame:
    """``rocket_0`` ... : share of positive values and maximum, kernel by kernel."""
    return _features(df, Rocket, "rocket", n_kernels, target_col, id_col, time_col, seed, as_array)


def minirocket_features(df: DataFrame, n_kernels: int = 500, target_col: str = Y, id_col: str = ID, time_col: str = TIME, seed: int = 42, as_array: bool = False) -> DataFrame:
    return _features(df, MiniRocket, "minirocket", n_kernels, target_col, id_col, time_col, seed, as_array)

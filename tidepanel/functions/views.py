"""Augmented views of series and losses on embeddings, in numpy."""

from __future__ import annotations

import numpy as np


def jitter(x, sigma: float = 0.1, seed: int = 0) -> np.ndarray:
    """Gaussian noise added to every value."""
    x = np.asarray(x, float)
    return x + np.random.default_rng(seed).normal(0, sigma, x.shape)


def scaling(x, sigma: float = 0.1, seed: int = 0) -> np.ndarray:
    """A random factor near 1 for every series."""
    x = np.asarray(x, float)
    return x * np.random.default_rng(seed).normal(1, sigma, (len(x), *[1] * (x.ndim - 1)))


def window_crop(x, crop_ratio: float = 0.5, seed: int = 0) -> np.ndarray:
    """The same random stretch of every series, drawn out to the old length."""
    x = np.asarray(x, float)
    n = x.shape[-1]
    size = max(2, int(n * crop_ratio))
    at = int(np.random.default_rng(seed).integers(n - size + 1))
    grid = np.linspace(0, size - 1, n)
    return np.apply_along_axis(lambda v: np.interp(grid, np.arange(size), v[at : at + size]), -1, x)


def augment_pair(x, jitter_sigma: float = 0.1, scale_sigma: float = 0.1, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Two views: one with noise, one scaled."""
    return jitter(x, jitter_sigma, seed), scaling(x, scale_sigma, seed + 1)


def nt_xent_loss(a, b, temperature: float = 0.5) -> float:
    """Normalised temperature-scaled cross entropy of paired embeddings."""
    z = np.concatenate([np.asarray(a, float), np.asarray(b, float)])
    z = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    s = z @ z.T / temperature
    np.fill_diagonal(s, -np.inf)
    n = len(z) // 2
    top = s.max(axis=1, keepdims=True)
    total = np.log(np.exp(s - top).sum(axis=1)) + top[:, 0]
    return float((total - s[np.arange(2 * n), np.r_[np.arange(n, 2 * n), np.arange(n)]]).mean())


def target_distribution(q) -> np.ndarray:
    """Soft assignments sharpened: q squared over its column sums, normalised."""
    q = np.asarray(q, float)
    w = q**2 / q.sum(axis=0)
    return w / w.sum(axis=1, keepdims=True)

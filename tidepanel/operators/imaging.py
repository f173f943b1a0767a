"""Images, spectra and signatures of series, as array columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.panel import ID, TIME, Y, as_series, ensure, type_of


def _series(df: DataFrame, target_col: str, id_col: str, time_col: str) -> DataFrame:
    return df.select(id_col, "series") if "series" in df.columns else as_series(df, target_col, id_col, time_col)


def _paa(size: int | None):
    """Piecewise means over ``size`` pieces, in the JVM."""
    s = F.col("series")
    if size is None:
        return s
    n = F.size(s)
    piece = lambda i: F.slice(s, F.floor(i * n / size).cast("int") + 1, F.greatest(F.floor((i + 1) * n / size).cast("int") - F.floor(i * n / size).cast("int"), F.lit(1)))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(a)
    return F.when(n <= size, s).otherwise(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: mean(piece(i))))


def _angular(df: DataFrame, image_size, target_col, id_col, time_col, name: str, cell) -> DataFrame:
    s = _series(df, target_col, id_col, time_col).withColumn("series", _paa(image_size))
    low, high = F.array_min("series"), F.array_max("series")
    unit = F.transform("series", lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((x - low) * 2, high - low) - 1, F.lit(0.0)))))
    s = s.select(id_col, F.transform(unit, lambda x: F.acos(x)).alias("__phi"))
    return s.select(id_col, F.transform("__phi", lambda a: F.transform("__phi", lambda b: cell(a, b))).alias(name))


def to_gasf(df: DataFrame, image_size: int | None = None, id_col: str = ID, target_col: str = Y, time_col: str = TIME) -> DataFrame:
    """cos(phi_i + phi_j) of the series scaled to [-1, 1]."""
    return _angular(df, image_size, target_col, id_col, time_col, "gasf", lambda a, b: F.cos(a + b))


def to_gadf(df: DataFrame, image_size: int | None = None, id_col: str = ID, target_col: str = Y, time_col: str = TIME) -> DataFrame:
    return _angular(df, image_size, target_col, id_col, time_col, "gadf", lambda a, b: F.sin(a - b))


def to_recurrence_plot(df: DataFrame, threshold: float | None = 0.1, normalize: bool = True, id_col: str = ID, target_col: str = Y, time_col: str = TIME) -> DataFrame:
    s = _series(df, target_col, id_col, time_col)
    if normalize:
        n = F.size("series")
        mean = F.aggregate("series", F.lit(0.0), lambda a, b: a + b) / n
        s = s.withColumn("series", F.transform("series", lambda x: x - mean))
        std = F.sqrt(F.aggregate("series", F.lit(0.0), lambda a, b: a + b * b) / n)
        s = s.withColumn("series", F.transform("series", lambda x: F.coalesce(F.try_divide(x, std), F.lit(0.0))))
    cell = (lambda a, b: F.abs(a - b)) if threshold is None else (lambda a, b: (F.abs(a - b) <= threshold).cast("double"))
    return s.select(id_col, F.transform("series", lambda a: F.transform("series", lambda b: cell(a, b))).alias("recurrence"))


_NESTED = "array<array<double>>"


def _kernel(df: DataFrame, fn, name: str, target_col: str, id_col: str, time_col: str, kind: str = _NESTED) -> DataFrame:
    @F.pandas_udf(kind)
    def run(v: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(fn(np.asarray(s, float))).tolist() for s in v])

    return _series(df, target_col, id_col, time_col).select(id_col, run("series").alias(name))


def to_mtf(df: DataFrame, n_bins: int = 8, image_size: int | None = None, id_col: str = ID, target_col: str = Y, time_col: str = TIME) -> DataFrame:
    """Transition frequencies between quantile bins, spread over all pairs of times."""

    def field(v):
        edges = np.quantile(v, np.linspace(0, 1, n_bins + 1)[1:-1])
        b = np.searchsorted(edges, v, "right")
        m = np.zeros((n_bins, n_bins))
        np.add.at(m, (b[:-1], b[1:]), 1)
        m /= np.maximum(m.sum(1, keepdims=True), 1)
        out = m[b[:, None], b[None]]
        if image_size and image_size < len(v):
            cut = np.floor(np.arange(image_size + 1) * len(v) / image_size).astype(int)
            out = np.add.reduceat(np.add.reduceat(out, cut[:-1], 0), cut[:-1], 1) / np.outer(np.diff(cut), np.diff(cut))
        return out

    return _kernel(df, field, "mtf", target_col, id_col, time_col)


def _runs(line: np.ndarray, least: int) -> list[int]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], line, [0]])))
    return [n for n in (edge[1::2] - edge[::2]).tolist() if n >= least]


def rqa(r: np.ndarray, l_min: int = 2) -> dict[str, float]:
    r = (r > 0).astype(int)
    n = len(r)
    diagonals = [x for k in range(1, n) for x in _runs(np.diagonal(r, k), l_min)]
    verticals = [x for j in range(n) for x in _runs(r[:, j], l_min)]
    upper, total = np.triu(r, 1).sum(), r.sum()
    p = np.bincount(diagonals)[1:] / len(diagonals) if diagonals else np.zeros(0)
    p = p[p > 0]
    return {"recurrence_rate": float(total / max(n * n, 1)), "determinism": float(sum(diagonals) / upper) if upper else 0.0, "laminarity": float(sum(verticals) / total) if total else 0.0,
            "mean_diagonal": float(np.mean(diagonals)) if diagonals else 0.0, "mean_vertical": float(np.mean(verticals)) if verticals else 0.0, "entropy": float(-(p * np.log(p)).sum())}


def rqa_features(plots: DataFrame, l_min: int = 2, id_col: str = ID, column: str = "recurrence") -> DataFrame:
    names = ["recurrence_rate", "determinism", "laminarity", "mean_diagonal", "mean_vertical", "entropy"]

    def run(batches):
        for pdf in batches:
            rows = [rqa(np.array([np.asarray(x, float) for x in m]), l_min) for m in pdf[column]]
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, id_col, pdf[id_col].to_numpy())
            yield out

    return plots.select(id_col, column).mapInPandas(run, f"`{id_col}` {type_of(plots, id_col)}, " + ", ".join(f"{n} double" for n in names))


def stft(v: np.ndarray, nperseg: int = 64, noverlap: int | None = None, window: str = "hann") -> np.ndarray:
    """Short-time spectra (frequencies by frames): zero-extended by half a segment,
    padded to whole segments, scaled by the window's sum."""
    n = min(nperseg, len(v))
    step = n - (n // 2 if noverlap is None else min(noverlap, n - 1))
    k = np.arange(n)
    w = {"hann": 0.5 - 0.5 * np.cos(2 * np.pi * k / n), "hamming": 0.54 - 0.46 * np.cos(2 * np.pi * k / n), "boxcar": np.ones(n)}[window]
    x = np.concatenate([np.zeros(n // 2), v, np.zeros(n // 2)])
    x = np.concatenate([x, np.zeros(-(len(x) - n) % step)])
    return np.fft.rfft(np.lib.stride_tricks.sliding_window_view(x, n)[::step] * w, axis=1).T / w.sum()


def to_spectrogram(df: DataFrame, nperseg: int = 64, noverlap: int | None = None, window: str = "hann", log_scale: bool = True, id_col: str = ID, target_col: str = Y, time_col: str = TIME) -> DataFrame:
    ensure(window in ("hann", "hamming", "boxcar"), f"unknown window {window!r}")
    return _kernel(df, lambda v: (np.log1p if log_scale else np.asarray)(np.abs(stft(v, nperseg, noverlap, window))), "spectrogram", target_col, id_col, time_col)


def cwt(v: np.ndarray, scales: np.ndarray, wavelet: str = "morlet") -> np.ndarray:
    out = []
    for a in scales:
        half = int(min(10 * a, len(v) * 5)) // 2 * 2 + 1
        t = (np.arange(half) - half // 2) / a
        w = np.exp(5j * t) * np.exp(-t * t / 2) * np.pi**-0.25 if wavelet in ("morlet", "morl") else 2 / (np.sqrt(3) * np.pi**0.25) * (1 - t * t) * np.exp(-t * t / 2)
        full = np.convolve(v, np.conj(w[::-1]) / np.sqrt(a))
        at = (len(full) - len(v)) // 2
        out.append(np.abs(full[at : at + len(v)]))
    return np.array(out)


def to_scalogram(df: DataFrame, wavelet: str = "morlet", scales: list[float] | None = None, n_scales: int = 32, id_col: str = ID, target_col: str = Y, time_col: str = TIME) -> DataFrame:
    ensure(wavelet in ("morlet", "morl", "ricker", "mexh"), f"unknown wavelet {wavelet!r}")
    return _kernel(df, lambda v: cwt(v, np.asarray(scales, float) if scales else np.geomspace(1, max(len(v) / 2, 2), n_scales), wavelet), "scalogram", target_col, id_col, time_col)


def _augmented(v: np.ndarray, augmentations: list[str]) -> np.ndarray:
    p = v[:, None]
    for a in augmentations:
        if a == "time":
            p = np.column_stack([np.linspace(0, 1, len(p)), p])
        elif a == "leadlag":
            p = np.column_stack([np.repeat(p, 2, axis=0)[1:], np.repeat(p, 2, axis=0)[:-1]])
        elif a == "basepoint":
            p = np.vstack([np.zeros(p.shape[1]), p])
        else:
            raise ValueError(f"unknown augmentation {a!r}")
    return p


def signature(v: np.ndarray, depth: int, augmentations: list[str]) -> list[np.ndarray]:
    """The levels of the path signature, as sums over strictly ordered increments."""
    d = np.diff(_augmented(v, augmentations), axis=0)
    n = d.shape[1]
    levels, run = [d.sum(0)], np.cumsum(d, axis=0)
    before = np.vstack([np.zeros(n), run[:-1]])
    for _ in range(1, depth):
        terms = before[..., None] * d.reshape(len(d), *[1] * (before.ndim - 1), n)
        levels.append(terms.sum(0))
        before = np.concatenate([np.zeros((1, *terms.shape[1:])), np.cumsum(terms, axis=0)[:-1]])
    return levels


def signature_features(df: DataFrame, depth: int = 3, augmentations: list[str] | None = None, id_col: str = ID, target_col: str = Y, time_col: str = TIME, as_array: bool = False) -> DataFrame:
    """``sig_0`` ...: all levels up to ``depth``, flattened."""
    ensure(1 <= depth <= 3, "depth must be from 1 to 3")
    aug = augmentations if augmentations is not None else ["time"]
    rows = _kernel(df, lambda v: np.concatenate([x.ravel() for x in signature(v, depth, aug)]), "sig", target_col, id_col, time_col, "array<double>")
    n = sum(_augmented(np.zeros(2), aug).shape[1] ** k for k in range(1, depth + 1))
    return rows if as_array else rows.select(id_col, *[F.get("sig", F.lit(i)).alias(f"sig_{i}") for i in range(n)])


def to_signature_image(df: DataFrame, augmentations: list[str] | None = None, id_col: str = ID, target_col: str = Y, time_col: str = TIME) -> DataFrame:
    aug = augmentations if augmentations is not None else ["time"]
    return _kernel(df, lambda v: signature(v, 2, aug)[1], "signature", target_col, id_col, time_col)

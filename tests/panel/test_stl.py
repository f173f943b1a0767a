"""Local regression and MSTL against plain weighted least squares."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import stl


def direct(y, window, degree, rho, places):
    """One weighted least squares problem for every place."""
    n, out = len(y), []
    x = np.arange(n)
    for p in places:
        near = np.sort(np.lexsort((x, np.abs(x - p)))[: min(window, n)])
        reach = np.abs(near - p).max() + max(0, window - n) // 2
        r = np.abs(near - p) / reach if reach else np.zeros(len(near))
        w = np.where(r <= 0.001, 1, np.where(r <= 0.999, (1 - r**3) ** 3, 0)) * rho[near]
        if not w.sum():
            out.append(y[np.clip(p, 0, n - 1)])
            continue
        mean = (w * near).sum() / w.sum()
        wide = (w * (near - mean) ** 2).sum() / w.sum() > (0.001 * (n - 1)) ** 2
        a = np.stack([np.ones(len(near)), near - p][: 1 + (degree and bool(wide))], axis=1)
        out.append(np.linalg.lstsq(a * np.sqrt(w)[:, None], y[near] * np.sqrt(w), rcond=None)[0][0])
    return np.array(out)


@pytest.mark.parametrize("degree", [0, 1])
@pytest.mark.parametrize("n,window", [(1, 3), (2, 7), (5, 7), (30, 7), (30, 31), (41, 101)])
def test_loess_is_weighted_least_squares(degree, n, window, monkeypatch):
    rng = np.random.default_rng(n + window)
    y, rho = rng.normal(size=(3, n)), rng.choice([0.0, 0.3, 1.0], size=(3, n))
    places = np.arange(-1, n + 1)
    monkeypatch.setattr(stl, "_CELLS", 100)
    for weights in (None, rho):
        got = stl.loess(y, window, degree, weights, places)
        for i in range(3):
            want = direct(y[i], window, degree, np.ones(n) if weights is None else rho[i], places)
            np.testing.assert_allclose(got[i], want, atol=1e-7)


def slow_stl(y, period, window, trend_window, robust):
    n = len(y)
    trend, rho = np.zeros(n), np.ones(n)
    for outer in range(robust + 1):
        for _ in range(2):
            cycle = np.empty(n + 2 * period)
            for ph in range(period):
                own = (y - trend)[ph::period]
                cycle[ph::period] = direct(own, window, 0, rho[ph::period], range(-1, len(own) + 1))
            low = cycle
            for k in (period, period, 3):
                low = np.convolve(low, np.ones(k) / k, "valid")
            seasonal = cycle[period : period + n] - direct(low, period + 1 - period % 2, 1, np.ones(n), range(n))
            trend = direct(y - seasonal, trend_window, 1, rho, range(n))
        if outer < robust:
            rest = np.abs(y - seasonal - trend)
            r = rest / (6 * np.median(rest))
            rho = np.where(r <= 0.001, 1, np.where(r <= 0.999, (1 - r**2) ** 2, 0))
    return seasonal, trend


@pytest.mark.parametrize("robust", [0, 2])
@pytest.mark.parametrize("n,period", [(30, 7), (28, 14), (45, 6)])
def test_stl_of_many_series(n, period, robust):
    rng = np.random.default_rng(n)
    t = np.arange(n)
    y = np.stack([0.1 * t + np.sin(2 * np.pi * t / period) + rng.normal(0, 0.2, n) for _ in range(4)])
    y[1, 5] += 30
    seasonal, trend, weights = stl.stl(y, period, 11, robust=robust)
    for i in range(4):
        s, d = slow_stl(y[i], period, 11, stl.odd_from(1.5 * period / (1 - 1.5 / 11)), robust)
        np.testing.assert_allclose(seasonal[i], s, atol=1e-6)
        np.testing.assert_allclose(trend[i], d, atol=1e-6)
    assert weights.shape == y.shape and (weights[1, 5] < 0.5) == bool(robust)


def test_mstl_takes_turns():
    t = np.arange(140)
    week, fortnight = np.sin(2 * np.pi * t / 7), 2 * np.cos(2 * np.pi * t / 14)
    y = (5 + 0.05 * t + week + fortnight)[None]
    trend, (first, second) = stl.mstl(y, [7, 14])
    np.testing.assert_allclose((trend + first + second)[0], y[0], atol=0.05)
    assert np.corrcoef(second[0], fortnight)[0, 1] > 0.99
    # By hand: each period on what the other leaves, twice.
    a = np.zeros_like(y)
    b = np.zeros_like(y)
    for _ in range(2):
        a, _, _ = stl.stl(y - b, 7, 11)
        b, d, _ = stl.stl(y - a, 14, 15)
    np.testing.assert_allclose(first, a, atol=1e-9)
    np.testing.assert_allclose(second, b, atol=1e-9)
    np.testing.assert_allclose(trend, d, atol=1e-9)
    swapped = stl.mstl(y, [14, 7])
    np.testing.assert_allclose(swapped[1][1], first, atol=1e-9)
    # Less than two cycles: the period has no part.
    assert not stl.mstl(y[:, :20], [7, 14])[1][1].any() and stl.mstl(y[:, :20], [7, 14])[1][0].any()
    assert stl.mstl(np.ones((2, 3)), [7])[0].shape == (2, 3)


def panel(spark, series, parts=3):
    rows = [(u, date(2024, 1, 1) + timedelta(days=i), v, "x") for u, vs in series.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "unique_id string, ds date, y double, trend string").repartition(parts)


def test_decomposition_of_a_panel(spark):
    from tidepanel.operators.stl import mstl_decomposition

    rng = np.random.default_rng(1)
    t = np.arange(42)
    wave = lambda k: (k + 0.2 * t + np.sin(2 * np.pi * t / 7) + rng.normal(0, 0.1, 42)).tolist()
    holes = wave(3)
    holes[0] = holes[10] = holes[11] = None
    series = {"a": wave(1), "b": wave(2), "c": holes, "short": wave(1)[:9], "none": [None] * 5, "one": [4.0]}
    got = mstl_decomposition(panel(spark, series), [7], robust=1).orderBy("unique_id", "ds").toPandas()
    assert list(got.columns) == ["unique_id", "ds", "y", "trend", "seasonal", "resid"] and len(got) == sum(map(len, series.values()))
    for u in ("a", "b", "c", "short"):
        y = np.array([np.nan if v is None else v for v in series[u]], float)
        there = np.flatnonzero(~np.isnan(y))
        trend, seasonal = stl.mstl(np.interp(np.arange(len(y)), there, y[there])[None], [7], robust=1)
        mine = got[got.unique_id == u]
        np.testing.assert_allclose(mine.trend, trend[0], atol=1e-9)
        np.testing.assert_allclose(mine.seasonal, seasonal[0][0], atol=1e-9)
        np.testing.assert_allclose(mine.resid, y - trend[0] - seasonal[0][0], atol=1e-9)
    assert got[got.unique_id == "none"][["trend", "seasonal", "resid"]].isna().all().all()
    assert got[got.unique_id == "one"].trend.tolist() == [4.0]
    assert mstl_decomposition(panel(spark, {"a": wave(1)}).limit(0), [7]).count() == 0


def test_features_and_what_is_refused(spark):
    from tidepanel.operators.cleaning import seasonal_decompose_features

    t = np.arange(60)
    rng = np.random.default_rng(2)
    df = panel(spark, {"s": (10 + np.sin(2 * np.pi * t / 7) + rng.normal(0, 0.05, 60)).tolist(), "t": (10 + t + rng.normal(0, 1, 60)).tolist()}).drop("trend")
    got = {r.unique_id: r for r in seasonal_decompose_features(df, 365, [7, 14], "mstl").collect()}
    assert got["s"].seasonal7_strength > 0.9 and got["t"].trend_strength > 0.9 and got["s"].seasonal14_strength < got["s"].seasonal7_strength
    one = seasonal_decompose_features(df, 24, [7], mode="mstl")
    assert one.columns == ["unique_id", "trend_strength", "seasonal_strength", "resid_var"]
    simple = seasonal_decompose_features(df, 7).filter("unique_id = 's'").first()
    from tidepanel.operators.cleaning import seasonal_decomposition

    part = seasonal_decomposition(df, 7).filter("unique_id = 's'").agg(F.stddev_samp("resid") / F.avg("y")).first()[0]
    assert simple.resid_var == pytest.approx(part)
    for error, args in ((ValueError, (24, None, "mstl")), (ValueError, (7, [], "mstl")), (ValueError, (24, None, "other")), (TypeError, (24, "daily", "mstl")), (TypeError, (24, [7.5], "mstl")), (ValueError, (0, None)), (ValueError, (24, [7, 7], "mstl"))):
        with pytest.raises(error):
            seasonal_decompose_features(df, *args)
    with pytest.raises(KeyError):
        seasonal_decompose_features(df.drop("y"), 24)

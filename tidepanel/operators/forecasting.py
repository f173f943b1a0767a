"""Forecasts of single series: baselines, smoothing, ARIMA, combinations.

All give ``id, time, y_hat``, h rows per series. Baselines are window and
aggregate plans; smoothing recursions are folds over the series array and stay in
the JVM; only FFT, theta and ARIMA fits run as grouped numpy kernels.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions import ces
from tidepanel.functions.stats import nelder_mead
from tidepanel.panel import ID, TIME, Y, as_series, by_time, ensure, explode_horizon, future_times, map_series, median_step, type_of


def _future(rows: DataFrame, df: DataFrame, h: int, id_col: str, time_col: str) -> DataFrame:
    """Rows (id, ...) with h future times each, in column ``k`` and the time."""
    steps = median_step(df, id_col, time_col)
    return explode_horizon(rows.join(steps, id_col), h, id_col, time_col, df.schema[time_col].dataType)


def naive_forecast(df: DataFrame, h: int, target_col: str = Y, id_col: str = ID, time_col: str = TIME) -> DataFrame:
    last = df.groupBy(id_col).agg(F.max_by(target_col, time_col).cast("double").alias("y_hat"))
    return _future(last, df, h, id_col, time_col).select(id_col, time_col, "y_hat")


def seasonal_naive_forecast(df: DataFrame, h: int, season_length: int, target_col: str = Y, id_col: str = ID, time_col: str = TIME) -> DataFrame:
    ensure(season_length > 0, "season_length must be positive")
    tail = _tail(df, season_length, target_col, id_col, time_col)
    out = _future(tail, df, h, id_col, time_col)
    return out.select(id_col, time_col, F.get("tail", F.pmod(F.col("k") - 1, F.size("tail")).cast("int")).alias("y_hat"))


def moving_average_forecast(df: DataFrame, h: int, window_size: int, target_col: str = Y, id_col: str = ID, time_col: str = TIME) -> DataFrame:
    ensure(window_size > 0, "window_size must be positive")
    recent = df.withColumn("__r", F.row_number().over(by_time(id_col, time_col, desc=True))).filter(F.col("__r") <= window_size)
    mean = recent.groupBy(id_col).agg(F.avg(target_col).alias("y_hat"))
    return _future(mean, df, h, id_col, time_col).select(id_col, time_col, "y_hat")


def _tail(df: DataFrame, n: int, target_col: str, id_col: str, time_col: str) -> DataFrame:
    recent = df.withColumn("__r", F.row_number().over(by_time(id_col, time_col, desc=True))).filter(F.col("__r") <= n)
    return as_series(recent, target_col, id_col, time_col, name="tail", drop_null=False)


def fft_forecast(df: DataFrame, h: int, n_harmonics: int = 5, target_col: str = Y, id_col: str = ID, time_col: str = TIME) -> DataFrame:
    """The mean and the strongest harmonics, carried on."""
    ensure(n_harmonics > 0, "n_harmonics must be positive")

    def kernel(_, times, v):
        n = len(v)
        z = np.fft.rfft(v)
        top = np.argsort(np.abs(z[1:]), kind="stable")[::-1][:n_harmonics] + 1
        t = np.arange(n, n + h)[:, None]
        waves = 2 * np.abs(z[top]) / n * np.cos(2 * np.pi * top / n * t + np.angle(z[top]))
        return {time_col: future_times(times, h), "y_hat": z[0].real / n + waves.sum(axis=1)}

    return map_series(df, kernel, f"`{time_col}` {type_of(df, time_col)}, y_hat double", target_col, id_col, time_col)


def _check(**rates: float) -> None:
    for name, rate in rates.items():
        ensure(0 < rate < 1, f"{name} must be in (0, 1)")


def ses_state(series, alpha: float):
    """The level after a fold over the series."""
    return F.aggregate(F.slice(series, 2, F.greatest(F.size(series) - 1, F.lit(0))), F.element_at(series, 1), lambda level, y: y * alpha + level * (1 - alpha))


def ses_forecast(df: DataFrame, h: int, alpha: float = 0.3, target_col: str = Y, id_col: str = ID, time_col: str = TIME) -> DataFrame:
    _check(alpha=alpha)
    level = as_series(df, target_col, id_col, time_col).select(id_col, ses_state(F.col("series"), alpha).alias("y_hat"))
    return _future(level, df, h, id_col, time_col).select(id_col, time_col, "y_hat")


def holt_state(series, alpha: float, beta: float):
    """struct(level, trend): trend starts as y1 - y0, and the fold at the second."""
    first = F.struct(F.element_at(series, 1).alias("level"), (F.element_at(series, 2) - F.element_at(series, 1)).alias("trend"))

    def step(s, y):
        level = y * alpha + (s["level"] + s["trend"]) * (1 - alpha)
        return F.struct(level.alias("level"), ((level - s["level"]) * beta + s["trend"] * (1 - beta)).alias("trend"))

    return F.aggregate(F.slice(series, 2, F.greatest(F.size(series) - 1, F.lit(0))), first, step)


def holt_forecast(df: DataFrame, h: int, alpha: float = 0.3, beta: float = 0.1, target_col: str = Y, id_col: str = ID, time_col: str = TIME) -> DataFrame:
    """Needs two observations; a shorter series has no rows."""
    _check(alpha=alpha, beta=beta)
    s = as_series(df, target_col, id_col, time_col).filter(F.size("series") >= 2)
    s = s.select(id_col, holt_state(F.col("series"), alpha, beta).alias("s"))
    return _future(s, df, h, id_col, time_col).select(id_col, time_col, (F.col("s.level") + F.col("k") * F.col("s.trend")).alias("y_hat"))


def holt_winters_state(series, m: int, alpha: float, beta: float, gamma: float, additive: bool):
    """struct(level, trend, seasons, t) after a fold from the second season on."""
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda p, q: p + q) / m
    one, two = mean(F.slice(series, 1, m)), mean(F.slice(series, m + 1, m))
    season = lambda y: y - one if additive else F.coalesce(F.try_divide(y, one), F.lit(1.0))
    start = F.struct(one.alias("level"), ((two - one) / m).alias("trend"), F.transform(F.slice(series, 1, m), season).alias("seasons"), F.lit(m).alias("t"))

    def step(s, y):
        at = F.pmod(s["t"], F.lit(m)).cast("int")
        own = F.get(s["seasons"], at)
        bare = y - own if additive else F.coalesce(F.try_divide(y, own), y)
        level = bare * alpha + (s["level"] + s["trend"]) * (1 - alpha)
        new = y - level if additive else F.coalesce(F.try_divide(y, level), F.lit(1.0))
        seasons = F.transform(s["seasons"], lambda x, i: F.when(i == at, new * gamma + own * (1 - gamma)).otherwise(x))
        return F.struct(level.alias("level"), ((level - s["level"]) * beta + s["trend"] * (1 - beta)).alias("trend"), seasons.alias("seasons"), (s["t"] + 1).alias("t"))

    return F.aggregate(F.slice(series, m + 1, F.greatest(F.size(series) - m, F.lit(0))), start, step)


def holt_winters_forecast(df: DataFrame, h: int, season_length: int, alpha: float = 0.3, beta: float = 0.1, gamma: float = 0.1, seasonal: str = "additive", target_col: str = Y, id_col: str = ID, time_col: str = TIME) -> DataFrame:
    """Needs two seasons; a shorter series has no rows."""
    _check(alpha=alpha, beta=beta, gamma=gamma)
    ensure(seasonal in ("additive", "multiplicative"), f"unknown seasonal {seasonal!r}")
    m, additive = season_length, seasonal == "additive"
    s = as_series(df, target_col, id_col, time_col).filter(F.size("series") >= 2 * m)
    s = s.select(id_col, holt_winters_state(F.col("series"), m, alpha, beta, gamma, additive).alias("s"))
    out = _future(s, df, h, id_col, time_col)
    trend, season = F.col("s.level") + F.col("k") * F.col("s.trend"), F.get("s.seasons", F.pmod(F.col("s.t") + F.col("k") - 1, F.lit(m)).cast("int"))
    return out.select(id_col, time_col, (trend + season if additive else trend * season).alias("y_hat"))


# -- ARIMA -----------------------------------------------------------------


def _expand(phi: np.ndarray, seasonal: np.ndarray, m: int, sign: float) -> np.ndarray:
    """Coefficients of (1 + s phi(B)) (1 + s PHI(B^m)) without the leading 1."""
    a = np.concatenate([[1.0], sign * phi])
    b = np.zeros(len(seasonal) * m + 1)
    b[0] = 1.0
    b[m::m] = sign * seasonal if len(seasonal) else b[m::m]
    return np.convolve(a, b)[1:]


def _css(w: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> np.ndarray:
    """Residuals by conditional sums: w_t + sum ar_i w_(t-i) - sum ma_j e_(t-j)."""
    x = np.convolve(w, np.concatenate([[1.0], ar]))[: len(w)]
    x[: len(ar)] = 0.0
    if not len(ma):
        return x
    e = np.zeros(len(w))
    for t in range(len(w)):
        k = min(t, len(ma))
        e[t] = x[t] - (ma[:k] * e[t - k : t][::-1]).sum()
    return e


class ArimaModel:
    """(p, d, q)(P, D, Q, m) by conditional least squares."""

    def __init__(self, order: tuple[int, int, int], seasonal: tuple[int, int, int, int] | None = None):
        self.order, self.seasonal = order, seasonal or (0, 0, 0, 1)

    def fit(self, y: np.ndarray) -> ArimaModel:
        (p, d, q), (sp, sd, sq, m) = self.order, self.seasonal
        w = np.asarray(y, float)
        self.levels = []
        for step in [m] * sd + [1] * d:
            self.levels.append((step, w))
            w = w[step:] - w[:-step]
        self.w = w
        mean = d + sd == 0
        self.mean = w.mean() if mean and len(w) else 0.0
        sizes = np.cumsum([p, q, sp, sq])

        def parts(x):
            a, b, c, e = np.split(np.tanh(x) * 0.99, sizes[:-1])
            return _expand(a, c, m, -1.0), _expand(b, e, m, 1.0)

        def loss(x):
            res = _css(w - self.mean, *parts(x))
            return float((res * res).sum())

        best = np.zeros(sizes[-1])
        if len(best):
            best, _ = nelder_mead(loss, best, max_iter=60, step=0.25)
        self.ar, self.ma = parts(best)
        self.res = _css(w - self.mean, self.ar, self.ma)
        n, k = max(len(w), 1), len(best) + 1 + mean
        self.sigma2 = max(float((self.res**2).mean()) if len(w) else 0.0, 1e-12)
        self.aicc = n * np.log(self.sigma2) + 2 * k + 2 * k * (k + 1) / max(n - k - 1, 1e-3)
        return self

    def predict(self, h: int) -> np.ndarray:
        w, e = list(self.w - self.mean), list(self.res)
        for _ in range(h):
            value = -sum(c * w[-i] for i, c in enumerate(self.ar, 1) if i <= len(w)) + sum(c * e[-j] for j, c in enumerate(self.ma, 1) if j <= len(e))
            w.append(value)
            e.append(0.0)
        out = np.array(w[len(self.w) :]) + self.mean
        for step, level in reversed(self.levels):
            history = list(level)
            for x in out:
                history.append(history[-step] + x)
            out = np.array(history[len(level) :])
        return out

    def spread(self, h: int) -> np.ndarray:
        """Standard errors of the forecasts, from the psi weights."""
        ar = np.concatenate([[1.0], self.ar])
        for step, _ in self.levels:
            d = np.zeros(step + 1)
            d[0], d[-1] = 1.0, -1.0
            ar = np.convolve(ar, d)
        psi, ma = [1.0], self.ma
        for j in range(1, h):
            value = ma[j - 1] if j <= len(ma) else 0.0
            psi.append(value - sum(ar[i] * psi[j - i] for i in range(1, min(j, len(ar) - 1) + 1)))
        return np.sqrt(self.sigma2 * np.cumsum(np.square(psi)))


def auto_order(y: np.ndarray, season_length: int = 1) -> ArimaModel:
    """The differencing with the least spread, then a stepwise search by AICc."""
    m = season_length
    sd = int(m > 1 and len(y) > 3 * m and np.std(y[m:] - y[:-m]) < 0.9 * np.std(y))
    w = y[m:] - y[:-m] if sd else y
    d = 0
    while d < 2 and len(w) > 5 and np.std(np.diff(w)) < 0.95 * np.std(w):
        w, d = np.diff(w), d + 1
    seen: dict[tuple, ArimaModel] = {}

    def of(p, q, sp, sq):
        key = (p, q, sp, sq)
        if key not in seen:
            seen[key] = ArimaModel((p, d, q), (sp, sd, sq, m) if m > 1 else None).fit(y)
        return seen[key]

    now = min(((0, 0, 0, 0), (1, 0, 0, 0), (0, 1, 0, 0), (1, 1, 0, 0)), key=lambda k: of(*k).aicc)
    for _ in range(8):
        near = [tuple(np.add(now, move)) for move in ((1, 0, 0, 0), (-1, 0, 0, 0), (0, 1, 0, 0), (0, -1, 0, 0), *(((0, 0, 1, 0), (0, 0, -1, 0), (0, 0, 0, 1), (0, 0, 0, -1)) if m > 1 else ()))]
        near = [k for k in near if min(k) >= 0 and k[0] <= 3 and k[1] <= 3 and max(k[2:]) <= 1]
        best = min(near, key=lambda k: of(*k).aicc)
        if of(*best).aicc >= of(*now).aicc:
            break
        now = best
    return of(*now)


def auto_arima(df: DataFrame, h: int, season_length: int = 1, target_col: str = Y, id_col: str = ID, time_col: str = TIME) -> DataFrame:
    def kernel(_, times, v):
        v = v[~np.isnan(v)]
        if len(v) < 3:
            return None
        return {time_col: future_times(times, h), "y_hat": auto_order(v, season_length).predict(h)}

    return map_series(df, kernel, f"`{time_col}` {type_of(df, time_col)}, y_hat double", target_col, id_col, time_col)


_ARIMA = "order array<int>, seasonal_order array<int>, ar array<double>, ma array<double>, mean double, sigma2 double, aicc double, history array<double>"


def arima_fit(df: DataFrame, order: tuple[int, int, int] = (1, 1, 1), seasonal_order: tuple[int, int, int, int] | None = None, target_col: str = Y, id_col: str = ID, time_col: str = TIME) -> DataFrame:
    """One row of parameters and the history per id."""

    def kernel(_, times, v):
        v = v[~np.isnan(v)]
        m = ArimaModel(order, seasonal_order).fit(v)
        return {"order": [list(order)], "seasonal_order": [list(m.seasonal)], "ar": [m.ar.tolist()], "ma": [m.ma.tolist()], "mean": [m.mean], "sigma2": [m.sigma2], "aicc": [m.aicc], "history": [v.tolist()]}

    return map_series(df, kernel, _ARIMA, target_col, id_col, time_col)


def arima_forecast(fitted: DataFrame, h: int, id_col: str = ID, time_col: str = TIME) -> DataFrame:
    """The time column counts the steps from 1."""

    @F.pandas_udf("array<double>")
    def predict(order, seasonal, ar, ma, mean, history):
        import pandas as pd

        out = []
        for o, s, a, b, mu, y in zip(order, seasonal, ar, ma, mean, history):
            m = ArimaModel(tuple(o), tuple(s))
            w, m.levels = np.asarray(y, float), []
            for step in [s[3]] * s[1] + [1] * o[1]:
                m.levels.append((step, w))
                w = w[step:] - w[:-step]
            m.w, m.mean, m.ar, m.ma = w, mu, np.asarray(a, float), np.asarray(b, float)
            m.res = _css(w - mu, m.ar, m.ma)
            out.append(m.predict(h).tolist())
        return pd.Series(out)

    values = fitted.select(id_col, F.posexplode(predict("order", "seasonal_order", "ar", "ma", "mean", "history")).alias("k", "y_hat"))
    return values.select(id_col, (F.col("k") + 1).alias(time_col), "y_hat")


# -- combinations ----------------------------------------------------------


def _smooth_fit(v: np.ndarray, season: int) -> tuple[np.ndarray, str]:
    """Parameters of an additive smoothing model chosen by AIC: level, trend and,
    with enough data, seasons."""
    best = None
    kinds = ["ses", "holt"] + (["hw"] if season > 1 and len(v) >= 2 * season + 2 else [])
    for kind in kinds:
        size = {"ses": 1, "holt": 2, "hw": 3}[kind]
        loss = lambda x, kind=kind: np.sum(_smooth_run(v, 1 / (1 + np.exp(-x)), kind, season, 0)[1] ** 2)
        x, f = nelder_mead(loss, np.full(size, -1.0), max_iter=60, step=0.5)
        aic = len(v) * np.log(max(f / len(v), 1e-12)) + 2 * (2 * size + (season if kind == "hw" else 0))
        if best is None or aic < best[0]:
            best = (aic, 1 / (1 + np.exp(-x)), kind)
    return best[1], best[2]


def _smooth_run(v: np.ndarray, rates: np.ndarray, kind: str, season: int, h: int) -> tuple[np.ndarray, np.ndarray]:
    """Forecasts and one-step errors."""
    level, trend, s = v[0], 0.0, np.zeros(max(season, 1))
    start = 1
    if kind == "holt" and len(v) > 1:
        trend = v[1] - v[0]
    if kind == "hw":
        level, start = v[:season].mean(), season
        trend, s = (v[season : 2 * season].mean() - level) / season, v[:season] - level
    a, b, g = (*rates, 0.0, 0.0)[:3]
    errors = []
    for t in range(start, len(v)):
        own = s[t % season] if kind == "hw" else 0.0
        errors.append(v[t] - level - trend - own)
        new = a * (v[t] - own) + (1 - a) * (level + trend)
        trend = b * (new - level) + (1 - b) * trend if kind != "ses" else 0.0
        level = new
        if kind == "hw":
            s[t % season] = g * (v[t] - level) + (1 - g) * own
    ahead = [level + k * trend + (s[(len(v) - 1 + k) % season] if kind == "hw" else 0.0) for k in range(1, h + 1)]
    return np.array(ahead), np.array(errors or [0.0])


def _theta(v: np.ndarray, h: int, season: int) -> np.ndarray:
    """The theta method: half the slope of the line plus simple smoothing."""
    s = np.zeros(max(season, 1))
    if season > 1 and len(v) >= 2 * season:
        for k in range(season):
            s[k] = (v[k::season] - v.mean()).mean()
        s -= s.mean()
    t = np.arange(len(v))
    bare = v - s[t % len(s)]
    slope = np.polyfit(t, bare, 1)[0] if len(v) > 1 else 0.0
    x, _ = nelder_mead(lambda x: np.sum(_smooth_run(bare, 1 / (1 + np.exp(-x)), "ses", 1, 0)[1] ** 2), np.array([0.0]), max_iter=60, step=0.5)
    a = 1 / (1 + np.exp(-x[0]))
    level = _smooth_run(bare, np.array([a]), "ses", 1, 1)[0][0]
    k = np.arange(1, h + 1)
    return level + slope / 2 * (k - 1 + (1 - (1 - a) ** len(v)) / a) + s[(len(v) - 1 + k) % len(s)]


def ces_forecast(df: DataFrame, h: int, season_length: int = 1, form: str | None = None, rates: tuple[float, ...] | None = None, target_col: str = Y, id_col: str = ID, time_col: str = TIME) -> DataFrame:
    """Complex smoothing of every series: the given form, or the one with the least
    corrected information criterion, at given or fitted rates. Missing values are
    left out; a series without any gives no rows."""
    ensure(h > 0, "h must be positive")
    ensure(form is None or form in ces.FORMS, f"form must be of {ces.FORMS}")
    ensure(form in (None, "none") or season_length > 1, "seasonal forms need season_length")
    ensure(rates is None or (form is not None and len(rates) == ces.rates_of(form)), "rates need a form and its number of them")

    def kernel(_, times, v):
        v = v[~np.isnan(v)]
        if not len(v):
            return None
        own, found = (form, np.array(rates)) if rates is not None else ces.auto(v, season_length, ces.FORMS if form is None else (form,))
        if own != "none" and len(v) < 2 * season_length:
            own, found = "none", found[:2]
        return {time_col: future_times(times, h), "y_hat": ces.run(v, found, own, season_length, h)[0]}

    return map_series(df, kernel, f"`{time_col}` {type_of(df, time_col)}, y_hat double", target_col, id_col, time_col)


class SCUM:
    """The mean of four members: automatic ARIMA, automatic smoothing, automatic
    complex smoothing and the theta method, with intervals from the ARIMA member's
    errors."""

    def __init__(self, season_length: int = 1, alias: str = "SCUM", level: float = 0.9):
        self.season_length, self.alias, self.level = season_length, alias, level

    def members(self, v: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray]:
        m = self.season_length
        arima = auto_order(v, m) if len(v) >= 3 else ArimaModel((0, 1, 0)).fit(v)
        rates, kind = _smooth_fit(v, m)
        smooth = _smooth_run(v, rates, kind, m, h)[0]
        form, z_rates = ces.auto(v, m)
        complex_ = ces.run(v, z_rates, form, m, h)[0]
        return np.stack([arima.predict(h), smooth, complex_, _theta(v, h, m)]), arima.spread(h)

    def fit(self, df: DataFrame, target_col: str = Y, id_col: str = ID, time_col: str = TIME) -> SCUM:
        self.df_, self.cols_ = df, (target_col, id_col, time_col)
        return self

    def predict(self, h: int) -> DataFrame:
        from tidepanel.functions.stats import normal_quantile

        if not hasattr(self, "df_"):
            raise RuntimeError("call fit() before predict()")
        target_col, id_col, time_col = self.cols_
        z = normal_quantile(0.5 + self.level / 2)

        members = SCUM(self.season_length, self.alias, self.level).members

        def kernel(_, times, v):
            points, spread = members(v[~np.isnan(v)], h)
            mid = points.mean(axis=0)
            return {time_col: future_times(times, h), "y_hat": mid, "y_hat_lower": mid - z * spread, "y_hat_upper": mid + z * spread}

        return map_series(self.df_, kernel, f"`{time_col}` {type_of(self.df_, time_col)}, y_hat double, y_hat_lower double, y_hat_upper double", target_col, id_col, time_col)


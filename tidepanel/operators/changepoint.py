"""Change points, regimes, volatility, vector autoregression, anomalies."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.stats import f_sf, logsumexp, nelder_mead, student_t_cdf, student_t_logpdf
from tidepanel.operators.rows import lagged
from tidepanel.panel import ID, TIME, Y, ensure, map_series, type_of


def pelt_points(v: np.ndarray, cost: str = "mean", penalty: float | None = None, min_size: int = 2) -> list[int]:
    """The first index of every segment but the first, by pruned exact search."""
    n = len(v)
    if n < 2 * min_size:
        return []
    penalty = 2 * np.log(n) if penalty is None else penalty
    s1, s2 = np.concatenate([[0], np.cumsum(v)]), np.concatenate([[0], np.cumsum(v * v)])
    mean = v.mean()
    m1, m2 = np.concatenate([[0], np.cumsum(v - mean)]), np.concatenate([[0], np.cumsum((v - mean) ** 2)])

    def seg(a, b):
        size = b - a
        if cost == "mean":
            return s2[b] - s2[a] - (s1[b] - s1[a]) ** 2 / size
        if cost == "var":
            spread = np.maximum(m2[b] - m2[a], 0) / size
        else:
            spread = np.maximum((s2[b] - s2[a]) / size - ((s1[b] - s1[a]) / size) ** 2, 0)
        return size * np.log(np.maximum(spread, 1e-12))

    best, came = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = -penalty
    starts = np.array([0])
    for t in range(min_size, n + 1):
        open_ = starts[t - starts >= min_size]
        value = best[open_] + seg(open_, t) + penalty
        k = int(np.argmin(value))
        best[t], came[t] = value[k], open_[k]
        closed = open_[value - penalty > best[t]]
        starts = np.append(np.setdiff1d(starts, closed), t)
    out, t = [], n
    while came[t] > 0:
        t = came[t]
        out.append(int(t))
    return out[::-1]


def pelt(df: DataFrame, target_col: str = Y, id_col: str = ID, time_col: str = TIME, cost: str = "mean", penalty: float | None = None, min_size: int = 2) -> DataFrame:
    """id, changepoint_idx and the time there."""
    ensure(cost in ("mean", "var", "meanvar"), f"unknown cost {cost!r}")

    def kernel(_, times, v):
        at = pelt_points(v, cost, penalty, min_size)
        return {"changepoint_idx": at, time_col: [times[i] for i in at]}

    return map_series(df, kernel, f"changepoint_idx long, `{time_col}` {type_of(df, time_col)}", target_col, id_col, time_col)


def bocpd(df: DataFrame, target_col: str = Y, id_col: str = ID, time_col: str = TIME, hazard_rate: float = 200.0, mu_prior: float = 0.0, kappa_prior: float = 1.0, alpha_prior: float = 1.0, beta_prior: float = 1.0, threshold: float = 0.5) -> DataFrame:
    """Bayesian online change points: run_length, changepoint_prob (constant at
    1 / hazard_rate in this recursion), is_changepoint, and ``run_drop``, true
    where the likeliest run becomes much shorter, which does tell changes."""

    def kernel(_, times, v):
        mu, kappa, alpha, beta = (np.array([p]) for p in (mu_prior, kappa_prior, alpha_prior, beta_prior))
        log_run, hazard = np.array([0.0]), 1 / hazard_rate
        runs, probs = [], []
        for x in v:
            pred = student_t_logpdf(x, 2 * alpha, mu, np.sqrt(beta * (kappa + 1) / (alpha * kappa)))
            grow = log_run + pred + np.log1p(-hazard)
            log_run = np.concatenate([[logsumexp(log_run + pred) + np.log(hazard)], grow])
            log_run -= logsumexp(log_run)
            runs.append(int(np.argmax(log_run)))
            probs.append(float(np.exp(log_run[0])))
            beta = np.concatenate([[beta_prior], beta + kappa * (x - mu) ** 2 / (2 * (kappa + 1))])
            mu = np.concatenate([[mu_prior], (kappa * mu + x) / (kappa + 1)])
            kappa, alpha = np.concatenate([[kappa_prior], kappa + 1]), np.concatenate([[alpha_prior], alpha + 0.5])
        drop = [i > 0 and runs[i] < runs[i - 1] for i in range(len(runs))]
        return {time_col: times, "run_length": runs, "changepoint_prob": probs, "is_changepoint": [p > threshold for p in probs], "run_drop": drop}

    return map_series(df, kernel, f"`{time_col}` {type_of(df, time_col)}, run_length long, changepoint_prob double, is_changepoint boolean, run_drop boolean", target_col, id_col, time_col)


def regime_detect(df: DataFrame, n_states: int = 2, target_col: str = Y, id_col: str = ID, time_col: str = TIME, max_iter: int = 100, tol: float = 1e-4, seed: int = 42) -> DataFrame:
    """A Gaussian hidden Markov model per series: regime (in order of the states'
    means) and its posterior probability."""

    def kernel(_, times, v):
        k, n = n_states, len(v)
        rng = np.random.default_rng(seed)
        mean = np.quantile(v, (np.arange(k) + 0.5) / k) + rng.normal(0, 1e-3, k) * (v.std() + 1e-9)
        var = np.full(k, v.var() / k + 1e-6)
        trans, start, old = np.full((k, k), 0.1 / max(k - 1, 1)), np.full(k, 1 / k), -np.inf
        np.fill_diagonal(trans, 0.9 if k > 1 else 1.0)
        for _ in range(max_iter):
            e = -0.5 * (np.log(2 * np.pi * var) + (v[:, None] - mean) ** 2 / var)
            lt = np.log(trans)
            f, b = np.zeros((n, k)), np.zeros((n, k))
            f[0] = np.log(start) + e[0]
            for t in range(1, n):
                f[t] = e[t] + logsumexp(f[t - 1][:, None] + lt, axis=0)
            for t in range(n - 2, -1, -1):
                b[t] = logsumexp(lt + e[t + 1] + b[t + 1], axis=1)
            like = logsumexp(f[-1])
            post = np.exp(f + b - like)
            if abs(like - old) < tol:
                break
            old = like
            move = np.exp(f[:-1, :, None] + lt + e[1:, None, :] + b[1:, None, :] - like).sum(0)
            trans = (move + 1e-6) / (move + 1e-6).sum(1, keepdims=True)
            start = (post[0] + 1e-6) / (post[0] + 1e-6).sum()
            weight = post.sum(0) + 1e-9
            mean = (post * v[:, None]).sum(0) / weight
            var = (post * (v[:, None] - mean) ** 2).sum(0) / weight + 1e-6
        post = post[:, np.argsort(mean)]
        return {time_col: times, "regime": post.argmax(1), "regime_prob": post.max(1)}

    return map_series(df, kernel, f"`{time_col}` {type_of(df, time_col)}, regime long, regime_prob double", target_col, id_col, time_col)


# -- volatility ------------------------------------------------------------


def _garch_path(v, omega, alpha, beta):
    e2, s = v * v, np.full(len(v), v.var() + 1e-12)
    for t in range(1, len(v)):
        s[t] = omega + sum(a * e2[t - i] for i, a in enumerate(alpha, 1) if t >= i) + sum(b * s[t - j] for j, b in enumerate(beta, 1) if t >= j)
    return np.maximum(s, 1e-12)


def garch_fit(df: DataFrame, p: int = 1, q: int = 1, target_col: str = Y, id_col: str = ID, time_col: str = TIME, max_iter: int = 200) -> DataFrame:
    """Per id: omega, alpha (of squared shocks), beta (of variances), the variance
    path, the log-likelihood and the last squared shocks."""

    def kernel(_, times, v):
        v = v - v.mean()

        def loss(x):
            omega, alpha, beta = np.exp(x[0]), np.abs(x[1 : 1 + q]), np.abs(x[1 + q :])
            if alpha.sum() + beta.sum() >= 0.999:
                return 1e10 * (alpha.sum() + beta.sum())
            s = _garch_path(v, omega, alpha, beta)
            return 0.5 * float(np.sum(np.log(2 * np.pi * s) + v * v / s))

        start = np.concatenate([[np.log(v.var() * 0.1 + 1e-9)], np.full(q, 0.1 / q), np.full(p, 0.8 / p)])
        x, f = nelder_mead(loss, start, max_iter=max_iter)
        omega, alpha, beta = float(np.exp(x[0])), np.abs(x[1 : 1 + q]), np.abs(x[1 + q :])
        s = _garch_path(v, omega, alpha, beta)
        return {"omega": [omega], "alpha": [alpha.tolist()], "beta": [beta.tolist()], "conditional_variance": [s.tolist()], "log_likelihood": [-f], "shocks": [(v[-q:] ** 2).tolist()]}

    return map_series(df, kernel, "omega double, alpha array<double>, beta array<double>, conditional_variance array<double>, log_likelihood double, shocks array<double>", target_col, id_col, time_col)


def garch_forecast(model: DataFrame, horizon: int, id_col: str = ID, compat: bool = False) -> DataFrame:
    """id, step, variance. Known shocks enter as squared residuals; ``compat``
    takes variances in their place."""

    @F.pandas_udf("array<double>")
    def ahead(omega: pd.Series, alpha: pd.Series, beta: pd.Series, path: pd.Series, shocks: pd.Series) -> pd.Series:
        out = []
        for o, a, b, s, e in zip(omega, alpha, beta, path, shocks):
            s, e = list(s), list(s if compat else e)
            for _ in range(horizon):
                new = o + sum(x * e[-i] for i, x in enumerate(a, 1) if i <= len(e)) + sum(x * s[-j] for j, x in enumerate(b, 1) if j <= len(s))
                s.append(new)
                e.append(new)
            out.append(s[-horizon:])
        return pd.Series(out)

    rows = model.select(id_col, F.posexplode(ahead("omega", "alpha", "beta", "conditional_variance", "shocks")).alias("k", "variance"))
    return rows.select(id_col, (F.col("k") + 1).cast("long").alias("step"), "variance")


# -- vector autoregression -------------------------------------------------


@dataclass
class VARResult:
    """``coefficients``: targets by (lags times targets, intercept last)."""

    coefficients: np.ndarray
    target_cols: list[str]
    p: int
    sigma: np.ndarray
    last_values: np.ndarray


def _lagged(df: DataFrame, target_cols: list[str], p: int, time_col: str, chunk: int | None = None) -> DataFrame:
    """A wide frame is one series: its rows are numbered by ranges of the time (rows
    of one time by their values) and looked back upon in chunks with halo rows."""
    rows = df.select(time_col, *[F.col(c).cast("double").alias(c) for c in target_cols])
    return lagged(rows, target_cols, p, [time_col, *target_cols], chunk)


def _lags(target_cols: list[str], p: int) -> list[str]:
    return [f"__{c}_{k}" for k in range(1, p + 1) for c in target_cols]


def _moments(rows: DataFrame, x: list[str], y: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """X'X, X'Y, Y'Y and n, summed by Spark."""
    terms = [F.col(f"`{c}`") for c in x] + [F.lit(1.0)]
    out = [F.col(f"`{c}`") for c in y]
    cells = [a * b for a in terms for b in terms] + [a * b for a in terms for b in out] + [a * b for a in out for b in out]
    got = rows.agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in cells], F.count(F.lit(1))).first()
    n, m = len(terms), len(out)
    v = np.array(got[:-1], float)
    return v[: n * n].reshape(n, n), v[n * n : n * n + n * m].reshape(n, m), v[n * n + n * m :].reshape(m, m), int(got[-1])


def _solved(xx: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """Normal equations solved at one scale: beside sums of large squares the intercept's
    count would pass for a direction without any data."""
    size = np.sqrt(np.maximum(np.diag(xx), 0))
    scale = 1 / np.where(size > 0, size, 1)
    return scale[:, None] * np.linalg.lstsq(xx * np.outer(scale, scale), scale[:, None] * xy, rcond=None)[0]


def last_rows(df: DataFrame, target_cols: list[str], p: int, time_col: str) -> np.ndarray:
    """The values of the last p rows in the order of ``_lagged``."""
    order = [F.col(c).desc() for c in (time_col, *target_cols)]
    last = df.select(time_col, *[F.col(c).cast("double").alias(c) for c in target_cols]).orderBy(*order).limit(p).collect()
    return np.array([[np.nan if r[c] is None else r[c] for c in target_cols] for r in reversed(last)], float)


def var_fit(df: DataFrame, target_cols: list[str], p: int = 1, time_col: str = TIME, chunk: int | None = None) -> VARResult:
    """Least squares from moments that Spark sums over all rows; a row counts when
    its time, its targets and all its lags are there."""
    ensure(p > 0 and len(target_cols) > 0, "p and target_cols are needed")
    rows = _lagged(df, target_cols, p, time_col, chunk).na.drop()
    xx, xy, yy, n = _moments(rows, _lags(target_cols, p), target_cols)
    ensure(n > 0, "too few rows")
    b = _solved(xx, xy)
    return VARResult(b.T, target_cols, p, (yy - b.T @ xy) / max(n - len(xx), 1), last_rows(df, target_cols, p, time_col))


def var_forecast(model: VARResult, horizon: int, spark, time_col: str = TIME) -> DataFrame:
    """The time column counts the steps from 1."""
    values = list(model.last_values)
    for _ in range(horizon):
        x = np.concatenate([*[values[-k] for k in range(1, model.p + 1)], [1.0]])
        values.append(model.coefficients @ x)
    rows = [(k + 1, *map(float, v)) for k, v in enumerate(values[-horizon:])]
    return spark.createDataFrame(rows, f"`{time_col}` long, " + ", ".join(f"`{c}` double" for c in model.target_cols))


def granger_causality(df: DataFrame, cause_col: str, effect_col: str, max_lag: int = 5, time_col: str = TIME, chunk: int | None = None) -> DataFrame:
    """lag, f_statistic, p_value of the F test that the cause's lags help. Rows are
    numbered once and lagged for all tests."""
    out = []
    every = _lagged(df, [effect_col, cause_col], max_lag, time_col, chunk)
    for lag in range(1, max_lag + 1):
        rows = every.na.drop(subset=[time_col, effect_col, cause_col, *_lags([effect_col, cause_col], lag)])
        own, causes = _lags([effect_col], lag), _lags([cause_col], lag)
        xx, xy, yy, n = _moments(rows, own + causes, [effect_col])
        sums = []
        for use in ([*range(lag), 2 * lag], [*range(2 * lag + 1)]):
            b = _solved(xx[np.ix_(use, use)], xy[use])
            sums.append(float((yy - b.T @ xy[use])[0, 0]))
        free = n - 2 * lag - 1
        if free <= 0:
            break
        f = (sums[0] - sums[1]) / lag / max(sums[1] / free, 1e-300)
        out.append((lag, float(f), float(f_sf(f, lag, free))))
    return df.sparkSession.createDataFrame(out, "lag long, f_statistic double, p_value double")


# -- anomalies -------------------------------------------------------------


def bayesian_anomaly_score(df: DataFrame, threshold: float = 0.01, prior_mu: float | None = None, prior_kappa: float = 1.0, prior_alpha: float = 2.0, prior_beta: float = 1.0, warmup: int = 10, anomaly_scale: float = 10.0, id_col: str = ID, target_col: str = Y, time_col: str = TIME) -> DataFrame:
    """p_value of each value under a normal-inverse-gamma predictive that learns
    along the series, the Bayes factor against a wider one, and is_anomaly."""

    def kernel(_, times, v):
        mu = v[0] if prior_mu is None and len(v) else (prior_mu or 0.0)
        kappa, alpha, beta = prior_kappa, prior_alpha, prior_beta
        p, bf = [], []
        for i, x in enumerate(v):
            if x != x:
                p.append(1.0)
                bf.append(0.0)
                continue
            scale = float(np.sqrt(beta * (kappa + 1) / (alpha * kappa)))
            z = (x - mu) / scale
            p.append(1.0 if i < warmup else 2 * (1 - student_t_cdf(abs(z), 2 * alpha)))
            wide, near = student_t_logpdf(x, 2 * alpha, mu, scale * anomaly_scale), student_t_logpdf(x, 2 * alpha, mu, scale)
            bf.append(0.0 if i < warmup else float(np.exp(np.clip(wide - near, -700, 700))))
            beta += kappa * (x - mu) ** 2 / (2 * (kappa + 1))
            mu, kappa, alpha = (kappa * mu + x) / (kappa + 1), kappa + 1, alpha + 0.5
        return {time_col: times, target_col: v, "p_value": p, "bayes_factor": bf, "is_anomaly": [x < threshold for x in p]}

    return map_series(df, kernel, f"`{time_col}` {type_of(df, time_col)}, `{target_col}` double, p_value double, bayes_factor double, is_anomaly boolean", target_col, id_col, time_col)


class BayesianAnomalyDetector:
    def __init__(self, **options):
        self.options = options

    def score(self, df: DataFrame) -> DataFrame:
        return bayesian_anomaly_score(df, **self.options)


def _isolation_trees(x: np.ndarray, n_trees: int, size: int, seed: int) -> tuple[list, float]:
    rng = np.random.default_rng(seed)
    size = min(size, len(x))
    depth = int(np.ceil(np.log2(max(size, 2))))

    def grow(rows, level):
        if level >= depth or len(rows) <= 1:
            return len(rows)
        spread = np.flatnonzero(rows.max(0) > rows.min(0))
        if not len(spread):
            return len(rows)
        f = int(rng.choice(spread))
        cut = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
        left = rows[:, f] < cut
        return (f, cut, grow(rows[left], level + 1), grow(rows[~left], level + 1))

    return [grow(x[rng.choice(len(x), size, replace=False)], 0) for _ in range(n_trees)], _mean_path(size)


def _mean_path(n: int) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _isolation_score(x: np.ndarray, trees: list, norm: float) -> np.ndarray:
    total = np.zeros(len(x))

    def walk(node, rows, level):
        if not isinstance(node, tuple):
            total[rows] += level + _mean_path(node)
            return
        f, cut, left, right = node
        low = x[rows, f] < cut
        walk(left, rows[low], level + 1)
        walk(right, rows[~low], level + 1)

    for t in trees:
        walk(t, np.arange(len(x)), 0)
    return 2.0 ** (-total / len(trees) / max(norm, 1e-12))


def isolation_forest_detect(df: DataFrame, feature_cols: list[str], id_col: str = ID, time_col: str = TIME, contamination: float = 0.05, global_model: bool = True, seed: int = 42, n_trees: int = 100, sample_size: int = 256) -> DataFrame:
    """anomaly_score (higher is odder) and is_anomaly for the top share of rows.
    Global trees grow on a bounded hash sample and are sent to the tasks."""
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in feature_cols])
    if global_model:
        sample = df.select(x.alias("x")).orderBy(F.xxhash64(F.lit(seed), "x")).limit(n_trees * sample_size).toPandas()
        trees, norm = _isolation_trees(np.stack(sample["x"].to_numpy()), n_trees, sample_size, seed)

        @F.pandas_udf("double")
        def score(v: pd.Series) -> pd.Series:
            return pd.Series(_isolation_score(np.stack(v.to_numpy()), trees, norm)) if len(v) else pd.Series([], dtype=float)

        out = df.withColumn("anomaly_score", score(x))
    else:

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            v = np.stack(pdf["__x"].to_numpy())
            pdf["anomaly_score"] = 0.0 if len(v) < 2 else _isolation_score(v, *_isolation_trees(v, n_trees, sample_size, seed))
            return pdf.drop(columns="__x")

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        out = df.withColumn("__x", x).groupBy(id_col).applyInPandas(run, f"{kinds}, anomaly_score double")
    cut = out.agg(F.percentile_approx("anomaly_score", 1 - contamination, 10_000).alias("__cut"))
    return out.crossJoin(F.broadcast(cut)).withColumn("is_anomaly", F.col("anomaly_score") > F.col("__cut")).drop("__cut")

"""Bayesian state-space operators per series, and causal effects."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.statespace import BSTS, BayesianVAR, GaussianProcess, KalmanFilter, ParticleFilter, bayesian_ets_series, mcmc_series
from tidepanel.functions.stats import normal_quantile, simplex_quadratic
from tidepanel.panel import ID, TIME, Y, ensure, future_times, map_series, type_of


def kalman_filter(df: DataFrame, F_, H, Q, R, x0=None, P0=None, smooth: bool = True, id_col: str = ID, target_col: str = Y, time_col: str = TIME) -> DataFrame:
    """Per row: filtered (and smoothed) state and its variances as arrays."""

    def kernel(_, times, v):
        kf = KalmanFilter(F_, H, Q, R, x0, P0)
        r = kf.smooth(v) if smooth else kf.filter(v)
        s, c = (r.smoothed_states, r.smoothed_covs) if smooth else (r.filtered_states, r.filtered_covs)
        return {time_col: times, "state": r.filtered_states.tolist(), "variance": [np.diag(p).tolist() for p in r.filtered_covs], "smoothed_state": s.tolist(), "smoothed_variance": [np.diag(p).tolist() for p in c], "log_likelihood": r.log_likelihood}

    return map_series(df, kernel, f"`{time_col}` {type_of(df, time_col)}, state array<double>, variance array<double>, smoothed_state array<double>, smoothed_variance array<double>, log_likelihood double", target_col, id_col, time_col)


def bsts_fit(df: DataFrame, id_col: str = ID, target_col: str = Y, time_col: str = TIME, **options) -> DataFrame:
    def kernel(_, times, v):
        m = BSTS(**options).fit(v)
        return {time_col: times, "level": m.level, "trend": m.trend, "seasonal": m.seasonal}

    return map_series(df, kernel, f"`{time_col}` {type_of(df, time_col)}, level double, trend double, seasonal double", target_col, id_col, time_col)


def _forecast(df: DataFrame, fn, id_col: str, target_col: str, time_col: str, h: int) -> DataFrame:
    def kernel(_, times, v):
        v = v[~np.isnan(v)]
        return {time_col: future_times(times, h), **fn(v)} if len(v) > 2 else None

    return map_series(df, kernel, f"`{time_col}` {type_of(df, time_col)}, y_hat double, y_hat_lower double, y_hat_upper double", target_col, id_col, time_col)


def bsts_forecast(df: DataFrame, h: int, coverage: float = 0.9, id_col: str = ID, target_col: str = Y, time_col: str = TIME, **options) -> DataFrame:
    z = normal_quantile(0.5 + coverage / 2)

    def fn(v):
        m, var = BSTS(**options).fit(v).forecast(h)
        return {"y_hat": m, "y_hat_lower": m - z * np.sqrt(var), "y_hat_upper": m + z * np.sqrt(var)}

    return _forecast(df, fn, id_col, target_col, time_col, h)


def particle_filter(df: DataFrame, transition_fn=None, observation_loglik=None, n_particles: int = 1000, resample_method: str = "systematic", resample_threshold: float = 0.5, seed: int = 42, id_col: str = ID, target_col: str = Y, time_col: str = TIME) -> DataFrame:
    def kernel(_, times, v):
        r = ParticleFilter(n_particles, transition_fn, observation_loglik, resample_method, resample_threshold, seed).filter(v)
        return {time_col: times, "filtered_mean": r.filtered_mean, "filtered_var": r.filtered_var, "ess": r.ess}

    return map_series(df, kernel, f"`{time_col}` {type_of(df, time_col)}, filtered_mean double, filtered_var double, ess double", target_col, id_col, time_col)


def particle_smoother(df: DataFrame, transition_fn=None, observation_loglik=None, density=None, n_particles: int = 1000, paths: int = 200, resample_method: str = "systematic", resample_threshold: float = 0.5, seed: int = 42, id_col: str = ID, target_col: str = Y, time_col: str = TIME) -> DataFrame:
    """smoothed_mean and smoothed_var of every row, from backward simulation through
    the filter's history: what the whole series says of each state."""
    from tidepanel.functions.statespace import local_level_density

    def kernel(_, times, v):
        r = ParticleFilter(n_particles, transition_fn, observation_loglik, resample_method, resample_threshold, seed, store_history=True).filter(v)
        drawn = r.smoothed_paths(density or local_level_density(), paths, seed)
        return {time_col: times, "smoothed_mean": drawn.mean(1), "smoothed_var": drawn.var(1)}

    return map_series(df, kernel, f"`{time_col}` {type_of(df, time_col)}, smoothed_mean double, smoothed_var double", target_col, id_col, time_col)


def gp_forecast(df: DataFrame, h: int, kernel: str = "rbf", optimize: bool = True, noise_var: float = 0.1, coverage: float = 0.9, id_col: str = ID, target_col: str = Y, time_col: str = TIME) -> DataFrame:
    z = normal_quantile(0.5 + coverage / 2)

    def fn(v):
        m, s = GaussianProcess(kernel, optimize, noise_var).fit(v).predict(h)
        return {"y_hat": m, "y_hat_lower": m - z * s, "y_hat_upper": m + z * s}

    return _forecast(df, fn, id_col, target_col, time_col, h)


def mcmc_forecast(df: DataFrame, h: int, model: str = "local_level", backend: str = "builtin", id_col: str = ID, target_col: str = Y, time_col: str = TIME, **options) -> DataFrame:
    if backend != "builtin":
        import importlib

        try:
            importlib.import_module(backend)
        except ImportError as e:
            raise ImportError(f"the {backend} backend needs the package {backend}") from e
        raise NotImplementedError(f"the {backend} backend is not built in here; use backend='builtin'")

    def fn(v):
        r = mcmc_series(v, h, model, **options)
        return {"y_hat": r.point_forecast, "y_hat_lower": r.lower, "y_hat_upper": r.upper}

    return _forecast(df, fn, id_col, target_col, time_col, h)


def bayesian_ets(df: DataFrame, h: int, model: str = "ses", inference: str = "map", id_col: str = ID, target_col: str = Y, time_col: str = TIME, **options) -> DataFrame:
    ensure(model in ("ses", "holt", "holt_winters"), f"unknown model {model!r}")
    return _forecast(df, lambda v: bayesian_ets_series(v, h, model, inference, **options), id_col, target_col, time_col, h)


class _PerSeries:
    """Fit keeps the frame; predict runs the function over its series."""

    def __init__(self, **options):
        self.options = options

    def fit(self, df: DataFrame):
        self.df_ = df
        return self


class GaussianProcessTS(_PerSeries):
    def predict(self, h: int) -> DataFrame:
        return gp_forecast(self.df_, h, **self.options)


class MCMCForecaster(_PerSeries):
    def predict(self, h: int) -> DataFrame:
        return mcmc_forecast(self.df_, h, **self.options)


class BayesianETS(_PerSeries):
    def predict(self, h: int) -> DataFrame:
        return bayesian_ets(self.df_, h, **self.options)


def bayesian_var(df: DataFrame, target_cols: list[str], horizon: int, p: int = 1, time_col: str = TIME, **options) -> DataFrame:
    """step and, per target, mean, lower and upper."""
    from tidepanel.operators.changepoint import _lagged, _lags, _moments, last_rows

    rows = _lagged(df, target_cols, p, time_col).na.drop()
    xx, xy, yy, n = _moments(rows, _lags(target_cols, p), target_cols)
    got = BayesianVAR(target_cols, p, **options).fit_moments(xx, xy, yy, n, last_rows(df, target_cols, p, time_col)).predict(horizon)
    out = [(k + 1, *[float(got[part][k, j]) for j in range(len(target_cols)) for part in ("mean", "lower", "upper")]) for k in range(horizon)]
    return df.sparkSession.createDataFrame(out, "step long, " + ", ".join(f"`{c}` double, `{c}_lower` double, `{c}_upper` double" for c in target_cols))


# -- causal effects --------------------------------------------------------

_EFFECT = "y double, counterfactual double, counterfactual_lower double, counterfactual_upper double, point_effect double, point_effect_lower double, point_effect_upper double, cumulative_effect double"


def impact_of(v: np.ndarray, n_pre: int, x: np.ndarray | None, coverage: float, options: dict, always: np.ndarray | None = None) -> dict:
    """Counterfactual of everything after the first n_pre values. All columns of
    ``x``, less their means before, explain the values before; those that are
    ``always`` (a mask, all by default) move the counterfactual too."""
    base = np.zeros(len(v))
    if x is not None and x.shape[1]:
        always = np.ones(x.shape[1], bool) if always is None else always
        bare_x = x - x[:n_pre].mean(0)
        beta = np.linalg.lstsq(bare_x[:n_pre], v[:n_pre] - v[:n_pre].mean(), rcond=None)[0]
        base[:n_pre] = bare_x[:n_pre] @ beta
        base[n_pre:] = bare_x[n_pre:][:, always] @ beta[always]
    bare = v - base
    scale = bare[:n_pre].std() or 1.0
    mean, var = BSTS(**options).fit(bare[:n_pre] / scale).forecast(len(v) - n_pre)
    mean, sd = mean * scale + base[n_pre:], np.sqrt(var) * scale
    z = normal_quantile(0.5 + coverage / 2)
    effect = v[n_pre:] - mean
    return {"y": v[n_pre:], "counterfactual": mean, "counterfactual_lower": mean - z * sd, "counterfactual_upper": mean + z * sd, "point_effect": effect, "point_effect_lower": effect - z * sd, "point_effect_upper": effect + z * sd, "cumulative_effect": np.cumsum(effect)}


def covariate_roles(covariates: list[str], given: dict[str, str] | None) -> dict[str, str]:
    """The role of every covariate, ``always`` where none is given, with a warning:
    what the intervention itself moves would hide its effect."""
    roles = {c: (given or {}).get(c, "always") for c in covariates}
    ensure(set(roles.values()) <= {"always", "pre_only"}, "a covariate_role is always or pre_only")
    if missing := [c for c in covariates if c not in (given or {})]:
        warnings.warn(f"no covariate_role for {', '.join(missing)}: 'always', which biases the effect if the intervention moves them", UserWarning, stacklevel=3)
    elif covariates and set(roles.values()) == {"always"}:
        warnings.warn("All covariates are 'always'; see that the intervention does not move any of them", UserWarning, stacklevel=3)
    return roles


def _cut(times, when) -> int:
    return int(np.searchsorted(pd.to_datetime(pd.Series(times)).to_numpy() if not np.issubdtype(np.asarray(times).dtype, np.number) else times, pd.Timestamp(when).to_datetime64() if not isinstance(when, (int, float)) else when))


class CausalImpact:
    """Effect of an intervention on every series against a structural forecast
    from before it, with optional covariates: ``pre_only`` ones help to explain the
    time before, ``always`` ones move the counterfactual after it too."""

    def __init__(self, trend: str = "local_linear", seasonal: int | None = None, sigma_obs: float = 1.0, sigma_level: float = 0.1, sigma_trend: float = 0.01, sigma_seasonal: float = 0.01, coverage: float = 0.9, covariates: list[str] | None = None, id_col: str = ID, time_col: str = TIME, target_col: str = Y, covariate_role: dict[str, str] | None = None):
        self.covariate_role = covariate_role
        self.model = dict(trend=trend, seasonal=seasonal, sigma_obs=sigma_obs, sigma_level=sigma_level, sigma_trend=sigma_trend, sigma_seasonal=sigma_seasonal)
        self.coverage, self.covariates, self.cols = coverage, covariates or [], (id_col, time_col, target_col)

    def fit(self, df: DataFrame, intervention_date) -> CausalImpact:
        missing = [c for c in self.covariates if c not in df.columns]
        ensure(not missing, f"covariates not found: {', '.join(missing)}")
        self.roles_ = covariate_roles(self.covariates, self.covariate_role)
        if self.covariates:
            gaps = df.filter(F.col(self.cols[1]) < F.lit(intervention_date)).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in self.covariates]).first()
            ensure(not any(gaps), f"covariates have missing values before the intervention: {', '.join(c for c in self.covariates if gaps[c])}")
        self.df_, self.when_ = df, intervention_date
        return self

    def _run(self, when) -> DataFrame:
        id_col, time_col, target_col = self.cols
        model, coverage, covariates = self.model, self.coverage, self.covariates
        always = np.array([self.roles_[c] == "always" for c in covariates], bool)

        def kernel(_, times, v, extra=None):
            n = _cut(times, when)
            if n < 3 or n >= len(v):
                return None
            x = np.column_stack([extra[c].astype(float) for c in covariates]) if covariates else None
            return {time_col: times[n:], **impact_of(v, n, x, coverage, model, always)}

        return map_series(self.df_, kernel, f"`{time_col}` {type_of(self.df_, time_col)}, {_EFFECT}", target_col, id_col, time_col, extra=covariates or None)

    def to_frame(self) -> DataFrame:
        return self._run(self.when_)

    def summary(self) -> DataFrame:
        i = self.cols[0]
        f = self.to_frame().groupBy(i).agg(F.sum("point_effect").alias("total_effect"), F.sum("point_effect_lower").alias("total_effect_lower"), F.sum("point_effect_upper").alias("total_effect_upper"), F.sum("counterfactual").alias("c"))
        return f.withColumn("relative_effect", F.try_divide("total_effect", "c")).drop("c")

    results = to_frame

    def placebo_test(self, placebo_date) -> DataFrame:
        """The summary of a made-up intervention before the real one."""
        own = CausalImpact(coverage=self.coverage, covariates=self.covariates, covariate_role=self.roles_, id_col=self.cols[0], time_col=self.cols[1], target_col=self.cols[2], **self.model)
        return own.fit(self.df_.filter(F.col(self.cols[1]) < F.lit(self.when_)), placebo_date).summary()


def causal_impact(df: DataFrame, intervention_date, **options) -> DataFrame:
    return CausalImpact(**options).fit(df, intervention_date).to_frame()


class SyntheticControl:
    """Simplex weights of donors that follow the treated series before the
    intervention. Donors meet on their times; their gram matrix is aggregated
    by Spark, so only numbers of donor pairs reach the driver.

    Covariates are matched beside the target, each scaled to the spread of the
    treated target before the intervention; the moments of all these blocks are
    summed. After it, ``always`` covariates add what the treated series has of them
    beyond its synthetic one; ``pre_only`` ones serve the matching alone. Donors
    whose times are not those of the treated series are left out."""

    def __init__(self, coverage: float = 0.9, id_col: str = ID, time_col: str = TIME, target_col: str = Y, covariates: list[str] | None = None, covariate_role: dict[str, str] | None = None):
        self.coverage, self.cols, self.covariates, self.covariate_role = coverage, (id_col, time_col, target_col), covariates or [], covariate_role

    def fit(self, df: DataFrame, treated_id, intervention_date, donor_ids: list | None = None) -> SyntheticControl:
        i, ds, y = self.cols
        missing = [c for c in self.covariates if c not in df.columns]
        ensure(not missing, f"covariates not found: {', '.join(missing)}")
        self.roles_ = covariate_roles(self.covariates, self.covariate_role)
        blocks = range(1 + len(self.covariates))
        held = df.select(F.col(i).alias("d"), ds, *[F.col(c).cast("double").alias(f"v{k}") for k, c in enumerate([y, *self.covariates])])
        t = held.filter(F.col("d") == treated_id).select(ds, *[F.col(f"v{k}").alias(f"t{k}") for k in blocks])
        pre = F.col(ds) < F.lit(intervention_date)
        known = t.agg(F.count("*").alias("n"), F.count_if(pre).alias("pre"), *[F.stddev_pop(F.when(pre, F.col(f"t{k}"))).alias(f"s{k}") for k in blocks], *[F.count_if(pre & F.col(f"t{k}").isNull()).alias(f"gaps{k}") for k in blocks]).first()
        ensure(known["n"] > 0, f"{treated_id!r} is not in the data")
        ensure(known["pre"] > 1 and known["pre"] < known["n"], "two times before the intervention and one after it are needed")
        holes = [c for k, c in enumerate([y, *self.covariates]) if known[f"gaps{k}"]]
        ensure(not holes, f"missing values before the intervention: {', '.join(holes)}")
        scale = [1.0] + [known["s0"] / known[f"s{k}"] if known[f"s{k}"] > 1e-10 else 1.0 for k in blocks[1:]]
        donors = held.filter(F.col("d") != treated_id)
        donors = donors.filter(F.col("d").isin(donor_ids)) if donor_ids is not None else donors
        both = donors.join(t.select(F.col(ds).alias("__at")), donors[ds] == F.col("__at"), "left")
        same = both.groupBy("d").agg(F.count("*").alias("n"), F.count_distinct("__at").alias("m")).filter((F.col("n") == known["n"]) & (F.col("m") == known["n"]))
        donors = donors.join(same.select("d"), "d", "left_semi")
        a, b = donors.filter(pre), donors.filter(pre).select(F.col("d").alias("d2"), ds, *[F.col(f"v{k}").alias(f"o{k}") for k in blocks])
        product = lambda left, right: sum((F.col(f"{left}{k}") * F.col(f"{right}{k}") * float(scale[k] ** 2) for k in blocks), F.lit(0.0))
        gram = a.join(b, ds).groupBy("d", "d2").agg(F.sum(product("v", "o")).alias("g")).toPandas()
        lin = a.join(t, ds).groupBy("d").agg(F.sum(product("v", "t")).alias("l"), F.count("*").alias("n")).toPandas()
        ensure(len(lin) > 0, "no donors share times with the treated series")
        self.donor_ids_ = sorted(lin["d"])
        g = gram.pivot(index="d", columns="d2", values="g").loc[self.donor_ids_, self.donor_ids_].fillna(0).to_numpy()
        self.weights_ = simplex_quadratic(g, lin.set_index("d").loc[self.donor_ids_, "l"].to_numpy())
        w = df.sparkSession.createDataFrame([(d, float(x)) for d, x in zip(self.donor_ids_, self.weights_)], f"d {type_of(df, i)}, w double")
        fitted = donors.join(F.broadcast(w), "d").groupBy(ds).agg(*[F.sum(F.col(f"v{k}") * F.col("w")).alias(f"c{k}") for k in blocks]).join(t, ds)
        gap = F.when(pre, F.col("t0") - F.col("c0"))
        spread = fitted.agg(F.stddev_samp(gap).alias("s"), F.sqrt(F.avg(gap * gap)).alias("r"), *[F.avg(F.when(pre, F.col(f"{x}{k}"))).alias(f"{x}{k}") for k in blocks[1:] for x in ("t", "c")]).first()
        self.pre_rmse_, z = spread.r, normal_quantile(0.5 + self.coverage / 2)
        rows = [(c, spread[f"t{k}"], spread[f"c{k}"], abs(spread[f"t{k}"] - spread[f"c{k}"])) for k, c in enumerate(self.covariates, 1)]
        self.balance_ = df.sparkSession.createDataFrame(rows, "covariate string, treated_mean double, synthetic_mean double, abs_diff double") if rows else None
        from pyspark.sql import Window

        moved = F.col("c0")
        for k, c in enumerate(self.covariates, 1):
            moved = moved + (F.col(f"t{k}") - F.col(f"c{k}")) if self.roles_[c] == "always" else moved
        post = fitted.filter(~pre).select(ds, F.col("t0").alias("y"), moved.alias("counterfactual")).withColumn("k", F.row_number().over(Window.orderBy(ds)))
        width = F.sqrt("k") * float((spread.s or 0.0) * z)
        self.frame_ = post.select(ds, "y", "counterfactual", (F.col("counterfactual") - width).alias("counterfactual_lower"), (F.col("counterfactual") + width).alias("counterfactual_upper"), (F.col("y") - F.col("counterfactual")).alias("point_effect"))
        self.df_, self.treated_, self.when_ = df, treated_id, intervention_date
        return self

    def to_frame(self) -> DataFrame:
        return self.frame_

    def result(self) -> dict:
        return {"treated_id": self.treated_, "weights": dict(zip(self.donor_ids_, map(float, self.weights_))), "pre_rmse": self.pre_rmse_}

    def placebo_test(self, donors: int = 5) -> list[dict]:
        """Post to pre error of the treated series and of some donors in its place."""
        out = []
        for unit in [self.treated_, *self.donor_ids_[:donors]]:
            own = self if unit == self.treated_ else SyntheticControl(self.coverage, *self.cols, self.covariates, self.roles_).fit(self.df_.filter(F.col(self.cols[0]) != self.treated_), unit, self.when_)
            post = own.frame_.agg(F.sqrt(F.avg(F.col("point_effect") ** 2)).alias("r")).first().r
            out.append({"unit": unit, "pre_rmse": own.pre_rmse_, "post_rmse": post, "ratio": post / max(own.pre_rmse_, 1e-12)})
        return out


def synthetic_control(df: DataFrame, treated_id, intervention_date, donor_ids: list | None = None, **options) -> DataFrame:
    return SyntheticControl(**options).fit(df, treated_id, intervention_date, donor_ids).to_frame()

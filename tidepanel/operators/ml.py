"""Forecasts by regression on lag, window, calendar and covariate features.

Training rows are window expressions over the whole panel. A linear model without
an estimator of its own is fitted from sums of products that Spark aggregates, at
any size; any other estimator (fit(X, y), predict(X)) gets the feature matrix on
the driver, at most ``max_rows`` rows of a seeded hash sample. Prediction runs in
one grouped kernel per series with the fitted model in its closure.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.stats import Ridge
from tidepanel.operators import features as feats
from tidepanel.operators.transforms import forward_values, inverse_step
from tidepanel.panel import ID, TIME, Y, by_time, ensure, future_times, settled, type_of


class SparkRidge:
    """Ridge regression whose normal equations Spark sums up."""

    def __init__(self, alpha: float = 1e-10):
        self.alpha = alpha

    def fit_rows(self, rows: DataFrame, x: list[str], y: str) -> SparkRidge:
        terms = [F.lit(1.0), *[F.col(f"`{c}`").cast("double") for c in x]]
        pairs = [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
        got = rows.agg(*[F.coalesce(F.sum(terms[i] * terms[j]), F.lit(0.0)) for i, j in pairs], *[F.coalesce(F.sum(t * F.col(y)), F.lit(0.0)) for t in terms]).first()
        gram = np.zeros((len(terms), len(terms)))
        for (i, j), v in zip(pairs, got):
            gram[i, j] = gram[j, i] = v
        scale = np.sqrt(np.maximum(np.diag(gram), 1e-12))
        g = gram / scale[:, None] / scale[None, :]
        beta = np.linalg.lstsq(g + self.alpha * np.diag([0.0] + [1.0] * len(x)), np.array(got[len(pairs) :], float) / scale, rcond=None)[0] / scale
        self.intercept_, self.coef_ = beta[0], beta[1:]
        return self

    def predict(self, x):
        return np.asarray(x, float) @ self.coef_ + self.intercept_


def fit_within(rows: DataFrame, x: list[str], y: str, id_col: str) -> tuple[SparkRidge, DataFrame]:
    """Least squares with one intercept for each series, as with a column for each id:
    features and target are centred within series in the sums of products, and an
    intercept is what the means leave. Returns the model of the slopes and the table
    (id, effect), from a checkpoint; nothing is as wide as there are series."""
    held = rows.select(F.col(id_col).alias("__id"), *[F.col(f"`{c}`").cast("double").alias(f"__t{j}") for j, c in enumerate([*x, y])]).na.drop(subset=[f"__t{j}" for j in range(len(x) + 1)])
    m = len(x) + 1
    per = held.groupBy("__id").agg(F.count("*").alias("n"), *[F.sum(f"__t{j}").alias(f"s{j}") for j in range(m)])
    per = settled(per)
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    sums = held.agg(*[F.coalesce(F.sum(F.col(f"__t{i}") * F.col(f"__t{j}")), F.lit(0.0)) for i, j in pairs]).first()
    means = per.agg(*[F.coalesce(F.sum(F.col(f"s{i}") * F.col(f"s{j}") / F.col("n")), F.lit(0.0)) for i, j in pairs]).first()
    gram, size = np.zeros((m, m)), np.zeros(m)
    for (i, j), a, b in zip(pairs, sums, means):
        gram[i, j] = gram[j, i] = a - b
        if i == j:
            size[i] = a
    # What does not move within any series is part of the intercepts.
    moves = np.flatnonzero(np.diag(gram)[:-1] > 1e-10 * np.maximum(size[:-1], 1e-300))
    scale = np.sqrt(np.diag(gram)[moves])
    beta = np.zeros(len(x))
    beta[moves] = np.linalg.lstsq(gram[np.ix_(moves, moves)] / scale[:, None] / scale[None, :], gram[moves, -1] / scale, rcond=None)[0] / scale
    model = SparkRidge()
    model.intercept_, model.coef_ = 0.0, beta
    effect = F.col(f"s{m - 1}")
    for j, b in enumerate(beta):
        effect = effect - F.lit(float(b)) * F.col(f"s{j}")
    return model, per.select("__id", (effect / F.col("n")).alias("__effect"))


def fit_estimator(estimator, rows: DataFrame, x: list[str], y: str, max_rows: int = 1_000_000, seed: int = 42):
    rows = rows.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in x], F.col(y).cast("double").alias(y)).na.drop()
    if estimator is None or isinstance(estimator, SparkRidge):
        return (estimator or SparkRidge()).fit_rows(rows, x, y)
    n = rows.count()
    ensure(n > 0, "no complete training rows")
    if n > max_rows:
        rows = rows.filter(F.pmod(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in x], y), F.lit(1 << 30)) < int((1 << 30) * max_rows / n))
    pdf = rows.toPandas()
    fitted = estimator.fit(pdf[x].to_numpy(), pdf[y].to_numpy())
    return estimator if fitted is None else fitted


#: How a calendar part is computed when predicting; days of the week count from
#: Monday = 1, as in training.
_PART = {
    "day_of_week": lambda t: t.isoweekday(), "day_of_month": lambda t: t.day, "day_of_year": lambda t: t.timetuple().tm_yday, "week": lambda t: t.isocalendar()[1], "week_of_year": lambda t: t.isocalendar()[1],
    "month": lambda t: t.month, "quarter": lambda t: (t.month + 2) // 3, "year": lambda t: t.year, "hour": lambda t: getattr(t, "hour", 0), "minute": lambda t: getattr(t, "minute", 0), "is_weekend": lambda t: int(t.isoweekday() >= 6),
}

_AGG = {"mean": np.mean, "sum": np.sum, "min": np.min, "max": np.max, "median": np.median, "std": lambda v: np.std(v, ddof=1) if len(v) > 1 else np.nan, "var": lambda v: np.var(v, ddof=1) if len(v) > 1 else np.nan}


def _renewed(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as new ones: both sides of a cogroup may come from one frame."""
    return df.select(*[F.col(c).alias(c) for c in columns])


class GlobalForecaster:
    """One model for all series: lags, rolling windows, calendar, Fourier terms,
    covariates, static features and an encoding of the id; predicted recursively.

    ``past_covariates`` are known up to the end of history and stay at their last
    values; ``future_covariates`` come with the future frame (0 where missing).
    Fourier terms go on counting from the length of each series, and differences
    of any order are inverted in full. With the default estimator ``onehot`` absorbs
    the ids (``fit_within``) in place of a column for each; a series that was not
    there has the mean effect."""

    absorbs_ids = True

    def __init__(self, estimator=None, lags: list[int] | None = None, rolling_windows: list[int] | None = None, rolling_aggs: list[str] | None = None, calendar: list[str] | None = None, fourier: list[tuple[float, int]] | None = None, target_transform: str | None = None, transform_kwargs: dict | None = None, encode_id: str | None = None, static_features: list[str] | None = None, past_covariates: list[str] | None = None, future_covariates: list[str] | None = None, past_covariate_lags: list[int] | None = None, target_col: str = Y, id_col: str = ID, time_col: str = TIME):
        ensure(encode_id in (None, "ordinal", "onehot"), f"unknown encode_id {encode_id!r}")
        self.estimator, self.lags, self.windows, self.aggs = estimator, sorted(lags or []), sorted(rolling_windows or []), rolling_aggs or ["mean"]
        self.calendar, self.fourier, self.transform, self.options = calendar or [], fourier or [], target_transform, transform_kwargs or {}
        self.encode_id, self.static = encode_id, static_features or []
        self.past, self.future, self.past_lags = past_covariates or [], future_covariates or [], sorted(past_covariate_lags or [1])
        self.target_col, self.id_col, self.time_col = target_col, id_col, time_col
        ensure(bool(self.lags or self.windows or self.calendar or self.fourier or self.future), "no features are configured")

    # - training rows -

    def _transformed(self, df: DataFrame) -> DataFrame:
        from tidepanel.operators import transforms as t

        y, i, ds = self.target_col, self.id_col, self.time_col
        if self.transform is None:
            return df
        if self.transform == "log":
            return t.log_transform(df, y)
        if self.transform == "boxcox":
            return t.boxcox_transform(df, self.options.get("lam", 0.0), y)
        ensure(self.transform == "difference", f"unknown transform {self.transform!r}")
        return t.difference(df, self.options.get("order", 1), self.options.get("period", 1), y, i, ds)

    def _codes(self, df: DataFrame) -> None:
        """Codes of ids and of text features, by sorted value. Static features and
        id codes are dimension tables of one row per series or value."""
        self.codes_: dict[str, dict] = {}
        for c in ([self.id_col] if self.encode_id and not self._within() else []) + [c for c in self.static if type_of(df, c) == "string"]:
            self.codes_[c] = {r[0]: k for k, r in enumerate(df.select(c).distinct().orderBy(c).collect())}

    def _within(self) -> bool:
        return self.absorbs_ids and self.encode_id == "onehot" and (self.estimator is None or isinstance(self.estimator, SparkRidge))

    def _static_columns(self) -> list[tuple[str, str, object]]:
        out = []
        if self.encode_id == "ordinal":
            out.append((f"{self.id_col}_code", self.id_col, None))
        elif self.encode_id == "onehot" and not self._within():
            out += [(f"{self.id_col}_is_{v}", self.id_col, v) for v in self.codes_[self.id_col]]
        return out + [(f"static_{c}", c, None) for c in self.static]

    def features(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        """The panel with all feature columns, and their names in order."""
        y, i, ds = self.target_col, self.id_col, self.time_col
        rows, names = df, []
        if self.lags:
            rows, names = feats.lag_features(rows, self.lags, y, i, ds), [f"{y}_lag_{k}" for k in self.lags]
        w = by_time(i, ds)
        for size in self.windows:
            # Of the rows before this one, as the value itself is to be predicted.
            frame = w.rowsBetween(-size, -1)
            for a in self.aggs:
                rows = rows.withColumn(f"{y}_rolling_{a}_{size}", F.when(F.count(y).over(frame) >= size, feats.ROLLING[a](F.col(y).cast("double"), frame)))
                names.append(f"{y}_rolling_{a}_{size}")
        if self.past:
            rows = feats.covariate_lag_features(rows, self.past, self.past_lags, i, ds)
            names += [f"{c}_lag_{k}" for c in self.past for k in self.past_lags]
        for c in self.calendar:
            rows, names = rows.withColumn(f"cal_{c}", feats.calendar_part(c, ds)), [*names, f"cal_{c}"]
        if self.fourier:
            skip = self.options.get("order", 1) * self.options.get("period", 1) if self.transform == "difference" else 0
            t = F.row_number().over(w) - 1 + skip
            for period, n in self.fourier:
                for k in range(1, n + 1):
                    for f in ("sin", "cos"):
                        rows = rows.withColumn(f"fourier_{f}_{period}_{k}".replace(".", "_"), getattr(F, f)(t * (2 * math.pi * k / period)))
                        names.append(f"fourier_{f}_{period}_{k}".replace(".", "_"))
        names += self.future
        for name, c, value in self._static_columns():
            if value is not None:
                col = (F.col(c) == F.lit(value)).cast("double")
            elif c in self.codes_:
                table = F.create_map(*[F.lit(x) for pair in self.codes_[c].items() for x in pair]) if self.codes_[c] else F.lit(None)
                col = F.coalesce(table[F.col(c)].cast("double"), F.lit(-1.0))
            else:
                col = F.col(c).cast("double")
            rows, names = rows.withColumn(name, col), [*names, name]
        return rows, names

    def fit(self, df: DataFrame) -> GlobalForecaster:
        self._codes(df)
        rows, self.names_ = self.features(self._transformed(df))
        if self._within():
            self.model_, self.effects_ = fit_within(rows, self.names_, self.target_col, self.id_col)
        else:
            self.model_ = fit_estimator(self.estimator, rows, self.names_, self.target_col)
        return self

    # - prediction -

    def _models(self) -> dict[str, object]:
        return {"y_hat": self.model_}

    def _feedback(self) -> str:
        return "y_hat"

    def predict(self, df: DataFrame, h: int, future_df: DataFrame | None = None) -> DataFrame:
        """h rows per series of ``df`` (its history)."""
        ensure(h > 0, "h must be positive")
        ensure(not self.future or future_df is not None, "future covariates need future_df")
        y, i, ds = self.target_col, self.id_col, self.time_col
        spec = {k: getattr(self, k) for k in ("lags", "windows", "aggs", "calendar", "fourier", "transform", "options", "past", "future", "past_lags", "static", "encode_id", "id_col")}
        columns, codes, models, feedback = self._static_columns(), self.codes_, self._models(), self._feedback()
        keep = list(dict.fromkeys([i, ds, y, *self.past, *self.static]))
        effects = self.effects_ if self._within() else None
        if effects is not None:
            mean = effects.agg(F.avg("__effect")).first()[0]
            df = df.select(*keep).join(effects, df[i].eqNullSafe(effects["__id"]), "left").withColumn("__effect", F.coalesce("__effect", F.lit(mean or 0.0)))
            keep.append("__effect")
        absorbed = effects is not None

        def steps(key, pdf: pd.DataFrame, ahead: pd.DataFrame | None) -> pd.DataFrame:
            pdf = pdf.sort_values(ds, kind="stable")
            raw = list(pdf[y].to_numpy(float))
            past = {c: pdf[c].to_numpy(float) for c in spec["past"]}
            # A series without future rows comes with a frame that may lack its columns.
            some = ahead is not None and len(ahead) > 0
            times = list(ahead.sort_values(ds)[ds])[:h] if some else future_times(pdf[ds].to_numpy(), h)
            given = {} if ahead is None else {c: ahead.sort_values(ds)[c].to_numpy(float) if some else np.zeros(0) for c in spec["future"]}
            fixed = []
            for _, c, value in columns:
                own = key[0] if c == spec["id_col"] else pdf[c].iloc[-1]
                fixed.append(float(own == value) if value is not None else float(codes[c].get(own, -1)) if c in codes else float(own))
            out, own_effect = [], float(pdf["__effect"].iloc[0]) if absorbed else 0.0
            for s, when in enumerate(times):
                z = forward_values(np.array(raw), spec["transform"], spec["options"])
                x = [z[-k] if k <= len(z) else 0.0 for k in spec["lags"]]
                x += [float(_AGG[a](z[-size:])) if len(z) else 0.0 for size in spec["windows"] for a in spec["aggs"]]
                # Covariates are frozen at their last values beyond the history.
                x += [v[min(len(v) - 1, len(v) + s - k)] if len(v) >= k else 0.0 for v in past.values() for k in spec["past_lags"]]
                x += [float(_PART[c](pd.Timestamp(when))) for c in spec["calendar"]]
                t = len(pdf) + s
                x += [fn(2 * math.pi * k * t / period) for period, n in spec["fourier"] for k in range(1, n + 1) for fn in (math.sin, math.cos)]
                x += [float(v[s]) if s < len(v) and v[s] == v[s] else 0.0 for v in given.values()]
                row = {name: inverse_step(own_effect + float(np.asarray(m.predict(np.array([x + fixed])))[0]), spec["transform"], spec["options"], np.array(raw)) for name, m in models.items()}
                raw.append(row[feedback])
                out.append({i: key[0], ds: when, **row, "y_hat": row[feedback]})
            return pd.DataFrame(out, columns=[i, ds, *dict.fromkeys(["y_hat", *models])])

        extra = "".join(f", `{n}` double" for n in models if n != "y_hat")
        schema = f"`{i}` {type_of(df, i)}, `{ds}` {type_of(df, ds)}, y_hat double{extra}"
        if future_df is None:

            def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
                return steps(key, pdf, None)

            return df.select(*keep).groupBy(i).applyInPandas(run, schema)

        def both(key: tuple, pdf: pd.DataFrame, ahead: pd.DataFrame) -> pd.DataFrame:
            return steps(key, pdf, ahead) if len(pdf) else pd.DataFrame({c: [] for c in [i, ds, "y_hat"]})

        return df.select(*keep).groupBy(i).cogroup(_renewed(future_df, [i, ds, *self.future]).groupBy(i)).applyInPandas(both, schema)


class ForecastPipeline(GlobalForecaster):
    """Features, a target transform and one pooled estimator."""

    def __init__(self, estimator=None, lags: list[int] | None = None, **options):
        for name in ("encode_id", "static_features"):
            ensure(options.get(name) is None, f"{name} belongs to GlobalForecaster")
        super().__init__(estimator, lags, **options)


class RecursiveForecaster(GlobalForecaster):
    """Lags (and covariates) of one pooled model, fed back step by step."""

    def __init__(self, estimator=None, lags: list[int] | None = None, past_covariates=None, future_covariates=None, past_covariate_lags=None, target_col: str = Y, id_col: str = ID, time_col: str = TIME):
        super().__init__(estimator, lags, past_covariates=past_covariates, future_covariates=future_covariates, past_covariate_lags=past_covariate_lags, target_col=target_col, id_col=id_col, time_col=time_col)


class DirectForecaster:
    """One model per horizon step; the target of step k lies k rows ahead.

    The design of step k holds lags of the target and of ``past_covariates`` (lag 1
    is the last known row) and the ``future_covariates`` of the row k ahead. When
    predicting, the k-th row after the history is the k-th of the future frame by
    time. A series whose history lacks a lag, or whose future frame a row or value,
    has a null forecast there."""

    def __init__(self, estimator_factory: Callable[[], object] | None = None, lags: list[int] | None = None, h: int = 1, target_col: str = Y, id_col: str = ID, time_col: str = TIME, past_covariates: list[str] | None = None, future_covariates: list[str] | None = None, past_covariate_lags: list[int] | None = None):
        ensure(bool(lags) and min(lags) > 0 and h > 0, "lags and h are needed")
        self.factory, self.lags, self.h = estimator_factory or SparkRidge, sorted(lags), h
        self.past, self.future, self.past_lags = past_covariates or [], future_covariates or [], sorted(past_covariate_lags or [1])
        ensure(min(self.past_lags) > 0, "past_covariate_lags must be positive")
        self.target_col, self.id_col, self.time_col = target_col, id_col, time_col

    def _known(self) -> list[str]:
        return [f"lag_{k}" for k in self.lags] + [f"{c}_lag_{k}" for c in self.past for k in self.past_lags]

    def _matrix(self, df: DataFrame) -> DataFrame:
        w = by_time(self.id_col, self.time_col)
        lags = [F.lag(self.target_col, k - 1).over(w).alias(f"lag_{k}") for k in self.lags]
        lags += [F.lag(c, k - 1).over(w).alias(f"{c}_lag_{k}") for c in self.past for k in self.past_lags]
        leads = [F.lead(c, k).over(w).alias(f"{name}_{k}") for k in range(1, self.h + 1) for c, name in [(self.target_col, "lead"), *[(c, f"{c}_lead") for c in self.future]]]
        return df.select("*", *lags, *leads)

    def fit(self, df: DataFrame) -> DirectForecaster:
        rows = self._matrix(df)
        self.models_ = [fit_estimator(self.factory(), rows, self._known() + [f"{c}_lead_{k}" for c in self.future], f"lead_{k}") for k in range(1, self.h + 1)]
        return self

    def predict(self, df: DataFrame, h: int | None = None, future_df: DataFrame | None = None) -> DataFrame:
        h = h or self.h
        ensure(h <= self.h, "fitted for fewer steps")
        ensure(not self.future or future_df is not None, "future covariates need future_df")
        i, ds, y, lags, models, future = self.id_col, self.time_col, self.target_col, self.lags, self.models_, self.future
        series = [(y, lags), *[(c, self.past_lags) for c in self.past]]

        def steps(key: tuple, pdf: pd.DataFrame, ahead: pd.DataFrame | None) -> pd.DataFrame:
            pdf = pdf.sort_values(ds, kind="stable")
            held = [v[-k] if k <= len(v) else np.nan for c, own in series for v in [pdf[c].to_numpy(float)] for k in own]
            given = np.full((h, len(future)), np.nan)
            if ahead is not None and len(ahead):
                rows = ahead.sort_values(ds, kind="stable")[future].to_numpy(float)[:h]
                given[: len(rows)] = rows
            out = []
            for k in range(h):
                x = np.array([[*held, *given[k]]], float)
                out.append(None if np.isnan(x).any() else float(np.asarray(models[k].predict(x)).ravel()[0]))
            return pd.DataFrame({i: key[0], ds: future_times(pdf[ds].to_numpy(), h), "y_hat": pd.Series(out, dtype=float)})

        keep = list(dict.fromkeys([i, ds, y, *self.past]))
        schema = f"`{i}` {type_of(df, i)}, `{ds}` {type_of(df, ds)}, y_hat double"
        if not future:

            def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
                return steps(key, pdf, None)

            found = df.select(*keep).groupBy(i).applyInPandas(run, schema)
        else:

            def both(key: tuple, pdf: pd.DataFrame, ahead: pd.DataFrame) -> pd.DataFrame:
                return steps(key, pdf, ahead) if len(pdf) else pd.DataFrame({c: [] for c in [i, ds, "y_hat"]})

            found = df.select(*keep).groupBy(i).cogroup(_renewed(future_df, [i, ds, *future]).groupBy(i)).applyInPandas(both, schema)
        return found.withColumn("y_hat", F.when(~F.isnan("y_hat"), F.col("y_hat")))


class QuantileRegressor(GlobalForecaster):
    """A model per quantile from ``estimator_factory(q)``; the one nearest to the
    median is fed back. Columns ``q_{q}``."""

    def __init__(self, estimator_factory: Callable[[float], object], quantiles: list[float], lags: list[int], target_col: str = Y, id_col: str = ID, time_col: str = TIME):
        super().__init__(None, lags, target_col=target_col, id_col=id_col, time_col=time_col)
        self.factory, self.quantiles = estimator_factory, sorted(quantiles)

    def fit(self, df: DataFrame) -> QuantileRegressor:
        self._codes(df)
        rows, self.names_ = self.features(df)
        self.models_ = {f"q_{q}": fit_estimator(self.factory(q), rows, self.names_, self.target_col) for q in self.quantiles}
        return self

    def _models(self) -> dict[str, object]:
        return self.models_

    def _feedback(self) -> str:
        return f"q_{min(self.quantiles, key=lambda q: abs(q - 0.5))}"


class PinballRegressor:
    """Linear quantile regression by iteratively reweighted least squares."""

    def __init__(self, q: float, rounds: int = 60):
        self.q, self.rounds = q, rounds

    def fit(self, x, y):
        x, y = np.column_stack([np.ones(len(x)), np.asarray(x, float)]), np.asarray(y, float)
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        for _ in range(self.rounds):
            e = y - x @ beta
            w = np.where(e >= 0, self.q, 1 - self.q) / np.maximum(np.abs(e), 1e-6)
            beta = np.linalg.lstsq((x * w[:, None]).T @ x + 1e-10 * np.eye(x.shape[1]), (x * w[:, None]).T @ y, rcond=None)[0]
        self.beta_ = beta
        return self

    def predict(self, x):
        return np.column_stack([np.ones(len(x)), np.asarray(x, float)]) @ self.beta_


def bag_weights(keys: np.ndarray, models: int, seed: int) -> np.ndarray:
    """(rows, models): how often each bootstrap model sees each row, Poisson(1) at a
    uniform number that the row's key gives, so every task knows it by itself."""
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    x = keys.astype(np.uint64)[:, None] + np.arange(1, models + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    # The constants of the splitmix64 generator.
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.searchsorted(steps, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53))


class EnbPI:
    """Ensemble batch prediction intervals: bootstrap models, out-of-bag residuals.

    Beyond ``max_rows`` rows the models are fitted on a seeded hash sample of about
    that many; the rows outside it are out of every bag, and their residuals count
    too. Absolute residuals are kept as one mergeable quantile sketch for each series
    (``sketches_``: id, sketch; from a checkpoint), built and merged by Spark: a
    state of bounded size, whose ranks are off by less than ``2.3 / sketch_k ** 0.9``
    of all residuals in 99 of 100 cases. The width of a series is its residual at the
    finite-sample rank; a series without residuals gets that of all series.
    """

    def __init__(self, estimator_factory: Callable[[], object] | None = None, n_bootstraps: int = 25, lags: list[int] | None = None, coverage: float = 0.9, target_col: str = Y, id_col: str = ID, time_col: str = TIME, seed: int = 42, max_rows: int = 200_000, sketch_k: int = 400):
        ensure(0 < coverage < 1, "coverage must be in (0, 1)")
        ensure(n_bootstraps > 0, "n_bootstraps must be positive")
        self.factory, self.n, self.coverage, self.seed, self.max_rows, self.sketch_k = estimator_factory or Ridge, n_bootstraps, coverage, seed, max_rows, sketch_k
        self.base = RecursiveForecaster(None, lags or [1], target_col=target_col, id_col=id_col, time_col=time_col)

    def _rows(self, df: DataFrame) -> DataFrame:
        """id, the row's key and its features and target; only whole rows."""
        self.base._codes(df)
        rows, self.names_ = self.base.features(df)
        i, ds, y = self.base.id_col, self.base.time_col, self.base.target_col
        key = F.xxhash64(F.lit(self.seed), F.col(i), F.col(ds))
        return rows.select(F.col(i).alias("__id"), key.alias("__key"), *[F.col(f"`{c}`").cast("double").alias(f"__x{j}") for j, c in enumerate(self.names_)], F.col(y).cast("double").alias("__y")).na.drop(subset=["__y", *[f"__x{j}" for j in range(len(self.names_))]])

    def _sketched(self, errors: DataFrame) -> DataFrame:
        """``errors`` (__id, e) as a sketch for each series."""
        return errors.groupBy("__id").agg(F.kll_sketch_agg_double("e", F.lit(self.sketch_k)).alias("sketch"))

    def _errors(self, rows: DataFrame, fitted_on: int | None) -> DataFrame:
        """(__id, e): absolute residuals against the mean of the models that did not
        see the row. ``fitted_on``: rows whose key lies below were in the sample."""
        models, seed, x = self.models_, self.seed, [f"__x{j}" for j in range(len(self.names_))]

        def run(batches):
            for pdf in batches:
                if not len(pdf):
                    continue
                each = np.stack([np.asarray(m.predict(pdf[x].to_numpy(float)), float).ravel() for m in models], axis=1)
                keys = pdf["__key"].to_numpy(np.int64)
                out = np.ones(each.shape, bool)
                if fitted_on is not None:
                    out = (bag_weights(keys.view(np.uint64), len(models), seed) == 0) | ((keys & ((1 << 30) - 1)) >= fitted_on)[:, None]
                count = out.sum(1)
                mean = np.where(out, each, 0.0).sum(1) / np.maximum(count, 1)
                yield pd.DataFrame({"__id": pdf["__id"], "e": np.abs(pdf["__y"].to_numpy(float) - mean)})[count > 0]

        return rows.mapInPandas(run, f"__id {type_of(rows, '__id')}, e double")

    def fit(self, df: DataFrame) -> EnbPI:
        rows = self._rows(df)
        n = rows.count()
        ensure(n > 0, "no complete training rows")
        bound = 1 << 30 if n <= self.max_rows else max(1, int((1 << 30) * self.max_rows / n))
        pdf = rows.filter(F.col("__key").bitwiseAND(F.lit((1 << 30) - 1)) < bound).orderBy("__key").toPandas()
        ensure(len(pdf) > 0, "no rows in the sample")
        x, y = pdf[[f"__x{j}" for j in range(len(self.names_))]].to_numpy(float), pdf["__y"].to_numpy(float)
        weights = bag_weights(pdf["__key"].to_numpy(np.int64).view(np.uint64), self.n, self.seed)
        self.models_ = []
        for b in range(self.n):
            take = np.repeat(np.arange(len(y)), weights[:, b])
            # A bag of a few rows may be empty; such a model sees all of them.
            take = take if len(take) else np.arange(len(y))
            model = self.factory()
            self.models_.append(model.fit(x[take], y[take]) or model)
        self.sketches_ = settled(self._sketched(self._errors(rows, bound)))
        return self

    def _level(self, sketch: str) -> Column:
        """The residual at rank ceil((n + 1) coverage) / n, or the next rank of a grid
        of 200 from the coverage to 1, as a sketch is asked at fixed ranks."""
        n, cells = F.kll_sketch_get_n_double(sketch), 200
        ranks = [self.coverage + (1 - self.coverage) * k / cells for k in range(cells)] + [1.0]
        wanted = F.least(F.lit(1.0), F.ceil((n + 1) * self.coverage) / n)
        at = F.ceil((wanted - self.coverage) * (cells / (1 - self.coverage)) - 1e-9).cast("int")
        values = F.kll_sketch_get_quantile_double(sketch, F.lit(ranks))
        return F.element_at(values, F.greatest(F.lit(0), F.least(F.lit(cells), at)) + 1)

    def widths(self) -> DataFrame:
        """id and the half width of its intervals."""
        return self.sketches_.select(F.col("__id").alias(self.base.id_col), self._level("sketch").alias("width"))

    def predict(self, df: DataFrame, h: int) -> DataFrame:
        models = self.models_

        class Mean:
            def predict(self, x):
                return np.mean([np.asarray(m.predict(x)) for m in models], axis=0)

        self.base.model_ = Mean()
        i = self.base.id_col
        own = self.sketches_.select(F.col("__id").alias("__own"), self._level("sketch").alias("__width"))
        every = self.sketches_.agg(F.kll_merge_agg_double("sketch", F.lit(self.sketch_k)).alias("sketch")).select(self._level("sketch").alias("w")).first()["w"]
        out = self.base.predict(df, h)
        width = F.coalesce("__width", F.lit(float(every) if every is not None else 0.0))
        out = out.join(own, out[i].eqNullSafe(own["__own"]), "left")
        return out.select(i, self.base.time_col, "y_hat", (F.col("y_hat") - width).alias("y_hat_lower"), (F.col("y_hat") + width).alias("y_hat_upper"))

    def update(self, df: DataFrame) -> EnbPI:
        """Merge in the residuals of new rows: of their ``y_hat`` where they have that
        column, else of the models (then with the history for the lags)."""
        if "y_hat" in df.columns:
            e = F.abs(F.col(self.base.target_col).cast("double") - F.col("y_hat").cast("double"))
            errors = df.select(F.col(self.base.id_col).alias("__id"), e.alias("e")).filter("e is not null")
        else:
            errors = self._errors(self._rows(df), None)
        both = self.sketches_.unionByName(self._sketched(errors))
        self.sketches_ = settled(both.groupBy("__id").agg(F.kll_merge_agg_double("sketch", F.lit(self.sketch_k)).alias("sketch")))
        return self

"""Time splits, back-testing, conformal intervals, ensembles."""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.panel import ID, TIME, Y, by_time, ensure


def fold_table(df: DataFrame, n_splits: int = 5, horizon: int = 1, step: int = 1, gap: int = 0, initial_train_size: int | None = None, fixed_train_size: int | None = None, time_col: str = TIME) -> list[dict]:
    """The train and test ranges of every fold, as times. Only the times that
    bound a fold reach the driver."""
    for name, value in (("n_splits", n_splits), ("horizon", horizon), ("step", step)):
        ensure(value > 0, f"{name} must be positive")
    ensure(gap >= 0, "gap must not be negative")
    times = df.select(F.col(time_col).alias("t")).distinct()
    n = times.count()
    first = initial_train_size or fixed_train_size or n - (n_splits - 1) * step - gap - horizon
    ensure(first >= 1 and first + gap + horizon + (n_splits - 1) * step <= n, f"{n} times are too few for the splits")
    plan, need = [], set()
    for k in range(n_splits):
        end = first + k * step
        begin = end - fixed_train_size if fixed_train_size else 0
        ensure(begin >= 0, "the training window does not fit")
        plan.append((begin, end - 1, end + gap, end + gap + horizon - 1))
        need |= set(plan[-1])
    ranked = times.withColumn("i", F.row_number().over(Window.orderBy("t")) - 1).filter(F.col("i").isin(sorted(need)))
    at = {r.i: r.t for r in ranked.collect()}
    return [{"fold": k, "train_start": at[a], "train_end": at[b], "test_start": at[c], "test_end": at[d]} for k, (a, b, c, d) in enumerate(plan)]


def _splits(df: DataFrame, folds: list[dict], time_col: str) -> Iterator[tuple[DataFrame, DataFrame]]:
    for f in folds:
        yield df.filter(F.col(time_col).between(F.lit(f["train_start"]), F.lit(f["train_end"]))), df.filter(F.col(time_col).between(F.lit(f["test_start"]), F.lit(f["test_end"])))


def expanding_window_cv(df: DataFrame, n_splits: int = 5, horizon: int = 1, step: int = 1, gap: int = 0, id_col: str = ID, time_col: str = TIME):
    return _splits(df, fold_table(df, n_splits, horizon, step, gap, time_col=time_col), time_col)


def sliding_window_cv(df: DataFrame, n_splits: int = 5, train_size: int = 10, horizon: int = 1, step: int = 1, gap: int = 0, id_col: str = ID, time_col: str = TIME):
    return _splits(df, fold_table(df, n_splits, horizon, step, gap, fixed_train_size=train_size, time_col=time_col), time_col)


def rolling_origin_cv(df: DataFrame, n_splits: int = 5, initial_train_size: int | None = None, horizon: int = 1, step: int = 1, gap: int = 0, fixed_train_size: int | None = None, id_col: str = ID, time_col: str = TIME):
    return _splits(df, fold_table(df, n_splits, horizon, step, gap, initial_train_size, fixed_train_size, time_col), time_col)


def fold_frame(df: DataFrame, folds: list[dict], time_col: str = TIME) -> DataFrame:
    """All folds as one frame with ``fold`` and ``role``: a row for each use."""
    t = F.col(time_col)
    uses = []
    for f in folds:
        uses.append(F.when(t.between(F.lit(f["train_start"]), F.lit(f["train_end"])), F.struct(F.lit(f["fold"]).alias("fold"), F.lit("train").alias("role"))))
        uses.append(F.when(t.between(F.lit(f["test_start"]), F.lit(f["test_end"])), F.struct(F.lit(f["fold"]).alias("fold"), F.lit("test").alias("role"))))
    return df.withColumn("__u", F.explode(F.filter(F.array(*uses), lambda u: u.isNotNull()))).select(*df.columns, "__u.*")


# -- back-testing ----------------------------------------------------------


def _score(metric: Callable, joined: DataFrame, actual_col: str, predicted_col: str) -> float:
    row = metric(joined, actual_col=actual_col, predicted_col=predicted_col).first()
    return float(row[0]) if row is not None and row[0] is not None else float("nan")


def backtest(model, cv, metrics: dict[str, Callable], *, h: int | None = None, actual_col: str = Y, predicted_col: str = "y_hat", id_col: str = ID, time_col: str = TIME, return_predictions: bool = False, per_horizon: bool = False) -> dict:
    """Fit and predict a copy of the model on every (train, test) pair of ``cv``.
    Gives ``fold_scores`` and ``summary`` and, on request, ``predictions`` and
    ``horizon_scores`` as DataFrames."""
    scores, parts, steps, spark = [], [], [], None
    for k, (train, test) in enumerate(cv):
        spark = train.sparkSession
        own = copy.deepcopy(model)
        fitted = own.fit(train)
        horizon = h or test.select(F.count_distinct(time_col)).first()[0]
        predicted = (fitted if fitted is not None else own).predict(train, horizon)
        joined = test.join(predicted.select(id_col, time_col, predicted_col), [id_col, time_col])
        for name, metric in metrics.items():
            scores.append((k, name, _score(metric, joined, actual_col, predicted_col)))
        if return_predictions:
            parts.append(joined.select(F.lit(k).alias("fold"), id_col, time_col, actual_col, predicted_col))
        if per_horizon:
            ranked = joined.withColumn("horizon_step", F.row_number().over(by_time(id_col, time_col)))
            for name, metric in metrics.items():
                per = metric(ranked, actual_col=actual_col, predicted_col=predicted_col, id_col="horizon_step")
                steps.append(per.select(F.lit(k).alias("fold"), F.lit(name).alias("metric"), "horizon_step", F.col(per.columns[-1]).alias("score")))
    ensure(bool(scores), "cv gave no folds")
    fold_scores = spark.createDataFrame(scores, "fold int, metric string, score double")
    out = {"fold_scores": fold_scores, "summary": fold_scores.groupBy("metric").agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"))}
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    if parts:
        out["predictions"] = union(parts)
    if steps:
        out["horizon_scores"] = union(steps)
    return out


def compare_models(models: dict[str, object], df: DataFrame, cv: Callable, cv_kwargs: dict, metrics: dict[str, Callable], **options) -> dict:
    """``comparison`` (model, metric, mean, std) and ``fold_scores`` of all models."""
    comparison, folds = None, None
    for name, model in models.items():
        got = backtest(model, cv(df, **cv_kwargs), metrics, **options)
        one, two = (got[k].withColumn("model", F.lit(name)) for k in ("summary", "fold_scores"))
        comparison = one if comparison is None else comparison.unionByName(one)
        folds = two if folds is None else folds.unionByName(two)
    return {"comparison": comparison, "fold_scores": folds}


# -- conformal intervals ---------------------------------------------------


def _array_quantile(s, level):
    """The linear quantile of a sorted array at a computed level."""
    at = (F.size(s) - 1) * level
    low = F.floor(at).cast("int")
    a, b = F.get(s, low), F.get(s, F.least(low + 1, F.size(s) - 1))
    return F.when(F.size(s) > 0, a + (b - a) * (at - low))


def conformal_interval(cal_residuals: DataFrame, predictions: DataFrame, coverage: float = 0.9, residual_col: str = "residual", predicted_col: str = "y_hat", id_col: str | None = None, symmetric: bool = True) -> DataFrame:
    """``y_hat_lower`` and ``y_hat_upper`` by split conformal quantiles, with the
    correction for finite samples; an id without residuals gets no width."""
    ensure(0 < coverage < 1, "coverage must be in (0, 1)")
    r = F.col(residual_col).cast("double")
    r = F.abs(r) if symmetric else r
    grouped = cal_residuals.groupBy(id_col) if id_col else cal_residuals.groupBy()
    s = grouped.agg(F.array_sort(F.collect_list(r)).alias("__s"))
    n, half = F.size("__s"), (1 - coverage) / 2
    up = lambda c: F.least(F.try_divide(F.ceil((n + 1) * F.lit(c)).cast("double"), n), F.lit(1.0))
    if symmetric:
        width = _array_quantile(F.col("__s"), up(coverage))
        low, high = -width, width
    else:
        down = F.greatest(F.try_divide(F.floor((n + 1) * F.lit(half)).cast("double"), n), F.lit(0.0))
        low, high = _array_quantile(F.col("__s"), down), _array_quantile(F.col("__s"), up(1 - half))
    widths = s.select(*([id_col] if id_col else []), low.alias("__low"), high.alias("__high"))
    out = predictions.join(widths, id_col, "left") if id_col else predictions.crossJoin(F.broadcast(widths))
    p = F.col(predicted_col)
    out = out.withColumn("y_hat_lower", p + F.coalesce("__low", F.lit(0.0))).withColumn("y_hat_upper", p + F.coalesce("__high", F.lit(0.0)))
    return out.drop("__low", "__high").select(*predictions.columns, "y_hat_lower", "y_hat_upper")


# -- ensembles -------------------------------------------------------------


def join_forecasts(forecasts: list[DataFrame], id_col: str = ID, time_col: str = TIME, check: bool = True) -> DataFrame:
    """``y_hat_0``, ``y_hat_1``, ... of forecasts with the same ids and times."""
    ensure(len(forecasts) >= 2, "at least two forecasts are needed")
    parts = [f.select(id_col, time_col, F.col("y_hat").alias(f"y_hat_{i}")) for i, f in enumerate(forecasts)]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, [id_col, time_col])
    if check:
        sizes = {f.count() for f in forecasts} | {out.count()}
        ensure(len(sizes) == 1, "forecasts differ in ids or times")
    return out


class WeightedEnsemble:
    """weights: "equal", "inverse_error" (needs errors) or a list of numbers."""

    def __init__(self, weights: str | list[float] = "equal", id_col: str = ID, time_col: str = TIME):
        self.weights, self.id_col, self.time_col = weights, id_col, time_col

    def numbers(self, n: int, errors: list[float] | None) -> list[float]:
        if self.weights == "equal":
            raw = [1.0] * n
        elif self.weights == "inverse_error":
            ensure(errors is not None and len(errors) == n, "inverse_error weights need one error per forecast")
            raw = [1 / max(e, 1e-12) for e in errors]
        else:
            raw = [float(w) for w in self.weights]
            ensure(len(raw) == n and min(raw) >= 0 and sum(raw) > 0, "weights must be as many as forecasts and not negative")
        return [w / sum(raw) for w in raw]

    def combine(self, forecasts: list[DataFrame], errors: list[float] | None = None, check: bool = True) -> DataFrame:
        joined = join_forecasts(forecasts, self.id_col, self.time_col, check)
        w = self.numbers(len(forecasts), errors)
        return joined.select(self.id_col, self.time_col, sum((F.col(f"y_hat_{i}") * x for i, x in enumerate(w)), F.lit(0.0)).alias("y_hat"))


class StackingForecaster:
    """A meta-learner over forecasts. Linear learners are fitted from sums of
    products that Spark aggregates; any other gets the joined rows."""

    def __init__(self, meta_learner=None, id_col: str = ID, time_col: str = TIME, target_col: str = Y):
        self.meta_learner, self.id_col, self.time_col, self.target_col = meta_learner, id_col, time_col, target_col

    def fit(self, forecasts: list[DataFrame], actuals: DataFrame) -> StackingForecaster:
        rows = join_forecasts(forecasts, self.id_col, self.time_col).join(actuals.select(self.id_col, self.time_col, self.target_col), [self.id_col, self.time_col])
        x = [f"y_hat_{i}" for i in range(len(forecasts))]
        if self.meta_learner is None:
            terms = [F.lit(1.0), *[F.col(c) for c in x]]
            gram = rows.agg(*[F.sum(a * b) for a in terms for b in terms], *[F.sum(a * F.col(self.target_col)) for a in terms]).first()
            n = len(terms)
            g = np.array(gram[: n * n], float).reshape(n, n)
            # Columns at one scale, so that a small rank cut-off treats them alike.
            scale = 1 / np.sqrt(np.maximum(np.diag(g), 1e-300))
            self.beta_ = scale * np.linalg.lstsq(g * np.outer(scale, scale), scale * np.array(gram[n * n :], float), rcond=1e-13)[0]
        else:
            pdf = rows.select(*x, self.target_col).toPandas()
            self.meta_learner.fit(pdf[x].to_numpy(float), pdf[self.target_col].to_numpy(float))
        return self

    def predict(self, forecasts: list[DataFrame]) -> DataFrame:
        rows = join_forecasts(forecasts, self.id_col, self.time_col)
        x = [f"y_hat_{i}" for i in range(len(forecasts))]
        if self.meta_learner is None:
            value = sum((F.col(c) * float(b) for c, b in zip(x, self.beta_[1:])), F.lit(float(self.beta_[0])))
        else:
            learner = self.meta_learner

            @F.pandas_udf("double")
            def predict(v):
                import pandas as pd

                return pd.Series(np.asarray(learner.predict(np.stack(v.to_numpy())), float))

            value = predict(F.array(*x))
        return rows.select(self.id_col, self.time_col, value.alias("y_hat"))

"""Online updates of the state of every series.

The same step functions serve two hosts: ``fit`` and ``partial_fit`` keep states as
a DataFrame (one row per id), and ``stream`` runs them in Structured Streaming
with one state per id in the state store.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.statespace import KalmanFilter
from tidepanel.panel import ID, TIME, Y, ensure, type_of


class StreamingETS:
    """ses, holt or holt_winters by id. A Holt-Winters series waits, with its
    values kept in the state, until it has two seasons."""

    def __init__(self, method: str = "ses", alpha: float = 0.3, beta: float = 0.1, gamma: float = 0.1, season_length: int = 7, seasonal: str = "additive", id_col: str = ID, time_col: str = TIME, target_col: str = Y):
        ensure(method in ("ses", "holt", "holt_winters"), f"unknown method {method!r}")
        self.method, self.rates, self.m, self.additive = method, (alpha, beta, gamma), season_length, seasonal == "additive"
        self.id_col, self.time_col, self.target_col = id_col, time_col, target_col
        self.states_: DataFrame | None = None

    def update(self, state: dict | None, values: list[float]) -> dict:
        """The state after more values (in time order)."""
        s = dict(state) if state else {"wait": [], "n": 0}
        a, b, g = self.rates
        need = {"ses": 1, "holt": 2, "holt_winters": 2 * self.m}[self.method]
        if "level" not in s:
            s["wait"] = s["wait"] + list(values)
            if len(s["wait"]) < need:
                return s
            w, s["wait"] = s["wait"], []
            if self.method == "ses":
                s |= {"level": w[0], "trend": 0.0, "n": 1}
                values = w[1:]
            elif self.method == "holt":
                s |= {"level": w[0], "trend": w[1] - w[0], "n": 1}
                values = w[1:]
            else:
                m = self.m
                one = sum(w[:m]) / m
                seasons = [x - one if self.additive else (x / one if one else 1.0) for x in w[:m]]
                s |= {"level": one, "trend": (sum(w[m : 2 * m]) / m - one) / m, "seasons": seasons, "n": m}
                values = w[m:]
        for y in values:
            before = s["level"]
            if self.method == "ses":
                s["level"] = a * y + (1 - a) * before
            elif self.method == "holt":
                s["level"] = a * y + (1 - a) * (before + s["trend"])
                s["trend"] = b * (s["level"] - before) + (1 - b) * s["trend"]
            else:
                k = s["n"] % self.m
                own = s["seasons"][k]
                bare = y - own if self.additive else (y / own if own else y)
                s["level"] = a * bare + (1 - a) * (before + s["trend"])
                s["trend"] = b * (s["level"] - before) + (1 - b) * s["trend"]
                new = y - s["level"] if self.additive else (y / s["level"] if s["level"] else 1.0)
                s["seasons"] = [*s["seasons"][:k], g * new + (1 - g) * own, *s["seasons"][k + 1 :]]
            s["n"] += 1
        return s

    def ahead(self, s: dict, h: int) -> list[float]:
        if "level" not in s:
            return []
        out = []
        for k in range(1, h + 1):
            base = s["level"] + (k * s["trend"] if self.method != "ses" else 0.0)
            if self.method == "holt_winters":
                season = s["seasons"][(s["n"] - 1 + k) % self.m]
                base = base + season if self.additive else base * season
            out.append(base)
        return out

    def _schema(self, df: DataFrame) -> str:
        return f"`{self.id_col}` {type_of(df, self.id_col)}, state string, last {type_of(df, self.time_col)}, step double"

    def _step(self, key: tuple, old: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(self.time_col, kind="stable")
        state, last, step = (json.loads(old["state"].iloc[0]), old["last"].iloc[0], old["step"].iloc[0]) if len(old) else (None, None, None)
        if len(pdf):
            state = self.update(state, pdf[self.target_col].dropna().astype(float).tolist())
            times = pdf[self.time_col].tolist()
            gaps = pd.Series(([last] if last is not None else []) + times).diff().dropna()
            if step is None or step != step:
                if len(gaps):
                    middle = gaps.median()
                    step = middle.total_seconds() if hasattr(middle, "total_seconds") else float(middle)
            last = times[-1]
        return pd.DataFrame({self.id_col: [key[0]], "state": [json.dumps(state)], "last": [last], "step": [step]})

    def fit(self, df: DataFrame) -> StreamingETS:
        self.states_ = None
        return self.partial_fit(df)

    def partial_fit(self, df: DataFrame) -> StreamingETS:
        """States after another batch; series not seen before start in it."""
        rows = df.select(self.id_col, self.time_col, self.target_col)
        schema, step = self._schema(df), self._bare()._step
        old = self.states_ if self.states_ is not None else df.sparkSession.createDataFrame([], schema)
        self.time_type_ = type_of(df, self.time_col)

        def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            return step(key, a, b)

        self.states_ = old.groupBy(self.id_col).cogroup(rows.groupBy(self.id_col)).applyInPandas(run, schema)
        return self

    def _bare(self) -> StreamingETS:
        own = StreamingETS.__new__(StreamingETS)
        own.__dict__ = {k: v for k, v in self.__dict__.items() if k not in ("states_", "time_type_")}
        own.states_ = None
        return own

    def predict(self, h: int) -> DataFrame:
        ensure(self.states_ is not None, "fit first")
        own, i, ds = self._bare(), self.id_col, self.time_col

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for key, state, last, step in zip(pdf[i], pdf["state"], pdf["last"], pdf["step"]):
                    for k, y in enumerate(own.ahead(json.loads(state), h), 1):
                        gap = step if step == step and step is not None else 1.0
                        when = last + pd.Timedelta(seconds=gap * k) if hasattr(last, "year") else last + gap * k
                        rows.append((key, when, float(y)))
                yield pd.DataFrame(rows, columns=[i, ds, "y_hat"])

        return self.states_.mapInPandas(run, f"`{i}` {type_of(self.states_, i)}, `{ds}` {self.time_type_}, y_hat double")

    def stream(self, rows: DataFrame) -> DataFrame:
        """On a streaming frame: after each batch, the state and the next value of
        every series that it touched (update mode)."""
        own, i, ds, y = self._bare(), self.id_col, self.time_col, self.target_col

        def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
            pdf = pd.concat(list(batches)).sort_values(ds, kind="stable")
            s = json.loads(state.get[0]) if state.exists else None
            s = own.update(s, pdf[y].dropna().astype(float).tolist())
            state.update((json.dumps(s),))
            nxt = own.ahead(s, 1)
            yield pd.DataFrame({i: [key[0]], "n_obs": [s["n"]], "level": [s.get("level")], "y_hat": [nxt[0] if nxt else None]})

        schema = f"`{i}` {type_of(rows, i)}, n_obs long, level double, y_hat double"
        return rows.select(i, ds, y).groupBy(i).applyInPandasWithState(run, schema, "state string", "update", "NoTimeout")


class StreamingKalmanFilter:
    """One series: fit, then an observation at a time; NaN is not updated on."""

    def __init__(self, F_, H, Q, R, x0=None, P0=None):
        self.kf = KalmanFilter(F_, H, Q, R, x0, P0)
        self.x, self.P = self.kf.x0, self.kf.P0

    def fit(self, values) -> StreamingKalmanFilter:
        self.x, self.P = self.kf.x0, self.kf.P0
        for v in np.asarray(values, float):
            self.update(v)
        return self

    def update(self, value) -> np.ndarray:
        _, _, self.x, self.P, _ = self.kf.step(self.x, self.P, value)
        return self.x

    def predict(self, h: int) -> tuple[np.ndarray, np.ndarray]:
        x, p, mean, var = self.x, self.P, [], []
        for _ in range(h):
            x, p = self.kf.F @ x, self.kf.F @ p @ self.kf.F.T + self.kf.Q
            mean.append((self.kf.H @ x)[0])
            var.append((self.kf.H @ p @ self.kf.H.T + self.kf.R)[0, 0])
        return np.array(mean), np.array(var)


def stream_kalman(rows: DataFrame, F_, H, Q, R, id_col: str = ID, time_col: str = TIME, target_col: str = Y) -> DataFrame:
    """The filter per id on a streaming frame: state mean and variance."""
    kf = KalmanFilter(F_, H, Q, R)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values(time_col, kind="stable")
        n = len(kf.F)
        x, p = (np.array(state.get[0]), np.array(state.get[1]).reshape(n, n)) if state.exists else (kf.x0, kf.P0)
        for v in pdf[target_col].to_numpy(float):
            _, _, x, p, _ = kf.step(x, p, v)
        state.update((x.tolist(), p.ravel().tolist()))
        yield pd.DataFrame({id_col: [key[0]], "mean": [x.tolist()], "variance": [np.diag(p).tolist()]})

    schema = f"`{id_col}` {type_of(rows, id_col)}, mean array<double>, variance array<double>"
    return rows.select(id_col, time_col, target_col).groupBy(id_col).applyInPandasWithState(run, schema, "x array<double>, p array<double>", "update", "NoTimeout")


class SlidingWindowManager:
    """The last ``window_size`` rows of every series, over batches."""

    def __init__(self, window_size: int, id_col: str = ID, time_col: str = TIME):
        ensure(window_size > 0, "window_size must be positive")
        self.window_size, self.id_col, self.time_col = window_size, id_col, time_col
        self.frame_: DataFrame | None = None

    def append(self, df: DataFrame) -> SlidingWindowManager:
        from tidepanel.panel import by_time

        rows = df if self.frame_ is None else self.frame_.unionByName(df)
        last = F.row_number().over(by_time(self.id_col, self.time_col, desc=True))
        self.frame_ = rows.withColumn("__r", last).filter(F.col("__r") <= self.window_size).drop("__r")
        return self

    def get(self, series_id) -> DataFrame:
        return self.frame_.filter(F.col(self.id_col) == series_id)

    def clear(self, series_id) -> None:
        self.frame_ = self.frame_.filter(F.col(self.id_col) != series_id)

    def clear_all(self) -> None:
        self.frame_ = None

    def series_ids(self) -> DataFrame:
        return self.frame_.select(self.id_col).distinct()


class SgdRegressor:
    """A linear model with partial_fit by gradient steps on scaled features."""

    def __init__(self, rate: float = 0.1, passes: int = 5):
        self.rate, self.passes, self.w = rate, passes, None

    def partial_fit(self, x, y):
        x, y = np.asarray(x, float), np.asarray(y, float)
        if self.w is None:
            self.mean, self.std = x.mean(0), np.maximum(x.std(0), 1e-9)
            self.ymean, self.ystd = y.mean(), max(y.std(), 1e-9)
            self.w = np.zeros(x.shape[1] + 1)
        z = np.column_stack([(x - self.mean) / self.std, np.ones(len(x))])
        t = (y - self.ymean) / self.ystd
        for _ in range(self.passes):
            self.w -= self.rate * z.T @ (z @ self.w - t) / max(len(z), 1)
        return self

    def predict(self, x):
        z = np.column_stack([(np.asarray(x, float) - self.mean) / self.std, np.ones(len(x))])
        return (z @ self.w) * self.ystd + self.ymean


class StreamingGlobalForecaster:
    """A partial_fit estimator on lags, re-trained on the window of each batch; more
    than ``max_rows`` rows come in several seeded hash parts, one after the other."""

    def __init__(self, estimator=None, lags: list[int] | None = None, window_size: int = 100, id_col: str = ID, time_col: str = TIME, target_col: str = Y, max_rows: int = 500_000):
        from tidepanel.operators.ml import RecursiveForecaster

        self.estimator, self.max_rows = estimator or SgdRegressor(), max_rows
        self.window = SlidingWindowManager(window_size, id_col, time_col)
        self.base = RecursiveForecaster(None, lags or [1], target_col=target_col, id_col=id_col, time_col=time_col)

    def partial_fit(self, df: DataFrame) -> StreamingGlobalForecaster:
        b = self.base
        self.window.append(df.select(b.id_col, b.time_col, b.target_col))
        b._codes(self.window.frame_)
        rows, names = b.features(self.window.frame_)
        rows = rows.select(*names, b.target_col).na.drop()
        parts = max(1, -(-rows.count() // self.max_rows))
        own = F.pmod(F.xxhash64(F.lit(42), *[F.col(f"`{c}`") for c in rows.columns]), F.lit(parts))
        for k in range(parts):
            pdf = (rows.filter(own == k) if parts > 1 else rows).toPandas()
            if len(pdf):
                self.estimator.partial_fit(pdf[names].to_numpy(float), pdf[b.target_col].to_numpy(float))
        return self

    fit = partial_fit

    def predict(self, h: int) -> DataFrame:
        self.base.model_ = self.estimator
        return self.base.predict(self.window.frame_, h)


def event_time_windows(rows: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes", session_gap: str | None = None, id_col: str = ID, time_col: str = TIME, target_col: str = Y) -> DataFrame:
    """Sums and counts over tumbling, sliding or session windows with a watermark;
    works on batch and streaming frames."""
    rows = rows.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late)
    w = F.session_window(time_col, session_gap) if session_gap else F.window(time_col, size, slide)
    out = rows.groupBy(id_col, w.alias("w")).agg(F.sum(target_col).alias("sum"), F.count(target_col).alias("n"))
    return out.select(id_col, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "sum", "n")


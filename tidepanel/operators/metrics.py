"""Forecast metrics, bias, calibration, diagnostics and trend statistics.

Each metric is an aggregation: one row, or one per id when ``id_col`` is given.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.stats import chi2_sf
from tidepanel.operators.rows import numbered, permutation_keys, permuted
from tidepanel.panel import ID, TIME, Y, as_series, by_time, ensure, map_series, ratio, whole


def _grouped(df: DataFrame, id_col: str | None):
    return df.groupBy(id_col) if id_col else df.groupBy()


def mae(df: DataFrame, actual_col: str = Y, predicted_col: str = "y_hat", id_col: str | None = None) -> DataFrame:
    return _grouped(df, id_col).agg(F.avg(F.abs(F.col(actual_col) - F.col(predicted_col))).alias("mae"))


def rmse(df: DataFrame, actual_col: str = Y, predicted_col: str = "y_hat", id_col: str | None = None) -> DataFrame:
    error = (F.col(actual_col) - F.col(predicted_col)).cast("double")
    return _grouped(df, id_col).agg(F.sqrt(F.avg(error * error)).alias("rmse"))


def mape(df: DataFrame, actual_col: str = Y, predicted_col: str = "y_hat", id_col: str | None = None) -> DataFrame:
    """A ratio; rows with an actual of 0 are left out."""
    error = F.abs(ratio(F.col(actual_col) - F.col(predicted_col), actual_col))
    return _grouped(df.filter(F.col(actual_col) != 0), id_col).agg(F.avg(error).alias("mape"))


def smape(df: DataFrame, actual_col: str = Y, predicted_col: str = "y_hat", id_col: str | None = None) -> DataFrame:
    """From 0 to 2; rows where both are 0 are left out."""
    size = F.abs(actual_col) + F.abs(predicted_col)
    return _grouped(df.filter(size != 0), id_col).agg(F.avg(ratio(2 * F.abs(F.col(actual_col) - F.col(predicted_col)), size)).alias("smape"))


def mase(df: DataFrame, actual_col: str = Y, predicted_col: str = "y_hat", id_col: str = ID, time_col: str = TIME, season_length: int = 1) -> DataFrame:
    y = F.col(actual_col).cast("double")
    rows = df.withColumn("__naive", F.abs(y - F.lag(y, season_length).over(by_time(id_col, time_col))))
    out = rows.groupBy(id_col).agg(F.avg(F.abs(y - F.col(predicted_col))).alias("__e"), F.avg("__naive").alias("__n"))
    value = F.when(F.col("__n") == 0, F.when(F.col("__e") == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))).otherwise(ratio("__e", "__n"))
    return out.select(id_col, value.alias("mase"))


def _quantile_columns(df: DataFrame, quantile_cols: list[str] | None, quantiles: list[float] | None) -> list[tuple[str, float]]:
    cols = quantile_cols or [c for c in df.columns if c.startswith("q_")]
    qs = quantiles or [float(c[2:]) for c in cols]
    ensure(bool(cols) and len(cols) == len(qs), "quantile columns and levels must match")
    return sorted(zip(cols, qs), key=lambda x: x[1])


def crps(df: DataFrame, actual_col: str = Y, quantile_cols: list[str] | None = None, quantiles: list[float] | None = None, id_col: str | None = None) -> DataFrame:
    """Mean pinball loss over the quantile columns, then over rows."""
    pairs = _quantile_columns(df, quantile_cols, quantiles)
    total = sum((F.greatest((F.col(actual_col) - F.col(c)) * q, (F.col(actual_col) - F.col(c)) * (q - 1)) for c, q in pairs), F.lit(0.0))
    return _grouped(df, id_col).agg(F.avg(total / len(pairs)).alias("crps"))


def block_shuffle(df: DataFrame, block_size: int, seed: int = 0, target_col: str = Y, id_col: str = ID, time_col: str = TIME) -> DataFrame:
    """Every series with its blocks of ``block_size`` rows in a seeded order."""
    rows = df.withColumn("__i", F.row_number().over(by_time(id_col, time_col)))
    rows = rows.withColumn("__block", F.floor((F.col("__i") - 1) / block_size).cast("int"))
    moved = rows.select(F.col(id_col), F.col(target_col), F.row_number().over(Window.partitionBy(id_col).orderBy(F.xxhash64(F.lit(seed), F.col(id_col), "__block"), "__block", "__i")).alias("__i"))
    return rows.drop(target_col, "__block").join(moved, [id_col, "__i"]).select(df.columns)


class Kaboudan:
    """1 - sqrt(error before / error after shuffling blocks of the history)."""

    def __init__(self, model, backtesting_start: float = 0.5, n_folds: int = 5, block_size: int = 4, seed: int = 42, id_col: str = ID, time_col: str = TIME, value_col: str = Y, modified: bool = True, agg: bool = False):
        self.model, self.start, self.n_folds, self.block_size, self.seed = model, backtesting_start, n_folds, block_size, seed
        self.id_col, self.time_col, self.value_col, self.modified, self.agg = id_col, time_col, value_col, modified, agg

    def backtest(self, df: DataFrame) -> DataFrame:
        """Squared error per id of ``model(train, horizon)`` over the folds."""
        n = df.select(self.time_col).distinct().count()
        first = int(n * self.start)
        horizon = max(1, (n - first) // self.n_folds)
        ranked = df.withColumn("__t", F.row_number().over(by_time(self.id_col, self.time_col)))
        out = None
        for k in range(self.n_folds):
            end = first + k * horizon
            train = ranked.filter(F.col("__t") <= end).drop("__t")
            test = ranked.filter((F.col("__t") > end) & (F.col("__t") <= end + horizon)).withColumn("__k", F.col("__t") - end)
            pred = self.model(train, horizon)
            pred = pred.withColumn("__k", F.row_number().over(by_time(self.id_col, self.time_col))).select(self.id_col, "__k", "y_hat")
            fold = test.join(pred, [self.id_col, "__k"]).select(self.id_col, F.pow(F.col(self.value_col) - F.col("y_hat"), 2).alias("se"))
            out = fold if out is None else out.unionByName(fold)
        return out.groupBy(self.id_col).agg(F.sum("se").alias("sse"))

    def kaboudan_metric(self, df: DataFrame) -> DataFrame:
        before = self.backtest(df).withColumnRenamed("sse", "before")
        after = self.backtest(block_shuffle(df, self.block_size, self.seed, self.value_col, self.id_col, self.time_col)).withColumnRenamed("sse", "after")
        value = 1 - F.sqrt(ratio("before", "after"))
        value = F.greatest(value, F.lit(0.0)) if self.modified else value
        out = before.join(after, self.id_col).select(self.id_col, value.alias("kaboudan"))
        return out.agg(F.avg("kaboudan").alias("kaboudan")) if self.agg else out


def bias_detect(df: DataFrame, actual_col: str = Y, predicted_col: str = "y_hat", id_col: str | None = None) -> DataFrame:
    e = F.col(predicted_col) - F.col(actual_col)
    return _grouped(df, id_col).agg(F.avg(e).alias("mean_error"), F.avg((e > 0).cast("double")).alias("sign_ratio"), F.coalesce(ratio(F.avg(e), F.avg(F.abs(e))), F.lit(0.0)).alias("bias_ratio"))


def bias_correct(df: DataFrame, actual_col: str = Y, predicted_col: str = "y_hat", method: str = "mean", id_col: str | None = None) -> DataFrame:
    """Corrected predictions; the old ones stay in ``{predicted}_original``."""
    w = whole(id_col) if id_col else Window.partitionBy(F.lit(1))
    y, p = F.col(actual_col).cast("double"), F.col(predicted_col).cast("double")
    df = df.withColumn(f"{predicted_col}_original", p)
    if method == "mean":
        return df.withColumn(predicted_col, p - F.avg(p - y).over(w))
    if method == "regression":
        slope = ratio(F.covar_pop(p, y).over(w), F.var_pop(p).over(w) + 1e-10)
        return df.withColumn("__s", slope).withColumn(predicted_col, F.avg(y).over(w) + F.col("__s") * (p - F.avg(p).over(w))).drop("__s")
    ensure(method == "quantile", f"unknown method {method!r}")

    def mapped(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf[predicted_col] = np.interp(pdf[predicted_col], np.sort(pdf[predicted_col]), np.sort(pdf[actual_col]))
        return pdf

    df = df.withColumn(predicted_col, p)
    return (df.groupBy(id_col) if id_col else df.groupBy(F.lit(1))).applyInPandas(mapped, df.schema)


def calibration_table(df: DataFrame, actual_col: str = Y, quantile_cols: list[str] | None = None, quantiles: list[float] | None = None, id_col: str | None = None) -> DataFrame:
    """quantile, expected and observed coverage (the mean over ids when given)."""
    pairs = _quantile_columns(df, quantile_cols, quantiles)
    items = F.array(*[F.struct(F.lit(q).alias("quantile"), (F.col(actual_col) <= F.col(c)).cast("double").alias("inside")) for c, q in pairs])
    rows = df.select(*([id_col] if id_col else []), F.explode(items).alias("i")).select("*", "i.*").drop("i")
    if id_col:
        rows = rows.groupBy(id_col, "quantile").agg(F.avg("inside").alias("inside"))
    return rows.groupBy("quantile").agg(F.avg("inside").alias("observed")).select("quantile", F.col("quantile").alias("expected"), "observed").orderBy("quantile")


def pit_histogram(df: DataFrame, actual_col: str = Y, quantile_cols: list[str] | None = None, quantiles: list[float] | None = None, n_bins: int = 10) -> DataFrame:
    """bin, count and density of the share of quantiles below the actual."""
    pairs = _quantile_columns(df, quantile_cols, quantiles)
    pit = sum(((F.col(c) <= F.col(actual_col)).cast("int") for c, _ in pairs), F.lit(0)) / float(len(pairs))
    rows = df.select(F.least(F.floor(pit * n_bins), F.lit(n_bins - 1)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("count"))
    bins = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    out = bins.join(rows, "bin", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    total = F.sum("count").over(Window.partitionBy(F.lit(1)))
    return out.select("bin", (F.col("bin") / n_bins).alias("bin_left"), ((F.col("bin") + 1) / n_bins).alias("bin_right"), "count", F.coalesce(ratio(F.col("count") * n_bins, total), F.lit(0.0)).alias("density"))


def reliability_diagram(df: DataFrame, actual_col: str = Y, quantile_cols: list[str] | None = None, quantiles: list[float] | None = None) -> DataFrame:
    return calibration_table(df, actual_col, quantile_cols, quantiles).select("expected", "observed")


# -- trend statistics and autocorrelation ----------------------------------


def mann_kendall(values: Column | str) -> Column:
    """S over the number of pairs, from an array in time order (0 below two).
    Counting runs inside the JVM; ties count 0."""
    v = F.filter(values if isinstance(values, Column) else F.col(values), lambda x: x.isNotNull())
    n = F.size(v)
    signs = F.transform(v, lambda x, i: F.aggregate(F.slice(v, i + 2, n), F.lit(0.0), lambda acc, z: acc + F.signum(z - x)))
    return F.when(n < 2, F.lit(0.0)).otherwise(ratio(F.aggregate(signs, F.lit(0.0), lambda a, b: a + b), n * (n - 1) / 2))


def sens_slope(values: Column | str) -> Column:
    """The median of all slopes between two places of an array (0 below two)."""
    v = F.filter(values if isinstance(values, Column) else F.col(values), lambda x: x.isNotNull())
    n = F.size(v)
    slopes = F.array_sort(F.flatten(F.transform(v, lambda x, i: F.transform(F.slice(v, i + 2, n), lambda z, j: (z - x) / (j + 1)))))
    m = F.size(slopes)
    middle = (F.get(slopes, F.floor((m - 1) / 2).cast("int")) + F.get(slopes, F.floor(m / 2).cast("int"))) / 2
    return F.when(n < 2, F.lit(0.0)).otherwise(middle)


def ordered(value: Column | str, order: Column | str) -> Column:
    """An aggregate: the group's values as an array in the order of a column, to
    use as ``groupBy(g).agg(mann_kendall(ordered("y", "ds")))``."""
    value, order = (F.col(c) if isinstance(c, str) else c for c in (value, order))
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("t"), value.cast("double").alias("v")))), lambda r: r["v"])


def trend_statistics(df: DataFrame, target_col: str = Y, id_col: str = ID, time_col: str = TIME) -> DataFrame:
    s = as_series(df, target_col, id_col, time_col)
    return s.select(id_col, mann_kendall("series").alias("mann_kendall"), sens_slope("series").alias("sens_slope"))


def _acf_values(v: np.ndarray, max_lags: int) -> np.ndarray:
    d = v - v.mean()
    var = (d * d).sum()
    lags = min(max_lags, len(v) - 1)
    if var == 0:
        return np.array([1.0] + [0.0] * lags)
    return np.array([(d[k:] * d[: len(d) - k]).sum() / var for k in range(lags + 1)])


def acf(df: DataFrame, target_col: str = Y, max_lags: int = 20, id_col: str = ID, time_col: str = TIME) -> DataFrame:
    """id, lag, acf, lower, upper: array folds without a join or Python."""
    s = as_series(df, target_col, id_col, time_col).filter(F.size("series") >= 2)
    n = F.size("series")
    s = s.withColumn("__d", F.transform("series", lambda x: x - F.aggregate("series", F.lit(0.0), lambda a, b: a + b) / n))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda p, q: p + F.coalesce(q, F.lit(0.0)))
    s = s.withColumn("__v", dot("__d", "__d")).withColumn("lag", F.explode(F.sequence(F.lit(0), F.least(F.lit(max_lags), n - 1))))
    value = dot(F.expr("slice(__d, lag + 1, size(__d))"), F.expr("slice(__d, 1, size(__d) - lag)"))
    value = F.when(F.col("__v") == 0, F.when(F.col("lag") == 0, 1.0).otherwise(0.0)).otherwise(ratio(value, "__v"))
    bound = F.lit(1.96) / F.sqrt(n)
    return s.select(id_col, F.col("lag").cast("long").alias("lag"), value.alias("acf"), (-bound).alias("lower"), bound.alias("upper"))


def pacf(df: DataFrame, target_col: str = Y, max_lags: int = 20, id_col: str = ID, time_col: str = TIME) -> DataFrame:
    def kernel(_, times, values):
        v = values[~np.isnan(values)]
        if len(v) < 2:
            return None
        r = _acf_values(v, max_lags)
        out, phi = [1.0], np.zeros(0)
        for k in range(1, len(r)):
            den = 1 - (phi * r[1:k]).sum()
            last = 0.0 if abs(den) < 1e-12 else (r[k] - (phi * r[k - 1 : 0 : -1]).sum()) / den
            phi = np.append(phi - last * phi[::-1], last)
            out.append(last)
        bound = 1.96 / math.sqrt(len(v))
        return {"lag": range(len(out)), "pacf": out, "lower": -bound, "upper": bound}

    return map_series(df, kernel, "lag long, pacf double, lower double, upper double", target_col, id_col, time_col)


def ljung_box(df: DataFrame, target_col: str = Y, lags: list[int] | None = None, id_col: str = ID, time_col: str = TIME) -> DataFrame:
    lags = lags or [10]

    def kernel(_, times, values):
        v = values[~np.isnan(values)]
        n = len(v)
        if n < 3:
            return None
        r = _acf_values(v, max(lags))
        use = [k for k in lags if k < n]
        q = [n * (n + 2) * sum(r[j] ** 2 / (n - j) for j in range(1, k + 1)) for k in use]
        return {"lag": use, "statistic": q, "p_value": [chi2_sf(x, k) for x, k in zip(q, use)]}

    return map_series(df, kernel, "lag long, statistic double, p_value double", target_col, id_col, time_col)


#: Values that a task of the shuffles holds.
_HELD = 4_000_000


def _sent(numbers: np.ndarray, values: list[pa.Array], slots: list[tuple[int, int]], n: int, seed: int, block: int) -> Iterator[pa.RecordBatch]:
    for s, (j, _) in enumerate(slots):
        to = permuted(numbers, max(n, 1), permutation_keys(seed, s))
        yield pa.RecordBatch.from_arrays([pa.array((to // block).astype(np.int32)), pa.array(to), pa.array(np.full(len(to), s, np.int32)), values[j]], names=["block", "to", "slot", "value"])


def shuffled_blocks(df: DataFrame, feature_cols: list[str], n_repeats: int, seed: int, order: list[str] | None, work: Callable, schema: str) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Rows of ``df`` in blocks of consecutive numbers with the values that the shuffles
    (feature, repeat) bring there. Every row sends its values to the numbers that keyed
    permutations give it; a task knows the place of each number in its block, so nothing is
    sorted or looked up. ``work(block, rows, numbers, new)`` gives Arrow batches."""
    rows, n = numbered(df, order)
    slots = [(j, r) for j in range(len(feature_cols)) for r in range(n_repeats)]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = max(1_000, min(_HELD // max(1, len(slots)), -(-n // parts)))
    own = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    features = [f"__f{j}" for j in range(len(feature_cols))]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _sent(batch.column(0).to_numpy(), batch.columns[1:], slots, n, seed, block)

    sent = rows.select("__i", *[F.col(f"`{c}`").cast("double").alias(f) for c, f in zip(feature_cols, features)]).mapInArrow(send, "block int, to long, slot int, value double")
    here = rows.select(F.floor(F.col("__i") / block).cast("int").alias("block"), F.col("__i").alias("to"), F.lit(-1).alias("slot"), F.lit(None).cast("double").alias("value"), own.alias("own"))
    both = here.unionByName(sent, allowMissingColumns=True).repartitionById(max(2, -(-n // block)), F.col("block"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new, numbers, held, at = None, [], [], None
        for batch in batches:
            if not len(batch):
                continue
            if at is None:
                at = batch.column(0)[0].as_py()
                new = np.full((min(block, n - at * block), len(slots)), np.nan)
            slot = batch.column(2).to_numpy()
            moved, to = slot >= 0, batch.column(1).to_numpy()
            new[to[moved] - at * block, slot[moved]] = batch.column(3).to_numpy(zero_copy_only=False)[moved]
            if not moved.all():
                numbers.append(to[~moved])
                held.append(pa.array(batch.column(4)).filter(pa.array(~moved)))
        if at is not None:
            numbers = np.concatenate(numbers)
            order = np.argsort(numbers)
            table = pa.Table.from_arrays(pa.concat_arrays(held).take(pa.array(order)).flatten(), names=df_columns)
            yield from work(at, table, numbers[order], new)

    df_columns = df.columns
    return both.mapInArrow(fill, schema), slots


def shuffled_values(df: DataFrame, feature_cols: list[str], n_repeats: int, seed: int, order: list[str] | None = None) -> tuple[DataFrame, list[tuple[int, int]]]:
    """The numbered rows of ``df`` (``__i``) and, per row, the array ``__new`` of the values
    that the shuffles (feature, repeat) bring there."""

    def work(at: int, table: pa.Table, numbers: np.ndarray, new: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(new), 10_000):
            part = new[lo : lo + 10_000]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]), pa.array(part.ravel()))
            yield from table.slice(lo, len(part)).append_column("__i", pa.array(numbers[lo : lo + 10_000])).append_column("__new", lists).combine_chunks().to_batches()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return shuffled_blocks(df, feature_cols, n_repeats, seed, order, work, f"{fields}, __i long, __new array<double>")


def permutation_importance(df: DataFrame, model, feature_cols: list[str], target_col: str = Y, metric_fn=None, n_repeats: int = 5, seed: int = 42, order: list[str] | None = None) -> DataFrame:
    """Increase of the error after shuffling a feature: mean and std over repeats.

    A shuffle is a keyed permutation of row numbers, so all of them take one exchange
    of rows and values by blocks of numbers. The model predicts in these blocks on the
    executors, the rows as they are and under every shuffle. The mean absolute error is
    summed up in each block, in the order of numbers, so it does not follow the partitions;
    ``metric_fn(actual, predicted)`` as a Column is one aggregation. Numbers
    follow ``order`` where columns are given, else the rows as they are stored.

    Defined cases: missing features are NaN for the model; without rows, or where
    an error is null, importances are null."""
    ensure(bool(feature_cols), "feature_cols must not be empty")
    ensure(n_repeats > 0, "n_repeats must be positive")
    frame = df.select(F.col(target_col).alias("__y"), *[F.col(c).cast("double").alias(f"__x{j}") for j, c in enumerate(feature_cols)], *[F.col(c).alias(f"__o{j}") for j, c in enumerate(order or [])])
    names, width = [f"__x{j}" for j in range(len(feature_cols))], 1 + len(feature_cols) * n_repeats

    def predicted(table: pa.Table, new: np.ndarray) -> Iterator[tuple[pa.Table, np.ndarray]]:
        for lo in range(0, len(new), 50_000):
            part, values = table.slice(lo, 50_000), new[lo : lo + 50_000]
            plain = np.stack([part[c].to_numpy().astype(float) for c in names], axis=1)
            out = np.empty((len(plain), width))
            out[:, 0] = np.asarray(model.predict(plain), float).ravel()
            for s in range(width - 1):
                j = s // n_repeats
                held = plain[:, j].copy()
                plain[:, j] = values[:, s]
                out[:, 1 + s] = np.asarray(model.predict(plain), float).ravel()
                plain[:, j] = held
            yield part, out

    def summed(at: int, table: pa.Table, numbers: np.ndarray, new: np.ndarray) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width)
        for part, out in predicted(table, new):
            y = part["__y"].combine_chunks()
            known = y.is_valid().to_numpy(zero_copy_only=False)
            n += int(known.sum())
            total += np.abs(y.cast(pa.float64()).to_numpy(zero_copy_only=False)[known, None] - out[known]).sum(axis=0)
        yield pa.record_batch([pa.array([at]), pa.array([n]), pa.array([total.tolist()])], names=["block", "n", "e"])

    def listed(at: int, table: pa.Table, numbers: np.ndarray, new: np.ndarray) -> Iterator[pa.RecordBatch]:
        for part, out in predicted(table, new):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * width), pa.array(out.ravel()))
            yield from pa.Table.from_arrays([part["__y"], lists], names=["__y", "__p"]).combine_chunks().to_batches(max_chunksize=10_000)

    args = frame, names, n_repeats, seed, [f"__o{j}" for j in range(len(order or []))]
    if metric_fn is None:
        found, slots = shuffled_blocks(*args, summed, "block long, n long, e array<double>")
        blocks = sorted(found.collect())
        n = sum(r.n for r in blocks)
        errors = [math.fsum(r.e[s] for r in blocks) / n if n else None for s in range(width)]
    else:
        found, slots = shuffled_blocks(*args, listed, f"__y {frame.schema['__y'].dataType.simpleString()}, __p array<double>")
        errors = found.agg(*[metric_fn(F.col("__y"), F.element_at("__p", s + 1)).alias(f"e{s}") for s in range(width)]).first()
    out = []
    for j, c in enumerate(feature_cols):
        own = [errors[1 + s] for s, (k, _) in enumerate(slots) if k == j]
        whole_ = errors[0] is not None and None not in own
        gain = np.array([float(e) - float(errors[0]) for e in own]) if whole_ else None
        out.append((c, float(gain.mean()) if whole_ else None, float(gain.std()) if whole_ else None))
    out.sort(key=lambda x: (x[1] is None, -(x[1] or 0.0)))
    return df.sparkSession.createDataFrame(out, "feature string, importance_mean double, importance_std double")

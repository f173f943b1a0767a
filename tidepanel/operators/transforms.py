"""Invertible transforms of the target."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.panel import ID, TIME, Y, by_time, ensure, whole


def log_transform(df: DataFrame, target_col: str = Y) -> DataFrame:
    """log1p in place; the value stays in ``{target}_original``."""
    ensure(f"{target_col}_original" not in df.columns, "the target is transformed already")
    y = F.col(target_col)
    checked = F.when(y <= -1, F.raise_error(F.lit("log_transform needs values above -1"))).otherwise(F.log1p(y))
    return df.withColumn(f"{target_col}_original", y).withColumn(target_col, checked)


def inverse_log_transform(df: DataFrame, target_col: str = Y) -> DataFrame:
    return df.withColumn(target_col, F.expm1(target_col)).drop(f"{target_col}_original")


def boxcox_transform(df: DataFrame, lam: float, target_col: str = Y) -> DataFrame:
    ensure(f"{target_col}_original" not in df.columns, "the target is transformed already")
    y = F.col(target_col)
    value = F.ln(y) if lam == 0 else (F.pow(y, F.lit(float(lam))) - 1) / lam
    checked = F.when(y <= 0, F.raise_error(F.lit("boxcox_transform needs positive values"))).otherwise(value)
    return df.withColumn(f"{target_col}_original", y).withColumn(f"{target_col}_boxcox_lambda", F.lit(float(lam))).withColumn(target_col, checked)


def inverse_boxcox_transform(df: DataFrame, lam: float | None = None, target_col: str = Y) -> DataFrame:
    name = f"{target_col}_boxcox_lambda"
    ensure(lam is not None or name in df.columns, "lam is needed where the lambda column is gone")
    rate = F.lit(float(lam)) if lam is not None else F.col(name)
    y = F.col(target_col)
    value = F.when(rate == 0, F.exp(y)).otherwise(F.pow(y * rate + 1, F.try_divide(F.lit(1.0), rate)))
    return df.withColumn(target_col, value).drop(f"{target_col}_original", name)


def difference(df: DataFrame, order: int = 1, period: int = 1, target_col: str = Y, id_col: str = ID, time_col: str = TIME) -> DataFrame:
    """Differences of an order and period; the first order * period rows go. The
    values needed to invert are in ``{target}_diff_initial``: the first ``period``
    values of every pass, one pass after another."""
    ensure(order > 0 and period > 0, "order and period must be positive")
    w, all_rows = by_time(id_col, time_col), whole(id_col)
    df = df.withColumn("__i", F.row_number().over(w)).withColumn("__v0", F.col(target_col).cast("double"))
    for k in range(1, order + 1):
        df = df.withColumn(f"__v{k}", F.col(f"__v{k - 1}") - F.lag(f"__v{k - 1}", period).over(w))
    firsts = []
    for k in range(order):
        inside = (F.col("__i") > k * period) & (F.col("__i") <= (k + 1) * period)
        rows = F.array_sort(F.collect_list(F.when(inside, F.struct("__i", F.col(f"__v{k}").alias("v")))).over(all_rows))
        firsts.append(F.transform(rows, lambda r: r["v"]))
    df = df.withColumn(f"{target_col}_diff_initial", F.concat(*firsts)).filter(F.col("__i") > order * period)
    return df.withColumn(target_col, F.col(f"__v{order}")).drop("__i", *[f"__v{k}" for k in range(order + 1)])


def undifference(df: DataFrame, order: int = 1, period: int = 1, target_col: str = Y, id_col: str = ID, time_col: str = TIME) -> DataFrame:
    """The values from their differences and ``{target}_diff_initial``."""
    initial = f"{target_col}_diff_initial"
    ensure(initial in df.columns, f"missing column {initial}")
    df = df.withColumn("__i", F.row_number().over(by_time(id_col, time_col)) - 1)
    phase = F.pmod(F.col("__i"), F.lit(period)).cast("int")

    def before(k: int, block: int):
        """Pass k's value in a block of ``period`` rows at the start of the series."""
        if block == k:
            return F.get(F.col(initial), phase + k * period)
        return before(k, block - 1) + before(k + 1, block)

    run = Window.partitionBy(id_col, F.pmod(F.col("__i"), F.lit(period))).orderBy(time_col).rowsBetween(Window.unboundedPreceding, 0)
    for k in reversed(range(order)):
        df = df.withColumn(target_col, before(k, order - 1) + F.sum(target_col).over(run))
    return df.drop("__i", initial)


# -- numpy twins, for recursive forecasting --------------------------------


def forward_values(values: np.ndarray, kind: str | None, options: dict) -> np.ndarray:
    if kind is None:
        return values
    if kind == "log":
        return np.log1p(values)
    if kind == "boxcox":
        lam = options.get("lam", 0.0)
        return np.log(values) if lam == 0 else (values**lam - 1) / lam
    if kind == "difference":
        for _ in range(options.get("order", 1)):
            values = values[options.get("period", 1) :] - values[: -options.get("period", 1)]
        return values
    raise ValueError(f"unknown transform {kind!r}")


def inverse_step(value: float, kind: str | None, options: dict, history: np.ndarray) -> float:
    """One predicted value back on the scale of ``history``, all orders of a
    difference included."""
    if kind is None:
        return value
    if kind == "log":
        return float(np.expm1(value))
    if kind == "boxcox":
        lam = options.get("lam", 0.0)
        return float(np.exp(value)) if lam == 0 else float(max(value * lam + 1, 0) ** (1 / lam))
    period, order = options.get("period", 1), options.get("order", 1)
    levels = [np.asarray(history, float)]
    for _ in range(order - 1):
        levels.append(levels[-1][period:] - levels[-1][:-period])
    for level in reversed(levels):
        value = value + level[-period]
    return float(value)

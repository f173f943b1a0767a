"""Imputation, outliers, resampling, seasonal decomposition, cumulative sums."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.operators.features import _median, rolling_frame
from tidepanel.panel import ID, TIME, Y, by_time, ensure, map_series, ratio, type_of, whole


def _linear(y: str, id_col: str, time_col: str):
    """Linear interpolation by row between the nearest values on either side."""
    w = by_time(id_col, time_col)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.row_number().over(w)
    known = F.when(F.col(y).isNotNull(), F.col("__row"))
    v0, v1 = F.last(y, True).over(back), F.first(y, True).over(ahead)
    i0, i1 = F.last(known, True).over(back), F.first(known, True).over(ahead)
    return at, F.when(F.col(y).isNotNull(), F.col(y)).otherwise(v0 + (v1 - v0) * ratio(F.col("__row") - i0, i1 - i0))


def impute(df: DataFrame, target_col: str = Y, method: str = "forward_fill", id_col: str = ID, time_col: str = TIME, season_length: int | None = None, add_indicator: bool = False) -> DataFrame:
    """Fill nulls of the target; ``{target}_imputed`` tells which on request."""
    y, w = F.col(target_col), by_time(id_col, time_col)
    if add_indicator:
        df = df.withColumn(f"{target_col}_imputed", y.isNull())
    if method == "forward_fill":
        return df.withColumn(target_col, F.last(y, True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if method == "backward_fill":
        return df.withColumn(target_col, F.first(y, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    if method == "linear":
        at, value = _linear(target_col, id_col, time_col)
        return df.withColumn("__row", at).withColumn(target_col, value).drop("__row")
    if method == "mean":
        return df.withColumn(target_col, F.coalesce(y.cast("double"), F.avg(y).over(whole(id_col))))
    if method == "median":
        return df.withColumn(target_col, F.coalesce(y.cast("double"), F.median(y).over(whole(id_col))))
    ensure(method == "seasonal", f"unknown method {method!r}")
    ensure(bool(season_length), "seasonal imputation needs season_length")

    def fill(_, times, values):
        v = values.copy()
        for i in np.flatnonzero(np.isnan(v)):
            for k in range(1, len(v) // season_length + 1):
                near = [j for j in (i - k * season_length, i + k * season_length) if 0 <= j < len(v) and not np.isnan(v[j])]
                if near:
                    v[i] = v[near[0]]
                    break
        return {time_col: times, "__filled": v}

    filled = map_series(df, fill, f"`{time_col}` {type_of(df, time_col)}, __filled double", target_col, id_col, time_col)
    return df.join(filled, [id_col, time_col]).withColumn(target_col, F.nanvl("__filled", F.lit(None).cast("double"))).select(df.columns)


def _quantile(values: str, q: float, interpolation: str, window):
    if interpolation == "linear":
        return F.percentile(values, F.lit(q)).over(window)
    s = F.array_sort(F.collect_list(values).over(window))
    return F.get(s, F.round((F.size(s) - 1) * q).cast("int"))


def detect_outliers(df: DataFrame, target_col: str = Y, method: str = "zscore", id_col: str = ID, time_col: str = TIME, threshold: float = 3.0, window: int | None = None, interpolation: str = "linear") -> DataFrame:
    """``is_outlier`` by zscore, iqr, hampel or rolling_zscore."""
    y = F.col(target_col).cast("double")
    group = whole(id_col)
    if method == "zscore":
        z = F.coalesce(ratio(F.abs(y - F.avg(y).over(group)), F.stddev_samp(y).over(group)), F.lit(0.0))
        return df.withColumn("is_outlier", F.when(y.isNotNull(), z > threshold))
    if method == "iqr":
        df = df.withColumn("__q1", _quantile(target_col, 0.25, interpolation, group)).withColumn("__q3", _quantile(target_col, 0.75, interpolation, group))
        spread = F.col("__q3") - F.col("__q1")
        return df.withColumn("is_outlier", (y < F.col("__q1") - threshold * spread) | (y > F.col("__q3") + threshold * spread)).drop("__q1", "__q3")
    ensure(method in ("hampel", "rolling_zscore"), f"unknown method {method!r}")
    ensure(bool(window), f"{method} needs a window")
    if method == "hampel":
        half = window // 2
        frame = by_time(id_col, time_col).rowsBetween(-half, half)
        df = df.withColumn("__near", F.collect_list(y).over(frame)).withColumn("__mid", _median(F.col("__near")))
        mad = _median(F.transform("__near", lambda x: F.abs(x - F.col("__mid")))) * 1.4826
        return df.withColumn("is_outlier", F.coalesce((mad > 0) & (F.abs(y - F.col("__mid")) > threshold * mad), F.lit(False))).drop("__near", "__mid")
    frame = rolling_frame(id_col, time_col, window)
    enough = F.count(y).over(frame) >= window
    z = F.when(enough, ratio(F.abs(y - F.avg(y).over(frame)), F.stddev_samp(y).over(frame)))
    return df.withColumn("is_outlier", F.coalesce(z > threshold, F.lit(False)))


def treat_outliers(df: DataFrame, target_col: str = Y, method: str = "zscore", replacement: str = "clip", id_col: str = ID, time_col: str = TIME, threshold: float = 3.0, window: int | None = None) -> DataFrame:
    """Replace outliers by the bounds (clip), the median, interpolation or null."""
    ensure(replacement in ("clip", "median", "interpolate", "null"), f"unknown replacement {replacement!r}")
    y, group = F.col(target_col).cast("double"), whole(id_col)
    if replacement == "clip":
        if method == "iqr":
            q1, q3 = F.percentile(target_col, F.lit(0.25)).over(group), F.percentile(target_col, F.lit(0.75)).over(group)
            low, high = q1 - threshold * (q3 - q1), q3 + threshold * (q3 - q1)
        else:
            mean, std = F.avg(y).over(group), F.coalesce(F.stddev_samp(y).over(group), F.lit(0.0))
            low, high = mean - threshold * std, mean + threshold * std
        return df.withColumn(target_col, F.when(y.isNotNull(), F.greatest(F.least(y, high), low)))
    marked = detect_outliers(df, target_col, method, id_col, time_col, threshold, window)
    bad = F.coalesce(F.col("is_outlier"), F.lit(False))
    if replacement == "median":
        return marked.withColumn(target_col, F.when(bad, F.median(y).over(group)).otherwise(y)).drop("is_outlier")
    cut = marked.withColumn(target_col, F.when(~bad, y)).drop("is_outlier")
    return cut if replacement == "null" else impute(cut, target_col, "linear", id_col, time_col)


_RULES = {"s": "second", "m": "minute", "h": "hour", "d": "day", "w": "week", "mo": "month", "q": "quarter", "y": "year"}


def bucket(time_col: str, rule: str):
    """The start of the bucket of a rule such as 1h, 15m, 1d, 1w, 1mo, 1q, 1y."""
    digits = "".join(c for c in rule if c.isdigit())
    n, unit = int(digits or 1), _RULES.get(rule[len(digits) :])
    ensure(unit is not None, f"unknown rule {rule!r}")
    if n == 1:
        return F.date_trunc(unit, F.col(time_col))
    ensure(unit in ("second", "minute", "hour", "day", "week"), "calendar units are taken one at a time")
    # Weeks start on Mondays; the epoch was a Thursday.
    start = "4 days" if unit == "week" else "0 seconds"
    return F.window(F.col(time_col).cast("timestamp"), f"{n} {unit}s", startTime=start)["start"]


def resample(df: DataFrame, rule: str, agg: str = "mean", target_col: str = Y, id_col: str = ID, time_col: str = TIME, fill: str | None = None) -> DataFrame:
    """Calendar buckets, closed and labelled left; only buckets with rows, unless
    ``fill`` is "gap_forward" or "gap_linear", which add the empty ones (units up
    to a week)."""
    y, t = F.col(target_col), F.col(time_col)
    aggs = {"mean": F.avg(y), "sum": F.sum(y), "min": F.min(y), "max": F.max(y), "median": F.median(y), "first": F.min_by(y, t), "last": F.max_by(y, t)}
    ensure(agg in aggs, f"agg must be of {sorted(aggs)}")
    rows = df.groupBy(id_col, bucket(time_col, rule).alias("__b")).agg(aggs[agg].alias(target_col))
    rows = rows.select(id_col, F.col("__b").cast("timestamp_ntz").alias(time_col), target_col)
    if fill is None:
        return rows
    if fill.startswith("gap_"):
        digits = "".join(c for c in rule if c.isdigit())
        step = F.expr(f"interval {int(digits or 1)} {_RULES[rule[len(digits):]]}")
        ends = rows.groupBy(id_col).agg(F.min(time_col).alias("a"), F.max(time_col).alias("b"))
        grid = ends.select(id_col, F.explode(F.sequence("a", "b", step)).alias(time_col))
        rows = grid.join(rows, [id_col, time_col], "left")
    kind = {"forward_fill": "forward_fill", "ffill": "forward_fill", "interpolate": "linear", "gap_forward": "forward_fill", "gap_linear": "linear"}.get(fill)
    ensure(kind is not None, f"unknown fill {fill!r}")
    return impute(rows, target_col, kind, id_col, time_col)


def seasonal_decomposition(df: DataFrame, freq: int, method: str = "additive", id_col: str = ID, target_col: str = Y, time_col: str = TIME, anomaly_threshold: float | None = None, center: str = "subtract") -> DataFrame:
    """trend, seasonal and resid by centred means and means per phase. In the
    multiplicative form phases are centred by subtracting their mean, as the
    reference figures have it, or with ``center="divide"`` by dividing."""
    ensure(method in ("additive", "multiplicative"), f"unknown method {method!r}")
    ensure(freq > 1, "freq must be greater than 1")
    y, times = F.col(target_col).cast("double"), method == "multiplicative"
    frame = rolling_frame(id_col, time_col, freq, center=True)
    out = df.withColumn("period_idx", F.pmod(F.row_number().over(by_time(id_col, time_col)) - 1, F.lit(freq)).cast("int"))
    out = out.withColumn("trend", F.when(F.count(y).over(frame) >= freq, F.avg(y).over(frame)))
    bare = ratio(y, "trend") if times else y - F.col("trend")
    out = out.withColumn("__season", F.avg(bare).over(Window.partitionBy(id_col, "period_idx")))
    mean = F.avg("__season").over(whole(id_col))
    out = out.withColumn("seasonal", ratio("__season", mean) if times and center == "divide" else F.col("__season") - mean)
    out = out.withColumn("resid", ratio(y, F.col("trend") * F.col("seasonal")) if times else y - F.col("trend") - F.col("seasonal"))
    out = out.drop("__season").na.drop()
    if anomaly_threshold is not None:
        out = out.withColumn("is_anomaly", F.coalesce(F.abs("resid") > anomaly_threshold * F.stddev_samp("resid").over(whole(id_col)), F.lit(False)))
    return out


def seasonal_decompose_features(df: DataFrame, ts_freq: int, seasonal_freqs: list[int] | None = None, mode: str = "simple", id_col: str = ID, time_col: str = TIME, target_col: str = Y) -> DataFrame:
    """trend_strength, a strength for every season and resid_var of every series.

    ``simple``: centred means over ``ts_freq`` rows; ``mstl``: local regression over
    the periods ``seasonal_freqs``, in rows, whatever the calendar step. A strength is
    1 - var(resid) / var(component + resid), unsigned; resid_var is the standard
    deviation of the remainder over the mean of the target."""
    missing = [c for c in (id_col, time_col, target_col) if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {', '.join(missing)}")
    ensure(isinstance(ts_freq, int) and ts_freq > 0, "ts_freq must be a positive integer")
    ensure(mode in ("simple", "mstl"), f"unknown mode {mode!r}")
    if mode == "mstl":
        from tidepanel.operators.stl import check_periods, mstl_decomposition, season_names

        periods = check_periods(seasonal_freqs)
        parts, seasons = mstl_decomposition(df, periods, id_col, time_col, target_col), season_names(periods)
    else:
        parts, seasons = seasonal_decomposition(df, ts_freq, "additive", id_col, target_col, time_col), ["seasonal"]
    var = F.var_samp
    strength = lambda c: F.abs(ratio(var("resid"), var(F.col(c) + F.col("resid"))) - 1)
    return parts.groupBy(id_col).agg(strength("trend").alias("trend_strength"), *[strength(c).alias(f"{c}_strength") for c in seasons], ratio(F.stddev_samp("resid"), F.avg(target_col)).alias("resid_var"))


def fourier_decomposition(df: DataFrame, ts_freq: int, freqs: tuple[str, ...] = ("week",), n_fourier_terms: int = 3, id_col: str = ID, time_col: str = TIME, target_col: str = Y, anomaly_threshold: float | None = None) -> DataFrame:
    """trend by a centred mean, seasonal by ridge regression (penalty 0.001) of the
    detrended target on sin and cos of the date parts, resid = trend + seasonal - y."""
    from tidepanel.operators.features import calendar_part

    frame = rolling_frame(id_col, time_col, ts_freq, center=True)
    y = F.col(target_col).cast("double")
    rows = df.withColumn("trend", F.when(F.count(y).over(frame) >= ts_freq, F.avg(y).over(frame))).filter("trend is not null")
    x = []
    for part in freqs:
        value = calendar_part(part, time_col).cast("double")
        for k in range(1, n_fourier_terms + 1):
            x += [F.sin(value * k), F.cos(value * k)]
    rows = rows.withColumn("__x", F.array(*x)).withColumn("__d", y - F.col("trend"))
    schema = f"`{id_col}` {type_of(df, id_col)}, `{time_col}` {type_of(df, time_col)}, `{target_col}` double, trend double, seasonal double, resid double"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(pdf["__x"].to_numpy())
        d = pdf["__d"].to_numpy()
        season = m @ np.linalg.solve(m.T @ m + 0.001 * np.eye(m.shape[1]), m.T @ d)
        out = pdf[[id_col, time_col]].copy()
        out[target_col], out["trend"], out["seasonal"] = pdf[target_col].astype(float), pdf["trend"], season
        out["resid"] = out["trend"] + season - out[target_col]
        return out

    out = rows.select(id_col, time_col, target_col, "trend", "__x", "__d").groupBy(id_col).applyInPandas(fit, schema)
    if anomaly_threshold is not None:
        out = out.withColumn("is_anomaly", F.abs("resid") > anomaly_threshold * F.stddev_samp("resid").over(whole(id_col)))
    return out


def cusum(df: DataFrame, target_col: str = Y, id_col: str | None = ID, normalize: bool = True, time_col: str = TIME) -> DataFrame:
    """``cusum``: running sum of deviations from the series mean, in units of its
    standard deviation when ``normalize`` (0 if that is 0)."""
    group = whole(id_col) if id_col else Window.partitionBy(F.lit(1))
    y = F.col(target_col).cast("double")
    df = df.withColumn("__dev", y - F.avg(y).over(group)).withColumn("__std", F.stddev_samp(y).over(group))
    total = F.sum("__dev").over(by_time(id_col, time_col).rowsBetween(Window.unboundedPreceding, 0))
    value = F.when(F.coalesce(F.col("__std"), F.lit(0.0)) > 0, ratio(total, "__std")).otherwise(F.lit(0.0)) if normalize else total
    return df.withColumn("cusum", value).drop("__dev", "__std")

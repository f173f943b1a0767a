"""Feature columns: lags, rolling windows, calendar, Fourier, encodings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.panel import ID, TIME, Y, by_time, ensure, need


def lag_features(df: DataFrame, lags: list[int], target_col: str = Y, id_col: str = ID, time_col: str = TIME) -> DataFrame:
    return covariate_lag_features(df, [target_col], lags, id_col, time_col)


def covariate_lag_features(df: DataFrame, covariate_cols: list[str], lags: list[int], id_col: str = ID, time_col: str = TIME) -> DataFrame:
    """``{column}_lag_{k}``: the value k rows earlier in the series."""
    ensure(all(k > 0 for k in lags), "lags must be positive")
    need(df, id_col, time_col, *covariate_cols)
    w = by_time(id_col, time_col)
    return df.select("*", *[F.lag(c, k).over(w).alias(f"{c}_lag_{k}") for c in covariate_cols for k in lags])


def _median(values):
    s = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    n = F.size(s)
    middle = (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    return F.when(n > 0, middle)


ROLLING = {
    "mean": lambda c, w: F.avg(c).over(w), "sum": lambda c, w: F.sum(c).over(w), "min": lambda c, w: F.min(c).over(w), "max": lambda c, w: F.max(c).over(w),
    "std": lambda c, w: F.stddev_samp(c).over(w), "var": lambda c, w: F.var_samp(c).over(w), "median": lambda c, w: _median(F.collect_list(c).over(w)),
}


def rolling_frame(id_col: str, time_col: str, window: int, center: bool = False):
    w = by_time(id_col, time_col)
    return w.rowsBetween(-(window // 2), (window + 1) // 2 - 1) if center else w.rowsBetween(1 - window, 0)


def rolling_features(df: DataFrame, windows: list[int], aggs: list[str] | None = None, target_col: str = Y, id_col: str = ID, time_col: str = TIME, center: bool = False, min_samples: int | None = None) -> DataFrame:
    """``{target}_rolling_{agg}_{w}``; null below ``min_samples`` values."""
    aggs = aggs or ["mean", "std"]
    ensure(all(w > 0 for w in windows), "windows must be positive")
    ensure(set(aggs) <= set(ROLLING), f"aggs must be of {sorted(ROLLING)}")
    y = F.col(target_col).cast("double")
    out = []
    for size in windows:
        frame = rolling_frame(id_col, time_col, size, center)
        enough = F.count(target_col).over(frame) >= (min_samples or size)
        out += [F.when(enough, ROLLING[a](y, frame)).alias(f"{target_col}_rolling_{a}_{size}") for a in aggs]
    return df.select("*", *out)


#: Extractors of calendar parts, as (expression, type).
CALENDAR = {
    "day_of_week": (lambda c: F.weekday(c) + 1, "tinyint"), "day_of_month": (F.dayofmonth, "tinyint"), "day_of_year": (F.dayofyear, "smallint"), "week": (F.weekofyear, "tinyint"),
    "month": (F.month, "tinyint"), "quarter": (F.quarter, "tinyint"), "year": (F.year, "int"), "hour": (F.hour, "tinyint"), "minute": (F.minute, "tinyint"), "is_weekend": (lambda c: F.weekday(c) >= 5, "tinyint"),
}
CALENDAR["week_of_year"] = CALENDAR["week"]


def calendar_part(name: str, time_col: str):
    ensure(name in CALENDAR, f"unknown calendar feature {name!r}")
    make, kind = CALENDAR[name]
    return make(F.col(time_col)).cast(kind)


def calendar_features(df: DataFrame, features: list[str] | None = None, time_col: str = TIME) -> DataFrame:
    features = features or ["day_of_week", "day_of_month", "month", "quarter", "year"]
    return df.select("*", *[calendar_part(f, time_col).alias(f) for f in features])


def fourier_features(df: DataFrame, period: float, n_harmonics: int = 1, time_col: str = TIME, id_col: str | None = ID) -> DataFrame:
    """sin and cos of 2 pi k t / period, t the place in the series from 0."""
    ensure(period > 0 and n_harmonics > 0, "period and n_harmonics must be positive")
    t = (F.row_number().over(by_time(id_col, time_col)) - 1).cast("double")
    period = float(period)
    out = []
    for k in range(1, n_harmonics + 1):
        angle = t * (2 * math.pi * k / period)
        out += [F.sin(angle).alias(f"fourier_sin_{period}_{k}"), F.cos(angle).alias(f"fourier_cos_{period}_{k}")]
    return df.select("*", *out)


def target_encode(df: DataFrame, cat_col: str, target_col: str = Y, smoothing: float = 10.0) -> DataFrame:
    """``{cat}_encoded``: the category mean drawn to the global mean."""
    per = df.groupBy(cat_col).agg(F.count(F.lit(1)).alias("__n"), F.avg(target_col).alias("__m"))
    total = df.agg(F.avg(target_col).alias("__g"))
    value = (F.col("__n") * F.col("__m") + F.lit(float(smoothing)) * F.col("__g")) / (F.col("__n") + F.lit(float(smoothing)))
    per = per.crossJoin(F.broadcast(total)).select(F.col(cat_col).alias("__key"), value.alias(f"{cat_col}_encoded"))
    return df.join(per, df[cat_col] == per["__key"], "left").drop("__key")


def country_calendar(df: DataFrame, country: str, time_col: str = TIME) -> DataFrame:
    """date and name of a country's holidays in the years of the data, from rules."""
    from tidepanel.functions.calendars import holidays

    ends = df.agg(F.min(F.year(time_col)).alias("a"), F.max(F.year(time_col)).alias("b")).first()
    days = holidays(country, [] if ends["a"] is None else range(ends["a"], ends["b"] + 1))
    return df.sparkSession.createDataFrame(days, "date date, name string")


def holiday_features(df: DataFrame, holidays: DataFrame | str = "US", time_col: str = TIME, distance: bool = False) -> DataFrame:
    """``is_holiday`` and days to and since a holiday (365 if there is none), by a
    country's code or a calendar with a ``date`` column (a few rows a year)."""
    if isinstance(holidays, str):
        holidays = country_calendar(df, holidays, time_col)
    days = holidays.select(F.to_date("date").alias("__h")).distinct()
    day = F.to_date(F.col(time_col))
    if not distance:
        out = df.withColumn("__d", day).join(F.broadcast(days), F.col("__d") == F.col("__h"), "left")
        return out.withColumn("is_holiday", F.col("__h").isNotNull().cast("tinyint")).drop("__d", "__h")
    dates = df.select(day.alias("__d")).distinct()
    both = dates.select("__d", F.lit(None).cast("date").alias("__h")).unionByName(days.select(F.col("__h").alias("__d"), "__h"))
    both = both.groupBy("__d").agg(F.max("__h").alias("__h"))
    # One row per distinct day: at most some thousands, whatever the panel's size.
    w = Window.orderBy("__d")
    last = F.last("__h", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    nxt = F.first("__h", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    both = both.select("__d", F.col("__h").isNotNull().cast("tinyint").alias("is_holiday"), F.coalesce(F.datediff(nxt, "__d"), F.lit(365)).alias("days_to_holiday"), F.coalesce(F.datediff("__d", last), F.lit(365)).alias("days_since_holiday"))
    return df.withColumn("__d", day).join(both, "__d", "left").drop("__d")


def interaction_features(df: DataFrame, pairs: list[tuple[str, str]], method: str = "multiply") -> DataFrame:
    ensure(method in ("multiply", "add"), f"unknown method {method!r}")
    join = {"multiply": ("x", lambda a, b: F.col(a) * F.col(b)), "add": ("plus", lambda a, b: F.col(a) + F.col(b))}[method]
    return df.select("*", *[join[1](a, b).alias(f"{a}_{join[0]}_{b}") for a, b in pairs])


#: The cycle of each part.
CYCLES = {"hour": 24, "day_of_week": 7, "day_of_month": 31, "day_of_year": 366, "week": 53, "month": 12, "quarter": 4}


def time_embeddings(df: DataFrame, time_col: str = TIME, components: list[str] | None = None) -> DataFrame:
    components = components or ["hour", "day_of_week", "month"]
    ensure(set(components) <= set(CYCLES), f"components must be of {sorted(CYCLES)}")
    out = []
    for c in components:
        angle = calendar_part(c, time_col).cast("double") * (2 * math.pi / CYCLES[c])
        out += [F.sin(angle).alias(f"{c}_sin"), F.cos(angle).alias(f"{c}_cos")]
    return df.select("*", *out)

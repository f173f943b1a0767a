"""Decomposition by local regression, over several seasonal periods."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions import stl
from tidepanel.panel import ID, TIME, Y, ensure, type_of

#: Values of one matrix of series that is decomposed at a time.
_AT_A_TIME = 500_000


def season_names(periods: list[int]) -> list[str]:
    """``seasonal`` for one period, else ``seasonal7`` and so on."""
    return ["seasonal"] if len(periods) == 1 else [f"seasonal{p}" for p in periods]


def check_periods(periods: list[int] | None) -> list[int]:
    ensure(periods is not None, "MSTL needs at least one seasonal frequency")
    if any(isinstance(p, bool) or not isinstance(p, (int, np.integer)) for p in periods):
        raise TypeError("seasonal frequencies must be integers")
    ensure(len(periods) > 0 and min(periods) > 1, "MSTL needs seasonal frequencies above 1")
    ensure(len(set(periods)) == len(periods), "seasonal frequencies must differ")
    return [int(p) for p in periods]


def _filled(y: np.ndarray) -> np.ndarray:
    """Missing values on the line between their neighbours, at the ends the nearest."""
    out = y.copy()
    for i in np.flatnonzero(np.isnan(y).any(1)):
        there = np.flatnonzero(~np.isnan(y[i]))
        if len(there):
            out[i] = np.interp(np.arange(y.shape[1]), there, y[i, there])
    return out


def mstl_decomposition(df: DataFrame, seasonal_freqs: list[int], id_col: str = ID, time_col: str = TIME, target_col: str = Y, seasonal_windows: list[int] | None = None, rounds: int = 2, robust: int = 0) -> DataFrame:
    """id, time, target, trend, one seasonal column per period, and resid.

    Series become arrays by one shuffle; a task decomposes all series of one length
    in its Arrow batch together. ``robust`` rounds of bisquare weights follow each fit.

    Defined cases: missing targets are filled on the line between their neighbours
    for the fit and have a null resid; a series without any target, or shorter than
    a period twice, has null, or 0, for that season; rows of one time are ordered by
    their target; other columns are not carried on.
    """
    periods = check_periods(seasonal_freqs)
    ensure(seasonal_windows is None or len(seasonal_windows) == len(periods), "one window for each period")
    ensure(all(w >= 3 and w % 2 for w in seasonal_windows or []), "seasonal windows are odd and at least 3")
    ensure(rounds > 0 and robust >= 0, "rounds must be positive")
    names = season_names(periods)
    items = F.array_sort(F.collect_list(F.struct(F.col(time_col).alias("t"), F.col(target_col).cast("double").alias("v"))))
    series = df.groupBy(id_col).agg(items.alias("__rows"))
    series = series.select(F.col(id_col), F.transform("__rows", lambda r: r["t"]).alias("__t"), F.transform("__rows", lambda r: r["v"]).alias("__v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(2)
            offsets = np.append(0, np.cumsum(held.value_lengths().to_numpy(zero_copy_only=False)))
            flat = held.flatten().to_numpy(zero_copy_only=False).astype(float)
            length = np.diff(offsets)
            parts = np.full((1 + len(periods), len(flat)), np.nan)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                for low in range(0, len(own), max(1, _AT_A_TIME // max(1, n))):
                    at = offsets[own[low : low + max(1, _AT_A_TIME // max(1, n))]][:, None] + np.arange(n)[None, :]
                    y = _filled(flat[at])
                    parts[0][at], seasonal = stl.mstl(y, periods, seasonal_windows, rounds, robust)
                    for k in range(len(periods)):
                        parts[1 + k][at] = np.where(np.isnan(y), np.nan, seasonal[k])
            lists = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(p, from_pandas=True)) for p in parts]
            yield pa.record_batch([batch.column(0), batch.column(1), held, *lists], names=[id_col, "__t", "__v", "trend", *names])

    arrays = ", ".join(f"`{c}` array<double>" for c in ("__v", "trend", *names))
    found = series.mapInArrow(run, f"`{id_col}` {type_of(df, id_col)}, __t array<{type_of(df, time_col)}>, {arrays}")
    rows = found.select(id_col, F.explode(F.arrays_zip("__t", "__v", "trend", *names)).alias("__r"))
    resid = F.col("__r.__v") - F.col("__r.trend")
    for c in names:
        resid = resid - F.col(f"__r.{c}")
    return rows.select(id_col, F.col("__r.__t").alias(time_col), F.col("__r.__v").alias(target_col), F.col("__r.trend").alias("trend"), *[F.col(f"__r.{c}").alias(c) for c in names], resid.alias("resid"))

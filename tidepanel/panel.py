"""The long panel: one row per series and time.

Operators are lazy functions from DataFrame to DataFrame. They order every series
by its time column themselves, keep the type of the ids, and give a fixed schema.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ID, TIME, Y = "unique_id", "ds", "y"


def need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def by_time(id_col: str | None = ID, time_col: str = TIME, desc: bool = False):
    """The window of one series in time order."""
    order = F.col(time_col).desc() if desc else F.col(time_col)
    return (Window.partitionBy(id_col) if id_col else Window.partitionBy(F.lit(1))).orderBy(order)


def whole(id_col: str | None = ID):
    return Window.partitionBy(id_col) if id_col else Window.partitionBy(F.lit(1))


def ratio(a, b) -> Column:
    """a / b in doubles, null where b is 0 or null (division raises otherwise)."""
    as_col = lambda x: (F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)).cast("double")
    return F.try_divide(as_col(a), as_col(b))


def as_series(df: DataFrame, target_col: str = Y, id_col: str = ID, time_col: str | None = TIME, name: str = "series", drop_null: bool = True) -> DataFrame:
    """One row per id with its values in time order as an array of doubles."""
    value = F.col(target_col).cast("double")
    if drop_null:
        df = df.filter(F.col(target_col).isNotNull())
    if time_col and time_col in df.columns:
        rows = F.array_sort(F.collect_list(F.struct(F.col(time_col).alias("t"), value.alias("v"))))
        return df.groupBy(id_col).agg(F.transform(rows, lambda r: r["v"]).alias(name))
    return df.groupBy(id_col).agg(F.collect_list(value).alias(name))


def as_series_multi(df: DataFrame, value_cols: list[str], id_col: str = ID, time_col: str = TIME, name: str = "series") -> DataFrame:
    """One row per id with an array of points (arrays of doubles)."""
    point = F.array(*[F.col(c).cast("double") for c in value_cols])
    rows = F.array_sort(F.collect_list(F.struct(F.col(time_col).alias("t"), point.alias("v"))))
    return df.groupBy(id_col).agg(F.transform(rows, lambda r: r["v"]).alias(name))


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def map_series(df: DataFrame, fn: Callable[[object, np.ndarray, np.ndarray], pd.DataFrame | dict | None], schema: str, target_col: str = Y, id_col: str = ID, time_col: str = TIME, keep_id: bool = True, extra: list[str] | None = None) -> DataFrame:
    """Run a numpy kernel on every series: ``fn(id, times, values)`` gives the
    columns of ``schema`` (without the id); series are grouped by one shuffle."""
    cols = [id_col, time_col, target_col, *(extra or [])]
    names = [f.split()[0].strip("`") for f in _fields(schema)]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time_col, kind="stable")
        args = [key[0], pdf[time_col].to_numpy(), pdf[target_col].to_numpy(dtype=float)]
        if extra:
            args.append({c: pdf[c].to_numpy() for c in extra})
        got = fn(*args)
        out = pd.DataFrame(got if got is not None else {n: [] for n in names}, columns=names)
        if keep_id:
            out.insert(0, id_col, [key[0]] * len(out))
        if not len(out):
            out = out.astype(object)  # else empty columns would be floats
        return out

    ddl = f"`{id_col}` {type_of(df, id_col)}, {schema}" if keep_id else schema
    narrow = df.select(*dict.fromkeys(cols))
    return narrow.groupBy(id_col).applyInPandas(run, ddl)


def _fields(schema: str) -> list[str]:
    """The fields of a DDL string, with nested types kept whole."""
    out, depth, now = [], 0, ""
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += ch
    return [*out, now.strip()]


def median_step(df: DataFrame, id_col: str = ID, time_col: str = TIME) -> DataFrame:
    """Per id: its last time, and the median step between its times (seconds for
    timestamps, days for dates, units for integers)."""
    kind = df.schema[time_col].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        number = F.unix_micros(F.col(time_col).cast("timestamp")) / 1e6
    elif isinstance(kind, T.DateType):
        number = F.unix_date(time_col).cast("double")
    else:
        number = F.col(time_col).cast("double")
    steps = df.select(id_col, time_col, (number - F.lag(number).over(by_time(id_col, time_col))).alias("step"))
    return steps.groupBy(id_col).agg(F.max(time_col).alias("last"), F.median("step").alias("step"))


def shifted(last: str, step: Column, time_type: T.DataType) -> Column:
    """A time some steps (as ``median_step`` counts) after ``last``."""
    if isinstance(time_type, (T.TimestampType, T.TimestampNTZType)):
        moved = F.col(last).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), step.cast("decimal(18,6)"))
        return moved.cast(time_type)
    if isinstance(time_type, T.DateType):
        return F.date_add(F.col(last), step.cast("int"))
    return (F.col(last) + step).cast(time_type)


def explode_horizon(df: DataFrame, h: int, id_col: str, time_col: str, time_type: T.DataType) -> DataFrame:
    """Rows (id, last, step, ...) become h rows with ``k`` and the future time."""
    if h < 1:
        raise ValueError("h must be positive")
    df = df.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(h))))
    return df.withColumn(time_col, shifted("last", F.col("step") * F.col("k"), time_type))


def future_times(times: np.ndarray, h: int) -> list:
    """The next times of one series by its median step, for numpy kernels."""
    t = pd.Series(times)
    if np.issubdtype(t.dtype, np.number):
        step = t.diff().median() if len(t) > 1 else 1
        return [t.iloc[-1] + step * k for k in range(1, h + 1)]
    stamps = pd.to_datetime(t)
    step = stamps.diff().median() if len(t) > 1 else pd.Timedelta(days=1)
    out = [stamps.iloc[-1] + step * k for k in range(1, h + 1)]
    return [x.date() for x in out] if t.dtype == object else out


def ensure(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


def settled(df: DataFrame) -> DataFrame:
    """``df`` from a checkpoint in the shared folder that the cluster names, so that a
    lost executor costs no results. Only a local master may do without a named one."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir", None)
        if not named:
            ensure(context.master.startswith("local"), "set spark.checkpoint.dir to a folder that driver and executors share")
            named = "file://" + tempfile.mkdtemp(prefix="tidepanel-")
        context.setCheckpointDir(named)
    return df.checkpoint()


def forget(df: DataFrame) -> None:
    """Delete the checkpoint of a ``settled`` frame that nothing reads any more."""
    file = df._jdf.logicalPlan().rdd().getCheckpointFile()
    if file.isDefined():
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)

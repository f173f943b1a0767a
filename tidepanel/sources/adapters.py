"""Named datasets, format adapters, environments, and wrappers of optional models.

Deep-learning and foundation models need packages that are optional: their
classes exist and say which package is missing when they are made or run.
"""

from __future__ import annotations

import hashlib
import importlib
import urllib.request
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.panel import ID, TIME, Y, as_series, by_time, ensure, need

#: name: (address, SHA-256, format). Entries are added with ``register_dataset``.
DATASETS: dict[str, tuple[str, str, str]] = {}


def register_dataset(name: str, url: str, sha256: str, kind: str) -> None:
    ensure(kind in ("csv", "parquet"), "kind must be csv or parquet")
    DATASETS[name] = (url, sha256, kind)


def load_dataset(spark: SparkSession, name: str, cache_dir: str | None = None) -> DataFrame:
    """A registered file, fetched once, with its hash checked each time."""
    if name not in DATASETS:
        raise KeyError(f"unknown dataset {name!r}; known: {sorted(DATASETS)}")
    url, sha, kind = DATASETS[name]
    folder = Path(cache_dir or Path.home() / ".cache" / "tidepanel")
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / f"{name}.{kind}"
    if not path.exists():
        urllib.request.urlretrieve(url, path)
    if hashlib.sha256(path.read_bytes()).hexdigest() != sha:
        path.unlink()
        raise ValueError(f"the file of {name!r} does not have the registered hash")
    if kind == "parquet":
        return spark.read.parquet(f"file://{path}")
    return spark.read.option("header", True).option("inferSchema", True).csv(f"file://{path}")


def write_panel(df: DataFrame, path: str, mode: str = "errorifexists", by: list[str] | None = None) -> None:
    """Parquet, partitioned by columns on request."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def to_neuralforecast(df: DataFrame, target_col: str = Y, id_col: str = ID, time_col: str = TIME) -> DataFrame:
    need(df, target_col, id_col, time_col)
    t = F.col(time_col).cast("timestamp_ntz") if df.schema[time_col].dataType.simpleString() == "date" else F.col(time_col)
    rest = [c for c in df.columns if c not in (target_col, id_col, time_col)]
    return df.select(F.col(id_col).alias("unique_id"), t.alias("ds"), F.col(target_col).alias("y"), *rest).orderBy("unique_id", "ds")


def from_neuralforecast(result: DataFrame, id_col: str = ID, time_col: str = TIME) -> DataFrame:
    values = [c for c in result.columns if c not in ("unique_id", "ds")]
    ensure(bool(values), "no forecast column")
    return result.select(F.col("unique_id").alias(id_col), F.col("ds").alias(time_col), F.col(values[0]).alias("y_hat"))


def to_pytorch_forecasting(df: DataFrame, target_col: str = Y, id_col: str = ID, time_col: str = TIME, time_idx_col: str = "time_idx") -> dict:
    rows = df.withColumn(time_idx_col, (F.row_number().over(by_time(id_col, time_col)) - 1).cast("long"))
    return {"data": rows.toPandas(), "target": target_col, "time_idx": time_idx_col, "group_ids": [id_col]}


def from_pytorch_forecasting(spark: SparkSession, predictions, id_col: str = ID, time_col: str = TIME) -> DataFrame:
    if isinstance(predictions, pd.DataFrame):
        values = [c for c in predictions.columns if c not in (id_col, time_col)]
        ensure(bool(values), "no forecast column")
        return spark.createDataFrame(predictions.rename(columns={values[0]: "y_hat"}))
    return spark.createDataFrame([(float(x),) for x in np.asarray(predictions).ravel()], "y_hat double")


def to_hf_records(df: DataFrame, target_col: str = Y, id_col: str = ID, time_col: str = TIME) -> DataFrame:
    """One row per series: id, target (array) and start (text)."""
    start = df.groupBy(id_col).agg(F.min(time_col).cast("string").alias("start"))
    return as_series(df, target_col, id_col, time_col, name="target", drop_null=False).join(start, id_col)


def to_hf_dataset(df: DataFrame, **columns):
    datasets = optional("datasets")
    return datasets.Dataset.from_list([r.asDict() for r in to_hf_records(df, **columns).collect()])


class ForecastEnv:
    """Observations are the last values and the next forecast; the default reward
    is minus the absolute error of the action."""

    def __init__(self, data, forecasts, window_size: int = 10, reward_fn=None):
        self.data, self.forecasts, self.w = np.asarray(data, float), np.asarray(forecasts, float), window_size
        self.reward_fn = reward_fn or (lambda action, actual: -abs(float(action) - actual))

    def _observe(self) -> np.ndarray:
        return np.append(self.data[self.t - self.w : self.t], self.forecasts[min(self.t, len(self.forecasts) - 1)])

    def reset(self) -> np.ndarray:
        self.t = self.w
        return self._observe()

    def step(self, action) -> tuple[np.ndarray, float, bool, dict]:
        actual = float(self.data[self.t])
        self.t += 1
        return self._observe(), self.reward_fn(action, actual), self.t >= len(self.data), {"actual": actual}


def optional(package: str):
    """An optional package, or an error that names it."""
    try:
        return importlib.import_module(package)
    except ImportError as e:
        raise ImportError(f"this operator needs the optional package {package!r}") from e


class OptionalModel:
    """A model whose package is optional. ``run(df, h)`` of a subclass or of the
    function given as ``runner`` does the work when the package is there."""

    package = "torch"

    def __init__(self, runner=None, **options):
        self.options, self.runner = options, runner
        optional(self.package)

    def fit(self, df: DataFrame):
        self.df_ = df
        return self

    def predict(self, df: DataFrame | None = None, h: int | None = None) -> DataFrame:
        ensure(self.runner is not None, f"{type(self).__name__} needs a runner(df, h, **options)")
        return self.runner(df if df is not None else self.df_, h or self.options.get("h", 12), **self.options)


def _model(name: str, package: str = "torch") -> type:
    return type(name, (OptionalModel,), {"package": package, "__doc__": f"Needs {package}."})


OPTIONAL_MODELS = {
    **{n: _model(n) for n in ("NBEATSForecaster", "PatchTSTForecaster", "MultivariatePatchTST", "iTransformerForecaster", "TimeLLMForecaster", "LLMPSForecaster", "InceptionTimeClassifier", "ResNetClassifier", "ContrastiveClusterer", "DECClusterer", "IDECClusterer", "TSEncoder", "TSAutoencoder", "ClusteringLayer")},
    "ChronosForecaster": _model("ChronosForecaster", "chronos"), "TimesFMForecaster": _model("TimesFMForecaster", "timesfm"), "MoiraiForecaster": _model("MoiraiForecaster", "uni2ts"),
}
FOUNDATION = {"chronos": "ChronosForecaster", "timesfm": "TimesFMForecaster", "moirai": "MoiraiForecaster"}


def foundation_forecast(df: DataFrame, model: str, h: int, **options) -> DataFrame:
    ensure(model in FOUNDATION, f"unknown model {model!r}; one of {sorted(FOUNDATION)}")
    return OPTIONAL_MODELS[FOUNDATION[model]](**options).fit(df).predict(h=h)


def to_chronos_embeddings(df: DataFrame, encoder=None, **columns) -> DataFrame:
    return series_embeddings(df, encoder, "chronos", **columns)


def to_moment_embeddings(df: DataFrame, encoder=None, **columns) -> DataFrame:
    return series_embeddings(df, encoder, "momentfm", **columns)


def extract_vision_embeddings(images: DataFrame, encoder=None, column: str = "image", **columns) -> DataFrame:
    return series_embeddings(images, encoder, "torchvision", series_col=column, **columns)


def series_embeddings(df: DataFrame, encoder=None, package: str = "torch", id_col: str = ID, target_col: str = Y, time_col: str = TIME, series_col: str | None = None) -> DataFrame:
    """``embedding`` per series by ``encoder(list of arrays) -> matrix``, in Arrow
    batches; without an encoder the package that would give one is asked for."""
    if encoder is None:
        optional(package)
        raise ValueError("give an encoder(list of arrays)")
    s = df.select(id_col, F.col(series_col).alias("series")) if series_col else as_series(df, target_col, id_col, time_col)

    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(encoder([np.asarray(x, float) for x in v]), float)))

    return s.select(id_col, run("series").alias("embedding"))


def _cluster_function(name: str):
    def run(df: DataFrame, k: int, runner=None, **options) -> DataFrame:
        return OPTIONAL_MODELS[name](runner, n_clusters=k, **options).fit(df).predict()

    run.__doc__ = f"Function form of {name}."
    return run


contrastive_cluster, dec_cluster, idec_cluster = (_cluster_function(n) for n in ("ContrastiveClusterer", "DECClusterer", "IDECClusterer"))


def build_forecast_df(forecasts: DataFrame, history: DataFrame, h: int, id_col: str = ID, time_col: str = TIME) -> DataFrame:
    """Future times, by the step of each series, for rows (id, forecast array)."""
    from tidepanel.panel import explode_horizon, median_step

    rows = explode_horizon(forecasts.join(median_step(history, id_col, time_col), id_col), h, id_col, time_col, history.schema[time_col].dataType)
    return rows.select(id_col, time_col, F.get("forecast", F.col("k") - 1).alias("y_hat"))


def extract_classification_data(df: DataFrame, label_col: str | None = None, id_col: str = ID, target_col: str = Y, time_col: str = TIME) -> DataFrame:
    """id, series padded with zeros to the longest, and the label's code."""
    s = as_series(df, target_col, id_col, time_col)
    widest = s.agg(F.max(F.size("series")).alias("__w"))
    s = s.crossJoin(F.broadcast(widest)).select(id_col, F.concat("series", F.array_repeat(F.lit(0.0), F.col("__w") - F.size("series"))).alias("series"))
    if label_col is None:
        return s
    from pyspark.sql import Window

    labels = df.groupBy(id_col).agg(F.min(label_col).alias("label"))
    codes = labels.select("label").distinct().withColumn("label_code", F.row_number().over(Window.orderBy("label")) - 1)
    return s.join(labels, id_col).join(F.broadcast(codes), "label", "left").select(id_col, "series", "label", "label_code")


def build_windows(df: DataFrame, input_size: int, h: int, target_col: str = Y, id_col: str = ID, time_col: str = TIME) -> DataFrame:
    """Sliding (input, target) arrays of every series."""
    w = by_time(id_col, time_col)
    rows = df.withColumn("input", F.collect_list(target_col).over(w.rowsBetween(1 - input_size, 0))).withColumn("target", F.collect_list(target_col).over(w.rowsBetween(1, h)))
    return rows.filter((F.size("input") == input_size) & (F.size("target") == h)).select(id_col, time_col, "input", "target")

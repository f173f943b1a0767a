"""A directory of models and experiments."""

from __future__ import annotations

import json
import pickle
import re
import shutil
import uuid
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Run:
    model_name: str
    config: dict = field(default_factory=dict)
    metrics: dict = field(default_factory=dict)
    tags: dict = field(default_factory=dict)
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    timestamp: str = field(default_factory=lambda: datetime.now(timezone.utc).isoformat())

    to_dict = asdict

    @classmethod
    def from_dict(cls, values: dict) -> Run:
        return cls(**values)


@dataclass
class Experiment:
    name: str
    runs: list[Run] = field(default_factory=list)

    def log_run(self, model_name: str, config: dict | None = None, metrics: dict | None = None, tags: dict | None = None) -> Run:
        self.runs.append(Run(model_name, config or {}, metrics or {}, tags or {}))
        return self.runs[-1]

    def best_run(self, metric: str, minimize: bool = True) -> Run:
        own = [r for r in self.runs if metric in r.metrics]
        if not own:
            raise ValueError(f"no run has the metric {metric!r}")
        return (min if minimize else max)(own, key=lambda r: r.metrics[metric])

    def to_dataframe(self, spark: SparkSession) -> DataFrame:
        rows = [(r.run_id, r.model_name, {k: str(v) for k, v in r.config.items()}, {k: float(v) for k, v in r.metrics.items()}, r.timestamp, {k: str(v) for k, v in r.tags.items()}) for r in self.runs]
        return spark.createDataFrame(rows, "run_id string, model_name string, config map<string,string>, metrics map<string,double>, timestamp string, tags map<string,string>")

    def leaderboard(self, spark: SparkSession, metric: str, minimize: bool = True) -> DataFrame:
        df = self.to_dataframe(spark).withColumn(metric, F.col("metrics")[metric])
        return df.orderBy(F.col(metric).asc_nulls_last() if minimize else F.col(metric).desc_nulls_last())

    def to_dict(self) -> dict:
        return {"name": self.name, "runs": [r.to_dict() for r in self.runs]}

    @classmethod
    def from_dict(cls, values: dict) -> Experiment:
        return cls(values["name"], [Run.from_dict(r) for r in values["runs"]])


class ModelRegistry:
    """``models/<name>/<version>/`` with a pickled model and its metadata, and
    ``experiments/<name>.json``. Only load what you have saved yourself."""

    def __init__(self, root: str):
        self.root = Path(root)

    @staticmethod
    def _safe(name: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_][A-Za-z0-9_.\-]*", name):
            raise ValueError(f"unsafe name {name!r}")
        return name

    def _folder(self, name: str, version: str | None = None) -> Path:
        path = self.root / "models" / self._safe(name)
        return path / self._safe(version) if version else path

    def save_model(self, name: str, model, version: str | None = None, metadata: dict | None = None) -> str:
        version = version or f"v{len(self.list_versions(name)) + 1}"
        folder = self._folder(name, version)
        folder.mkdir(parents=True, exist_ok=True)
        (folder / "model.pkl").write_bytes(pickle.dumps(model))
        number = max([self.get_metadata(name, v)["number"] for v in self.list_versions(name) if (self._folder(name, v) / "metadata.json").exists()], default=0) + 1
        (folder / "metadata.json").write_text(json.dumps({"name": name, "version": version, "number": number, "saved": datetime.now(timezone.utc).isoformat(), **(metadata or {})}))
        return version

    def _latest(self, name: str) -> str:
        versions = self.list_versions(name)
        if not versions:
            raise KeyError(f"no model {name!r}")
        return max(versions, key=lambda v: self.get_metadata(name, v)["number"])

    def load_model(self, name: str, version: str | None = None):
        path = self._folder(name, version or self._latest(name)) / "model.pkl"
        if not path.exists():
            raise KeyError(f"no version {version!r} of {name!r}")
        return pickle.loads(path.read_bytes())

    def get_metadata(self, name: str, version: str | None = None) -> dict:
        return json.loads((self._folder(name, version or self._latest(name)) / "metadata.json").read_text())

    def list_models(self) -> list[str]:
        return sorted(p.name for p in (self.root / "models").glob("*") if p.is_dir())

    def list_versions(self, name: str) -> list[str]:
        return sorted(p.name for p in self._folder(name).glob("*") if p.is_dir())

    def delete_model(self, name: str) -> None:
        shutil.rmtree(self._folder(name))

    def delete_version(self, name: str, version: str) -> None:
        shutil.rmtree(self._folder(name, version))

    def save_experiment(self, experiment: Experiment) -> None:
        (self.root / "experiments").mkdir(parents=True, exist_ok=True)
        (self.root / "experiments" / f"{self._safe(experiment.name)}.json").write_text(json.dumps(experiment.to_dict()))

    def load_experiment(self, name: str) -> Experiment:
        path = self.root / "experiments" / f"{self._safe(name)}.json"
        if not path.exists():
            raise KeyError(f"no experiment {name!r}")
        return Experiment.from_dict(json.loads(path.read_text()))

    def list_experiments(self) -> list[str]:
        return sorted(p.stem for p in (self.root / "experiments").glob("*.json"))

    def log_run(self, experiment: str, model_name: str, **values) -> Run:
        own = self.load_experiment(experiment) if experiment in self.list_experiments() else Experiment(experiment)
        run = own.log_run(model_name, **values)
        self.save_experiment(own)
        return run

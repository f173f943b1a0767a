"""Panel time-series analytics on Spark DataFrames.

Every public operator can be imported from here; modules load on first use.
"""

from __future__ import annotations

import importlib

_MODULES = (
    "operators.features", "operators.transforms", "operators.cleaning", "operators.metrics", "operators.forecasting", "operators.validation", "operators.ml", "operators.similarity", "operators.clustering",
    "operators.convolution", "operators.changepoint", "operators.imaging", "operators.bayes", "operators.reconcile", "operators.agents", "functions.statespace", "functions.views", "sources.adapters", "sources.registry", "streaming.state",
)


def __getattr__(name: str):
    if name.startswith("_"):
        raise AttributeError(name)
    for path in _MODULES:
        module = importlib.import_module(f"tidepanel.{path}")
        if name in vars(module):
            return vars(module)[name]
        if name in getattr(module, "OPTIONAL_MODELS", {}):
            return module.OPTIONAL_MODELS[name]
    raise AttributeError(f"tidepanel has no operator {name!r}")


class Accessor:
    """``pts(df).rolling_features([7])``: any operator on a frame as a method."""

    def __init__(self, df):
        self._df = df

    def __getattr__(self, name: str):
        operator = __getattr__(name)
        return lambda *args, **options: operator(self._df, *args, **options)


pts = Accessor

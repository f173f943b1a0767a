"""Hierarchical reconciliation.

A hierarchy is a dict child -> parent or child -> [parents]. Its closure (node,
leaf) is a small table; every method is a join with weights and one aggregation
per node and time, so panels of any length reconcile without leaving Spark.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.panel import ID, TIME, ensure, ratio

METHODS = ("bottom_up", "top_down", "middle_out", "ols", "permbu", "mint_cv")


def parents_of(hierarchy: dict) -> dict[str, list[str]]:
    return {c: [p] if isinstance(p, str) else list(p) for c, p in hierarchy.items()}


def closure(hierarchy: dict) -> tuple[list[str], list[str], np.ndarray]:
    """Leaves, all nodes (leaves last) and the summing matrix (nodes by leaves)."""
    up = parents_of(hierarchy)
    inner = sorted({p for ps in up.values() for p in ps})
    leaves = sorted(c for c in up if c not in inner)
    nodes = inner + leaves
    s = np.zeros((len(nodes), len(leaves)))
    for j, leaf in enumerate(leaves):
        seen, todo = set(), [leaf]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                s[nodes.index(n), j] = 1
                todo += up.get(n, [])
    return leaves, nodes, s


def _weights(spark, rows: list[tuple[str, str, float]]) -> DataFrame:
    """(node, from, w); as many rows as the hierarchy has entries."""
    return spark.createDataFrame(rows, "__node string, __from string, __w double")


def weighted_sum(df: DataFrame, weights: DataFrame, cols: list[str], id_col: str, time_col: str) -> DataFrame:
    joined = df.join(F.broadcast(weights), df[id_col].cast("string") == weights["__from"])
    return joined.groupBy(F.col("__node").alias(id_col), time_col).agg(*[F.sum(F.col(c) * F.col("__w")).alias(c) for c in cols])


def _project(df: DataFrame, hierarchy: dict, p: np.ndarray, nodes: list[str], cols: list[str], id_col: str, time_col: str) -> DataFrame:
    rows = [(nodes[i], nodes[j], float(p[i, j])) for i in range(len(nodes)) for j in range(len(nodes)) if abs(p[i, j]) > 1e-15]
    return weighted_sum(df, _weights(df.sparkSession, rows), cols, id_col, time_col)


def bottom_up(df: DataFrame, hierarchy: dict, cols: list[str], id_col: str = ID, time_col: str = TIME) -> DataFrame:
    """Every node is the sum of its leaves (leaves that miss count 0)."""
    leaves, nodes, s = closure(hierarchy)
    rows = [(n, leaf, 1.0) for i, n in enumerate(nodes) for j, leaf in enumerate(leaves) if s[i, j]]
    return weighted_sum(df, _weights(df.sparkSession, rows), cols, id_col, time_col)


def _shares(df: DataFrame, hierarchy: dict, tops: list[str], col: str, id_col: str, time_col: str) -> DataFrame:
    """Leaf forecasts as mean historical share times the forecast of its top."""
    leaves, nodes, s = closure(hierarchy)
    under = [(t, leaf, 1.0) for t in tops for j, leaf in enumerate(leaves) if s[nodes.index(t), j]]
    w = _weights(df.sparkSession, under)
    own = df.join(F.broadcast(w), df[id_col].cast("string") == w["__from"])
    share = own.groupBy("__node", "__from").agg(F.sum(col).alias("__s"))
    total = share.groupBy("__node").agg(F.sum("__s").alias("__t"))
    share = share.join(total, "__node").select("__node", "__from", ratio("__s", "__t").alias("__w"))
    top = df.select(F.col(id_col).cast("string").alias("__node"), time_col, F.col(col).alias("__y"))
    return top.join(F.broadcast(share), "__node").select(F.col("__from").alias(id_col), time_col, (F.col("__y") * F.col("__w")).alias(col))


def top_down(df: DataFrame, hierarchy: dict, col: str, id_col: str = ID, time_col: str = TIME) -> DataFrame:
    up = parents_of(hierarchy)
    tops = sorted({p for ps in up.values() for p in ps} - set(up))
    return bottom_up(_shares(df, hierarchy, tops, col, id_col, time_col), hierarchy, [col], id_col, time_col)


def middle_out(df: DataFrame, hierarchy: dict, col: str, middle_level: list[str], id_col: str = ID, time_col: str = TIME) -> DataFrame:
    ensure(bool(middle_level), "middle_out needs middle_level")
    return bottom_up(_shares(df, hierarchy, list(middle_level), col, id_col, time_col), hierarchy, [col], id_col, time_col)


def projection(s: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """S (S' W S)+ S' W, W the identity or an inverse covariance."""
    w = np.eye(len(s)) if w is None else w
    return s @ np.linalg.pinv(s.T @ w @ s) @ s.T @ w


def reconcile(df: DataFrame, hierarchy: dict, method: str = "bottom_up", forecast_col: str = "y_hat", id_col: str = ID, time_col: str = TIME, *, middle_level: list[str] | None = None, residuals: DataFrame | None = None, train_data: DataFrame | None = None, n_folds: int = 5, interval_cols: list[str] | None = None, residual_col: str = "residual", target_col: str = "y") -> DataFrame:
    """Coherent forecasts (id, time, forecast) of all nodes."""
    ensure(method in METHODS, f"method must be of {METHODS}")
    cols = [forecast_col, *(interval_cols or [])]
    if method == "bottom_up":
        return bottom_up(df, hierarchy, cols, id_col, time_col)
    if method == "top_down":
        return top_down(df, hierarchy, forecast_col, id_col, time_col)
    if method == "middle_out":
        return middle_out(df, hierarchy, forecast_col, middle_level or [], id_col, time_col)
    if method == "ols":
        _, nodes, s = closure(hierarchy)
        return _project(df, hierarchy, projection(s), nodes, cols, id_col, time_col)
    from tidepanel.operators.mint import Mint

    solver = Mint(df.sparkSession, parents_of(hierarchy))
    if method == "permbu":
        ensure(residuals is not None, "permbu needs residuals")
        solver.residuals(residuals, id_col, time_col, residual_col)
    else:
        ensure(train_data is not None, "mint_cv needs train_data")
        solver.residuals(train_data, id_col, time_col, target_col, n_folds)
    out = None
    for c in cols:
        # Sums of the reconciled leaves, which the solve gives up to its tolerance.
        part = bottom_up(solver.reconcile(df, id_col, time_col, c), hierarchy, [c], id_col, time_col)
        out = part if out is None else out.join(part, [id_col, time_col])
    return out

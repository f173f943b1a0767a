"""Conjugate gradients for minimum-trace reconciliation against dense formulas."""

from datetime import date, timedelta

import numpy as np
import pytest

from tidepanel.operators.mint import Mint
from tidepanel.operators.reconcile import closure, parents_of, reconcile


def day(k):
    return date(2024, 1, 1) + timedelta(days=int(k))


def table(spark, values, names, col):
    rows = [(n, day(t), float(x)) for n, line in zip(names, values) for t, x in enumerate(line) if not np.isnan(x)]
    return spark.createDataFrame(rows, f"unique_id string, ds date, {col} double").repartition(4)


def dense(s, w, y):
    inverse = np.linalg.inv(w)
    return s @ np.linalg.solve(s.T @ inverse @ s, s.T @ inverse @ y)


TREE = {"A": "X", "B": "X", "C": "Y", "D": "Y", "E": "Y", "X": "Total", "Y": "Total"}
GROUPED = {"A": ["X", "P"], "B": ["X", "Q"], "C": ["Y", "P"], "D": ["Y", "Q"], "X": ["Total"], "Y": ["Total"]}


@pytest.mark.parametrize("hierarchy", [TREE, GROUPED])
def test_solve_equals_the_dense_formula(spark, hierarchy):
    rng = np.random.default_rng(1)
    _, nodes, s = closure(hierarchy)
    n, span = len(nodes), 9
    y = np.abs(rng.normal(100, 30, (n, 3)))
    e = rng.normal(size=(n, span)) * rng.uniform(0.5, 3, n)[:, None]
    e[2, 4] = np.nan
    df, residuals = table(spark, y, nodes, "y_hat"), table(spark, e, nodes, "residual")
    filled = np.nan_to_num(e)
    w = 0.5 * filled @ filled.T / span
    w = w + np.diag(np.diag(w)) + 1e-8 * np.eye(n)
    got = {(r.unique_id, r.ds): r.y_hat for r in reconcile(df, hierarchy, "permbu", residuals=residuals).collect()}
    want = dense(s, w, y)
    np.testing.assert_allclose([[got[m, day(k)] for k in range(3)] for m in nodes], want, rtol=1e-8)
    # The solve itself is coherent, before leaves are summed up.
    solver = Mint(spark, parents_of(hierarchy)).residuals(residuals, "unique_id", "ds", "residual")
    raw = {(r.unique_id, r.ds): r.y_hat for r in solver.reconcile(df, "unique_id", "ds", "y_hat").collect()}
    np.testing.assert_allclose([[raw[m, day(k)] for k in range(3)] for m in nodes], want, rtol=1e-7)
    # Folds.
    folds, train = 3, rng.normal(50, 10, (n, 10))
    w = np.zeros((n, n))
    for f in range(folds):
        val = np.arange(f * 3, 10 if f == folds - 1 else f * 3 + 3)
        rest = train[:, val] - np.delete(train, val, axis=1).mean(1, keepdims=True)
        w += rest @ rest.T / len(val) / folds
    w = 0.5 * w + 0.5 * np.diag(np.diag(w)) + 1e-8 * np.eye(n)
    cv = reconcile(df, hierarchy, "mint_cv", train_data=table(spark, train, nodes, "y"), n_folds=folds)
    got = {(r.unique_id, r.ds): r.y_hat for r in cv.collect()}
    np.testing.assert_allclose([[got[m, day(k)] for k in range(3)] for m in nodes], dense(s, w, y), rtol=1e-8)


def test_many_nodes_without_pairs(spark):
    """Three levels, 600 nodes: coherent, and nothing of pairs of nodes is made."""
    rng = np.random.default_rng(2)
    tree = {f"leaf{i}": f"mid{i % 12}" for i in range(587)} | {f"mid{i}": "top" for i in range(12)}
    _, nodes, s = closure(tree)
    y = np.abs(rng.normal(100, 30, (len(nodes), 2)))
    e = rng.normal(size=(len(nodes), 4)) * rng.uniform(0.5, 2, len(nodes))[:, None]
    df, residuals = table(spark, y, nodes, "y_hat"), table(spark, e, nodes, "residual")
    solver = Mint(spark, parents_of(tree)).residuals(residuals, "unique_id", "ds", "residual")
    assert solver.e.count() == len(nodes) and solver.span == 4
    out = solver.reconcile(df, "unique_id", "ds", "y_hat")
    got = {(r.unique_id, r.ds): r.y_hat for r in out.collect()}
    mine = np.array([[got[m, day(k)] for k in range(2)] for m in nodes])
    np.testing.assert_allclose(mine, s @ mine[-587:], rtol=1e-6)
    w = 0.5 * e @ e.T / 4
    np.testing.assert_allclose(mine, dense(s, w + np.diag(np.diag(w)) + 1e-8 * np.eye(len(nodes)), y), rtol=1e-5)


def test_what_is_refused(spark):
    df = table(spark, np.ones((8, 1)), sorted({*TREE, "Total"}), "y_hat")
    for method in ("permbu", "mint_cv"):
        with pytest.raises(ValueError):
            reconcile(df, TREE, method)
    with pytest.raises(ValueError):
        reconcile(df, TREE, "mint_cv", train_data=df.withColumnRenamed("y_hat", "y"))
    with pytest.raises(RuntimeError):
        Mint(spark, parents_of(TREE), tolerance=1e-30, most_rounds=1).residuals(df, "unique_id", "ds", "y_hat").reconcile(df, "unique_id", "ds", "y_hat")

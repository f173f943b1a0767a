"""Results do not change with the scale of the values."""

import numpy as np
import pytest


def test_var_and_granger_of_large_values(spark):
    from tidepanel.operators.changepoint import granger_causality, var_fit

    rng = np.random.default_rng(4)
    v = 1000 + rng.normal(0, 50, (30, 2)).cumsum(axis=0) / 5
    frame = lambda scale: spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(v * scale)], "ds long, a double, b double")
    small, large = (granger_causality(frame(s), "a", "b", 1).first() for s in (1, 3000))
    assert large.f_statistic == pytest.approx(small.f_statistic, rel=1e-6)
    one, two = (var_fit(frame(s), ["a", "b"], 2).coefficients for s in (1, 3000))
    assert two[:, :-1] == pytest.approx(one[:, :-1], rel=1e-6) and two[:, -1] == pytest.approx(3000 * one[:, -1], rel=1e-6)


def test_simplex_weights_of_nearly_equal_donors():
    from tidepanel.functions.stats import simplex_least_squares

    rng = np.random.default_rng(6)
    a, b = (34_000 + rng.normal(0, 100, 20) for _ in range(2))
    y = 0.3 * a + 0.7 * b + rng.normal(0, 500, 20)
    w = min(1, max(0, (y - b) @ (a - b) / ((a - b) @ (a - b))))
    assert simplex_least_squares(np.stack([a, b], axis=1), y) == pytest.approx([w, 1 - w], abs=1e-9)
    many = 34_000 + rng.normal(0, 300, (25, 6))
    y = many @ [0.5, 0.25, 0.25, 0, 0, 0] - many[:, 5] * 0.1 + 3_400
    got = simplex_least_squares(many, y)
    gain = many.T @ (many @ got - y)
    level = gain[got > 0].mean()
    # At the minimum no weight above 0 can be moved, and none at 0 should be raised.
    assert got.min() >= 0 and got.sum() == pytest.approx(1) and np.abs(gain[got > 0] - level).max() < 1e-2 and (gain >= level - 1e-2).all()

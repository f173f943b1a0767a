"""Row numbers, permutations and lags of long frames against plain forms."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.operators import changepoint, metrics
from tidepanel.operators.rows import lagged, numbered, permutation_keys, permuted


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def frame(spark, n=230, parts=5, seed=1):
    """Times with ties and gaps, and a null."""
    rng = random.Random(seed)
    rows = [(rng.randrange(n) * (1 + i % 3), float(rng.randrange(4)), rng.gauss(0, 1)) for i in range(n)] + [(None, 1.0, 2.0)]
    return spark.createDataFrame(rows, "ds long, x double, y double").repartition(parts)


@pytest.mark.parametrize("parts", [1, 7])
def test_numbers_are_dense_and_in_order(spark, parts):
    df = frame(spark, parts=parts)
    rows, n = numbered(df, ["ds", "x", "y"])
    assert n == 231 and "SinglePartition" not in plan_of(rows)
    got = rows.orderBy("__i").collect()
    assert [r["__i"] for r in got] == list(range(n))
    key = lambda r: (r.ds is not None, r.ds or 0, r.x, r.y)
    assert [key(r) for r in got] == sorted(key(r) for r in df.collect())
    plain, m = numbered(df)
    assert m == n and sorted(r["__i"] for r in plain.collect()) == list(range(n))
    none, zero = numbered(df.limit(0), ["ds"])
    assert zero == 0 and none.count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 24, 25, 26, 1000])
def test_permutations_are_bijections(spark, n):
    seen = set()
    for slot in range(3):
        keys = permutation_keys(42, slot)
        plain = permuted(np.arange(n), n, keys)
        assert sorted(plain) == list(range(n))
        mine = spark.range(n).select("id", permuted(F.col("id"), n, keys).alias("to")).collect()
        assert [r.to for r in sorted(mine)] == plain.tolist()
        seen.add(tuple(plain))
    assert n < 4 or len(seen) == 3


def test_long_ranges_come_back(spark):
    """Two halves that hold far more than 32 bits."""
    n = 10**15 + 7
    i = np.random.default_rng(0).integers(0, n, 2000)
    to = permuted(i, n, permutation_keys(1))
    assert ((to >= 0) & (to < n)).all() and len(set(to.tolist())) == len(set(i.tolist())) and abs(np.corrcoef(i, to)[0, 1]) < 0.1
    df = spark.createDataFrame([(int(x),) for x in i[:50]], "i long")
    assert [r[0] for r in df.select(permuted(F.col("i"), n, permutation_keys(1))).collect()] == to[:50].tolist()


@pytest.mark.parametrize("chunk,p,parts", [(1, 1, 3), (7, 3, 1), (7, 3, 6), (4, 9, 5), (10_000, 2, 4)])
def test_lags_equal_one_window(spark, chunk, p, parts):
    df = frame(spark, parts=parts)
    got = lagged(df, ["x", "y"], p, ["ds", "x", "y"], chunk)
    assert "SinglePartition" not in plan_of(got)
    w = Window.orderBy("ds", "x", "y")
    want = df.select("*", *[F.lag(c, k).over(w).alias(f"__{c}_{k}") for k in range(1, p + 1) for c in ("x", "y")])
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_var_and_granger_whatever_the_chunks(spark):
    rng = np.random.default_rng(3)
    x, y = [0.0, 0.0], [0.0, 0.0]
    for _ in range(310):
        x.append(0.4 * x[-1] + rng.normal())
        y.append(0.3 * y[-1] + 0.5 * x[-2] + rng.normal())
    rows = [(i * 2 + i % 2, a, b if i % 50 else None) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "ds long, x double, y double").repartition(4)
    plain = pd.DataFrame(rows, columns=["ds", "x", "y"]).sort_values("ds")
    for k in (1, 2):
        plain[[f"x{k}", f"y{k}"]] = plain[["x", "y"]].shift(k)
    m = plain.dropna()
    a = np.column_stack([m[["x1", "y1", "x2", "y2"]].to_numpy(), np.ones(len(m))])
    want = np.linalg.lstsq(a, m[["x", "y"]].to_numpy(), rcond=None)[0].T
    models = [changepoint.var_fit(df, ["x", "y"], 2, chunk=c) for c in (3, 50, None)]
    for model in models:
        np.testing.assert_allclose(model.coefficients, want, atol=1e-9)
        np.testing.assert_allclose(model.last_values, plain[["x", "y"]].to_numpy()[-2:])
    ahead = changepoint.var_forecast(models[0], 1, spark).first()
    np.testing.assert_allclose([ahead.x, ahead.y], want @ np.array([x[-1], y[-1], x[-2], y[-2], 1.0]), atol=1e-9)
    both = [changepoint.granger_causality(df, "x", "y", 3, chunk=c).collect() for c in (5, None)]
    assert [r.lag for r in both[0]] == [1, 2, 3]
    np.testing.assert_allclose([r.f_statistic for r in both[0]], [r.f_statistic for r in both[1]], rtol=1e-7)
    # By hand, two lags.
    own = a[:, [1, 3, 4]]
    rest = [((m["y"].to_numpy() - d @ np.linalg.lstsq(d, m["y"].to_numpy(), rcond=None)[0]) ** 2).sum() for d in (own, a)]
    f = (rest[0] - rest[1]) / 2 / (rest[1] / (len(m) - 5))
    assert both[0][1].f_statistic == pytest.approx(f) and both[0][1].p_value < 0.001
    with pytest.raises(ValueError):
        changepoint.var_fit(df.limit(0), ["x", "y"])


class Line:
    def __init__(self, *b):
        self.b = np.array(b, float)

    def predict(self, x):
        return x @ self.b


def test_importance_shuffles_each_feature_whole(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    y = x @ [3.0, 1.0, 0.0]
    df = spark.createDataFrame([(*map(float, r), float(v), "z") for r, v in zip(x, y)], "a double, b double, c double, y double, __new string").repartition(5)
    named = df.select(F.col("a").alias("__x0"), F.col("b").alias("__x1"), F.col("c").alias("__x2"))
    rows, slots = metrics.shuffled_values(named, ["__x0", "__x1", "__x2"], 30, 7)
    assert "SinglePartition" not in plan_of(rows) and len(slots) == 90
    table = rows.toPandas()
    new = np.stack(table["__new"].to_numpy())
    for s, (j, _) in enumerate(slots):
        np.testing.assert_allclose(np.sort(new[:, s]), np.sort(x[:, j]))
        assert (new[:, s] != table[f"__x{j}"]).mean() > 0.9
    got = metrics.permutation_importance(df, Line(3, 1, 0), ["a", "b", "c"], n_repeats=4)
    found = {r.feature: r for r in got.collect()}
    assert [r.feature for r in got.collect()] == ["a", "b", "c"]
    assert found["c"].importance_mean == 0 and 2.4 < found["a"].importance_mean < 4.6 and 0.8 < found["b"].importance_mean < 1.5
    assert 0 < found["a"].importance_std < 0.5
    square = metrics.permutation_importance(df, Line(3), ["a"], metric_fn=lambda t, p: F.sqrt(F.avg((t - p) * (t - p))), n_repeats=2)
    assert 2 < square.first().importance_mean < 5.5
    again = metrics.permutation_importance(df, Line(3, 1, 0), ["a", "b", "c"], n_repeats=4, order=["a", "b", "c"]).collect()
    assert again == metrics.permutation_importance(df.repartition(2), Line(3, 1, 0), ["a", "b", "c"], n_repeats=4, order=["a", "b", "c"]).collect()
    assert metrics.permutation_importance(df.limit(0), Line(1), ["a"]).first().importance_mean is None
    for bad in ({"feature_cols": []}, {"feature_cols": ["a"], "n_repeats": 0}):
        with pytest.raises(ValueError):
            metrics.permutation_importance(df, Line(1), **bad)

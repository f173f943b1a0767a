"""Particle histories and smoothing, and roles of covariates in causal effects."""

import warnings
from datetime import date, timedelta

import numpy as np
import pytest

from tidepanel.functions.statespace import ParticleFilter, local_level_density, local_level_loglik, local_level_transition


def level(n=30, seed=1):
    rng = np.random.default_rng(seed)
    x = np.cumsum(rng.normal(0, 0.7, n))
    return x + rng.normal(0, 1.0, n)


def test_history_and_genealogies():
    y = level(20)
    plain = ParticleFilter(100, local_level_transition(0.7), local_level_loglik(1.0)).filter(y)
    assert plain.particles_history is None and plain.weights_history is None
    for bad in (plain.genealogies, lambda: plain.smoothed_paths(local_level_density())):
        with pytest.raises(ValueError):
            bad()
    got = ParticleFilter(100, local_level_transition(0.7), local_level_loglik(1.0), store_history=True).filter(y)
    np.testing.assert_array_equal(got.filtered_mean, plain.filtered_mean)
    assert got.particles_history.shape == got.weights_history.shape == got.ancestors.shape == (20, 100)
    np.testing.assert_allclose(got.weights_history.sum(1), 1)
    np.testing.assert_allclose((got.weights_history * got.particles_history).sum(1), got.filtered_mean)
    # Every path by hand: from each last particle to its ancestors.
    paths = got.genealogies()
    for j in (0, 17, 99):
        place, walk = j, [got.particles_history[-1][j]]
        for t in range(18, -1, -1):
            place = got.ancestors[t][place]
            walk.append(got.particles_history[t][place])
        np.testing.assert_array_equal(paths[:, j], walk[::-1])
    assert len(np.unique(paths[0])) < len(np.unique(paths[-1])) == 100
    # Steps of a path are steps of the transition.
    assert np.abs(np.diff(paths, axis=0)).std() < 1.5
    for bad in (dict(n_particles=1), dict(resample_method="odd"), dict(resample_threshold=0.0)):
        with pytest.raises(ValueError):
            ParticleFilter(**bad)


def test_backward_simulation_meets_the_kalman_smoother():
    y = level(40)
    y[7] = np.nan
    got = ParticleFilter(3000, local_level_transition(0.7), local_level_loglik(1.0), store_history=True, seed=3).filter(y)
    drawn = got.smoothed_paths(local_level_density(0.7), paths=2000, seed=4)
    # The exact smoother of the same model, by one linear solve: prior precision of
    # the walk (from N(y0, 1), moved once) plus the precision of what was seen.
    n = len(y)
    q = 0.49
    walk = np.zeros((n, n))
    walk[0, 0] += 1 / (1 + q)
    for t in range(1, n):
        walk[t, t] += 1 / q
        walk[t - 1, t - 1] += 1 / q
        walk[t, t - 1] -= 1 / q
        walk[t - 1, t] -= 1 / q
    seen = ~np.isnan(y)
    post = np.linalg.inv(walk + np.diag(seen.astype(float)))
    prior = np.zeros(n)
    prior[0] = y[0] / (1 + q)
    mean = post @ (prior + np.where(seen, np.nan_to_num(y), 0.0))
    error = 5 * np.sqrt(np.diag(post)) / np.sqrt(300)
    assert (np.abs(drawn.mean(1) - mean) < error).all()
    np.testing.assert_allclose(drawn.var(1), np.diag(post), rtol=0.4)


def test_smoother_of_a_panel(spark):
    from tidepanel.operators.bayes import particle_smoother

    y = level(15)
    rows = [(u, i, float(v)) for u in "ab" for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "unique_id string, ds long, y double").repartition(3)
    got = particle_smoother(df, local_level_transition(0.7), local_level_loglik(1.0), local_level_density(0.7), n_particles=500).orderBy("unique_id", "ds").collect()
    assert len(got) == 30 and [r.smoothed_mean for r in got[:15]] == [r.smoothed_mean for r in got[15:]]
    own = ParticleFilter(500, local_level_transition(0.7), local_level_loglik(1.0), store_history=True).filter(y).smoothed_paths(local_level_density(0.7), 200, 42)
    np.testing.assert_allclose([r.smoothed_mean for r in got[:15]], own.mean(1))


def treated(spark, demand_after=5.0):
    rng = np.random.default_rng(0)
    day = lambda i: date(2024, 1, 1) + timedelta(days=i)
    weather, demand = rng.normal(10, 2, 80), rng.normal(5, 1, 80)
    y = 20 + 2 * weather + 3 * demand + rng.normal(0, 0.3, 80)
    demand[60:] += demand_after
    y[60:] += 6
    rows = [("A", day(i), float(y[i]), float(weather[i]), float(demand[i])) for i in range(80)]
    return spark.createDataFrame(rows, "unique_id string, ds date, y double, weather double, demand double").repartition(2), day(60)


def test_roles_of_covariates(spark):
    from tidepanel.operators.bayes import CausalImpact, causal_impact, covariate_roles

    df, when = treated(spark)
    both = ["weather", "demand"]
    run = lambda df, roles, **more: causal_impact(df, when, trend="level", covariates=both, covariate_role=roles, **more).orderBy("ds").collect()
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        apart = run(df, {"weather": "always", "demand": "pre_only"})
    with pytest.warns(UserWarning, match="All covariates"):
        every = run(df, {"weather": "always", "demand": "always"})
    total = lambda rows: sum(r.point_effect for r in rows)
    assert len(apart) == 20 and total(apart) > 60 and total(apart) > total(every) + 100
    # What a pre_only covariate does later leaves the counterfactual where it is.
    other, _ = treated(spark, demand_after=50.0)
    again = run(other, {"weather": "always", "demand": "pre_only"})
    np.testing.assert_allclose([r.counterfactual for r in again], [r.counterfactual for r in apart])
    # An always covariate moves it by its coefficient.
    from pyspark.sql import functions as F

    moved = run(df.withColumn("weather", F.col("weather") + F.when(F.col("ds") >= F.lit(when), 1.0).otherwise(0.0)), {"weather": "always", "demand": "pre_only"})
    np.testing.assert_allclose([a.counterfactual - b.counterfactual for a, b in zip(moved, apart)], 2.0, atol=0.1)
    with pytest.warns(UserWarning, match="covariate_role"):
        assert covariate_roles(both, {"weather": "pre_only"}) == {"weather": "pre_only", "demand": "always"}
    with pytest.warns(UserWarning, match="covariate_role"):
        causal_impact(df, when, covariates=["weather"])
    with pytest.raises(ValueError, match="nonexistent"):
        CausalImpact(covariates=["nonexistent"]).fit(df, when)
    with pytest.raises(ValueError):
        covariate_roles(both, {"weather": "sometimes", "demand": "always"})
    holes = df.withColumn("demand", F.when(F.dayofmonth("ds") != 3, F.col("demand")))
    with pytest.raises(ValueError, match="demand"):
        CausalImpact(covariates=both, covariate_role={"weather": "always", "demand": "pre_only"}).fit(holes, when)
    assert CausalImpact(covariates=both, covariate_role={"weather": "always", "demand": "pre_only"}).fit(df, when).placebo_test(date(2024, 2, 10)).count() == 1


def donors(spark, late=True):
    rng = np.random.default_rng(7)
    day = lambda i: date(2024, 1, 1) + timedelta(days=i)
    y = {k: 10 * (k + 1) + np.cumsum(rng.normal(size=40)) for k in range(3)}
    temp = {k: rng.normal(15 + 2 * k, 3, 40) for k in range(3)}
    own = 0.6 * y[0] + 0.3 * y[1] + 0.1 * y[2] + rng.normal(0, 0.2, 40)
    heat = 0.6 * temp[0] + 0.3 * temp[1] + 0.1 * temp[2] + rng.normal(0, 0.2, 40)
    own[25:] += 5
    heat[25:] += 2
    rows = [("treated", day(i), float(own[i]), float(heat[i])) for i in range(40)]
    rows += [(f"D{k}", day(i), float(y[k][i]), float(temp[k][i])) for k in range(3) for i in range(40)]
    rows += [("short", day(i), 1.0, 1.0) for i in range(30)] + [("moved", day(i + 1), 1.0, 1.0) for i in range(40)]
    return spark.createDataFrame(rows, "unique_id string, ds date, y double, heat double").repartition(3), day(25), y, temp, own, heat


def test_synthetic_control_with_covariates(spark):
    from tidepanel.operators.bayes import SyntheticControl

    df, when, y, temp, own, heat = donors(spark)
    model = SyntheticControl(covariates=["heat"], covariate_role={"heat": "pre_only"}).fit(df, "treated", when)
    # Donors with other times are out.
    assert model.donor_ids_ == ["D0", "D1", "D2"] and abs(sum(model.weights_) - 1) < 1e-6
    # A grid search over the simplex, the covariate scaled to the target's spread.
    scale = own[:25].std() / heat[:25].std()
    loss = lambda w: ((own[:25] - sum(w[k] * y[k][:25] for k in range(3))) ** 2).sum() + ((scale * (heat[:25] - sum(w[k] * temp[k][:25] for k in range(3)))) ** 2).sum()
    grid = [(a / 200, b / 200, 1 - (a + b) / 200) for a in range(201) for b in range(201 - a)]
    best = min(grid, key=loss)
    np.testing.assert_allclose(model.weights_, best, atol=0.006)
    assert loss(model.weights_) <= loss(best) + 1e-6
    counter = [r.counterfactual for r in model.to_frame().orderBy("ds").collect()]
    np.testing.assert_allclose(counter, sum(w * y[k][25:] for k, w in enumerate(model.weights_)), rtol=1e-9)
    balance = model.balance_.first()
    assert balance.covariate == "heat" and balance.treated_mean == pytest.approx(heat[:25].mean()) and balance.abs_diff == pytest.approx(abs(balance.treated_mean - balance.synthetic_mean))
    # always: the treated series' own covariate moves the counterfactual after the intervention.
    with pytest.warns(UserWarning, match="All covariates"):
        always = SyntheticControl(covariates=["heat"], covariate_role={"heat": "always"}).fit(df, "treated", when)
    np.testing.assert_allclose(always.weights_, model.weights_)
    beyond = heat[25:] - sum(w * temp[k][25:] for k, w in enumerate(model.weights_))
    np.testing.assert_allclose([r.counterfactual for r in always.to_frame().orderBy("ds").collect()], np.array(counter) + beyond, rtol=1e-9)
    plain = SyntheticControl().fit(df, "treated", when, ["D1"])
    assert plain.balance_ is None and plain.weights_.tolist() == [1.0]
    for bad in (lambda: SyntheticControl().fit(df, "nobody", when), lambda: SyntheticControl().fit(df, "treated", when, ["short"]), lambda: SyntheticControl(covariates=["odd"]).fit(df, "treated", when), lambda: SyntheticControl().fit(df, "treated", date(2030, 1, 1))):
        with pytest.raises(ValueError):
            bad()

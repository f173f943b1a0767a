"""Complex smoothing, interval sketches and direct forecasts with covariates."""

from datetime import date, timedelta

import numpy as np
import pytest

from tidepanel.functions import ces


def by_complex_numbers(v, a, h, m=None, b=None, beta=None, z=None, season=None):
    """The recursion of the paper in complex arithmetic, its input y + i (y - forecast)."""
    seen, out = [], []
    z, season = z, None if season is None else list(season)
    for t in range(len(v) + h):
        parts = ([z] if z is not None else []) + ([season[t % m]] if season is not None else [])
        level = sum(p.real for p in parts)
        e = v[t] - level if t < len(v) else 0.0
        (seen if t < len(v) else out).append(e if t < len(v) else level)
        step = lambda s, rate: (rate * (s.real + e + 1j * e)) + (1 - rate + 1j) * s
        if z is not None:
            z = step(z, a)
        if season is not None:
            season[t % m] = season[t % m] + beta * e if beta is not None else step(season[t % m], b)
    return np.array(out), np.array(seen)


def test_states_follow_complex_arithmetic():
    rng = np.random.default_rng(0)
    t = np.arange(40)
    v = 20 + 0.3 * t + 5 * np.sin(2 * np.pi * t / 7) + rng.normal(size=40)
    level = v[:10].mean()
    z = level + 1j * level / 1.1
    cases = {
        "none": ([1.2, 0.9], dict(z=z)),
        "simple": ([1.2, 0.9], dict(m=7, b=1.2 + 0.9j, season=v[:7] * (1 + 1j / 1.1))),
        "partial": ([1.2, 0.9, 0.2], dict(z=z, m=7, beta=0.2)),
        "full": ([1.2, 0.9, 1.1, 0.8], dict(z=z, m=7, b=1.1 + 0.8j)),
    }
    phases = v[:35].reshape(5, 7).mean(0)
    phases = phases - phases.mean()
    cases["partial"][1]["season"] = phases
    cases["full"][1]["season"] = phases * (1 + 1j / 1.1)
    for form, (rates, args) in cases.items():
        got = ces.run(v, np.array(rates), form, 7, 10)
        want = by_complex_numbers(v, complex(*rates[:2]), 10, **args)
        np.testing.assert_allclose(got[0], want[0], rtol=1e-9)
        np.testing.assert_allclose(got[1], want[1], rtol=1e-9, atol=1e-9)


def test_rates_are_fitted_and_forms_chosen():
    rng = np.random.default_rng(1)
    t = np.arange(84)
    wave = 50 + 10 * np.sin(2 * np.pi * t / 7) + rng.normal(0, 0.1, 84)
    form, rates = ces.auto(wave[:77], 7)
    assert form != "none" and np.abs(ces.run(wave[:77], rates, form, 7, 7)[0] - wave[77:]).max() < 1.5
    for kind in ces.FORMS:
        start = np.array([1.3, 1.0, 0.1] if kind == "partial" else [1.3, 1.0] * 2 if kind == "full" else [1.3, 1.0])
        found, score = ces.fit(wave, kind, 7)
        assert np.isfinite(score) and ces._loss(wave, found, kind, 7) <= ces._loss(wave, start[: ces.rates_of(kind)], kind, 7)
    assert ces.auto(np.array([3.0]))[0] == "none" and ces.auto(wave[:9], 7)[0] == "none"
    assert np.isfinite(ces.run(np.array([3.0]), np.array([1.3, 1.0]), "none", 1, 3)[0]).all()


def panel(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


def day(i):
    return date(2024, 1, 1) + timedelta(days=int(i))


def test_complex_smoothing_of_a_panel_and_its_ensemble(spark):
    from tidepanel.operators.forecasting import SCUM, ces_forecast

    t = np.arange(60)
    y = 50 + np.sin(2 * np.pi * t / 24) * 8
    df = panel(spark, [("a", day(i), float(v)) for i, v in enumerate(y)] + [("b", day(i), None) for i in range(4)] + [("c", day(0), 2.0)], "unique_id string, ds date, y double")
    got = {(r.unique_id, r.ds): r.y_hat for r in ces_forecast(df, 5, form="none", rates=(1.2, 0.9)).collect()}
    np.testing.assert_allclose([got["a", day(60 + k)] for k in range(5)], ces.run(y, np.array([1.2, 0.9]), "none", 1, 5)[0])
    assert {u for u, _ in got} == {"a", "c"} and ces_forecast(df, 2, 24).count() == 4
    own = SCUM(24).members(y, 5)[0]
    assert own.shape == (4, 5)
    form, rates = ces.auto(y, 24)
    np.testing.assert_allclose(own[2], ces.run(y, rates, form, 24, 5)[0])
    mine = SCUM(24).fit(df.filter("unique_id = 'a'")).predict(5).orderBy("ds").collect()
    np.testing.assert_allclose([r.y_hat for r in mine], own.mean(0))
    assert all(r.y_hat_lower <= r.y_hat <= r.y_hat_upper for r in mine)
    with pytest.raises(RuntimeError):
        SCUM(24).predict(5)
    for bad in (dict(h=0), dict(h=1, form="odd"), dict(h=1, form="full"), dict(h=1, rates=(1.0, 1.0)), dict(h=1, form="none", rates=(1.0,))):
        with pytest.raises(ValueError):
            ces_forecast(df, **bad)


def test_widths_come_from_bounded_sketches(spark):
    from pyspark.sql import functions as F

    from tidepanel.operators.ml import EnbPI, bag_weights

    rng = np.random.default_rng(5)
    rows = [(u, i, float(rng.normal(0, s))) for u, s in (("a", 1.0), ("b", 30.0)) for i in range(4000)]
    df = panel(spark, rows, "unique_id string, ds long, y double")
    model = EnbPI(None, 5, [1], coverage=0.9, sketch_k=200).fit(df)
    width = {r.unique_id: r.width for r in model.widths().collect()}
    # A stationary normal series: nine tenths of the residuals lie within 1.645 deviations.
    assert width["a"] == pytest.approx(1.645, rel=0.08) and width["b"] == pytest.approx(49.3, rel=0.08)
    # State: bytes that hardly grow, ranks within the stated bound.
    state = {r["__id"]: r.sketch for r in model.sketches_.collect()}
    assert all(len(s) < 10_000 for s in state.values())
    errors = model._errors(model._rows(df), 1 << 30).toPandas()
    for u, own in errors.groupby("__id"):
        n = F.kll_sketch_get_n_double(F.lit(bytearray(state[u])))
        assert spark.range(1).select(n).first()[0] == len(own)
        assert abs((own["e"] <= width[u]).mean() - 0.9) < 2.3 / 200**0.9
    # Each row's bags are known from its key alone; a third of the rows is out of a bag.
    w = bag_weights(np.arange(30_000, dtype=np.uint64) * np.uint64(2654435761), 4, 1)
    assert abs((w == 0).mean() - np.exp(-1)) < 0.02 and abs(w.mean() - 1) < 0.03 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.03
    # Updates merge: twice the rows, and the widths of what came last.
    wild = panel(spark, [("a", i, float(rng.normal(0, 100)), 0.0) for i in range(40_000)] + [("new", 0, 7.0, 4.0)], "unique_id string, ds long, y double, y_hat double")
    model.update(wild)
    later = {r.unique_id: r.width for r in model.widths().collect()}
    assert later["a"] == pytest.approx(159, rel=0.1) and later["b"] == width["b"] and later["new"] == 3.0
    assert all(len(r.sketch) < 15_000 for r in model.sketches_.collect())
    ahead = model.predict(df.unionByName(panel(spark, [("z", i, float(i % 3)) for i in range(5)], "unique_id string, ds long, y double")), 2).collect()
    spread = {r.unique_id: r.y_hat_upper - r.y_hat for r in ahead}
    assert spread["a"] == pytest.approx(later["a"]) and spread["b"] == pytest.approx(later["b"]) and later["b"] < spread["z"] < later["a"] + 1 and len(ahead) == 6


def test_direct_forecasts_with_covariates(spark):
    """A noiseless panel comes back; what is not known gives null."""
    from tidepanel.functions.stats import Ridge
    from tidepanel.operators.ml import DirectForecaster

    rng = np.random.default_rng(2)
    rows = []
    for u in ("a", "b"):
        past, future = rng.normal(size=63), rng.normal(size=63)
        y = [0.5, -0.2]
        for i in range(2, 63):
            y.append(1 + 0.6 * past[i - 1] + 2 * future[i])
        rows += [(u, day(i), float(y[i]), float(past[i]), float(future[i])) for i in range(63)]
    df = panel(spark, rows, "unique_id string, ds date, y double, past_x double, future_x double")
    cut = day(60)
    history, ahead = df.filter(df.ds < cut), df.filter(df.ds >= cut).select("unique_id", "ds", "future_x")
    model = DirectForecaster(lambda: Ridge(1e-9), [1, 2], 3, past_covariates=["past_x"], future_covariates=["future_x"]).fit(history)
    got = model.predict(history, future_df=ahead).orderBy("unique_id", "ds").collect()
    assert [(r.unique_id, r.ds) for r in got] == [(u, day(60 + k)) for u in "ab" for k in range(3)]
    # Only the first step knows the past covariate of the row before it.
    truth = {(r[0], r[1]): r[2] for r in rows}
    for r in got:
        if r.ds == cut:
            assert r.y_hat == pytest.approx(truth[r.unique_id, r.ds], abs=1e-6)
    # The third row ahead counts, not the last repeated; without it the step is null.
    part = model.predict(history, future_df=ahead.filter(ahead.ds < day(62))).orderBy("unique_id", "ds").collect()
    assert [r.y_hat is None for r in part] == [False, False, True] * 2 and part[0].y_hat == got[0].y_hat
    # Histories shorter than a lag, and gaps at the end.
    short = panel(spark, [("s", day(0), 1.0, 1.0, 1.0), ("g", day(0), 1.0, 1.0, 1.0), ("g", day(1), None, 1.0, 1.0)], df.schema.simpleString().removeprefix("struct<").removesuffix(">"))
    nulls = model.predict(short, 1, future_df=short.select("unique_id", "ds", "future_x")).collect()
    assert len(nulls) == 2 and all(r.y_hat is None for r in nulls)
    plain = DirectForecaster(None, [1, 2], 3).fit(history)
    assert plain.predict(history).count() == 6 and plain.predict(short).filter("y_hat is not null").count() == 0
    with pytest.raises(ValueError, match="future_df"):
        model.predict(history)
    with pytest.raises(ValueError):
        DirectForecaster(None, [], 3)


def test_ids_are_absorbed_by_centring(spark):
    """The same forecasts as with a column for each id, whatever their number."""
    from pyspark.sql import functions as F

    from tidepanel.functions.stats import Ridge
    from tidepanel.operators.ml import GlobalForecaster, fit_within

    rng = np.random.default_rng(4)
    rows = [(u, day(i), float(10 * k + 0.2 * i + rng.normal()), float(k)) for k, u in enumerate("abcde") for i in range(30)] + [(None, day(i), float(i % 4), 9.0) for i in range(30)]
    df = panel(spark, rows, "unique_id string, ds date, y double, size double")
    named = df.filter("unique_id is not null")
    own = GlobalForecaster(None, [1, 2], calendar=["day_of_week"], encode_id="onehot", static_features=["size"]).fit(named)
    dense = GlobalForecaster(Ridge(1e-9), [1, 2], calendar=["day_of_week"], encode_id="onehot").fit(named)
    key = lambda r: (r.unique_id, r.ds)
    a, b = ({key(r): r.y_hat for r in m.predict(named, 4).collect()} for m in (own, dense))
    assert a.keys() == b.keys() and len(a) == 20
    np.testing.assert_allclose([a[k] for k in a], [b[k] for k in a], rtol=1e-4)
    many = spark.range(60_000).select((F.col("id") % 20_000).alias("u"), F.sin("id").alias("x"), (2 * F.sin("id") + F.col("id") % 20_000).alias("y"))
    model, effects = fit_within(many, ["x"], "y", "u")
    assert model.coef_[0] == pytest.approx(2, abs=1e-9) and effects.count() == 20_000 and len(effects.columns) == 2
    assert effects.filter(F.abs(F.col("__effect") - F.col("__id")) > 1e-6).count() == 0
    # Unknown series have the mean effect; a null id is a series like any other.
    whole = GlobalForecaster(None, [1], encode_id="onehot").fit(df)
    new = panel(spark, [("zz", day(i), 5.0, 0.0) for i in range(3)], "unique_id string, ds date, y double, size double")
    got = whole.predict(df.unionByName(new), 1).collect()
    mean = whole.effects_.agg(F.avg("__effect")).first()[0]
    assert len(got) == 7 and {r.unique_id: r.y_hat for r in got}["zz"] == pytest.approx(mean + whole.model_.coef_[0] * 5.0)

from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F


def panel(spark, series, start=date(2024, 1, 1)):
    rows = [(k, start + timedelta(days=i), None if y is None else float(y)) for k, v in series.items() for i, y in enumerate(v)]
    return spark.createDataFrame(rows, "unique_id string, ds date, y double").repartition(3)


def column(df, name, key="A"):
    return [r[name] for r in df.filter(F.col("unique_id") == key).orderBy("ds").collect()]


@pytest.fixture(scope="module")
def ab(spark):
    return panel(spark, {"A": [1, 2, 3, 4, 5, 6], "B": [10, 20, 30, 40, 50, 60]})


def test_features(ab):
    from tidepanel.operators import features as f

    assert column(f.lag_features(ab, [1, 2]), "y_lag_2") == [None, None, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        f.lag_features(ab, [0])
    assert column(f.rolling_features(ab, [3], ["median"], min_samples=1), "y_rolling_median_3") == [1, 1.5, 2, 3, 4, 5]
    assert column(f.rolling_features(ab, [4], ["sum"], center=True), "y_rolling_sum_4") == [None, None, 10, 14, 18, None]
    assert column(f.calendar_features(ab, ["day_of_week", "is_weekend"]), "day_of_week") == [1, 2, 3, 4, 5, 6]


def test_transforms_round_trip(ab):
    from tidepanel.operators import transforms as t

    for order, period in ((1, 1), (2, 1), (1, 2), (2, 2)):
        back = t.undifference(t.difference(ab, order, period), order, period)
        assert column(back, "y", "B") == pytest.approx([10, 20, 30, 40, 50, 60][order * period :])
    assert column(t.inverse_boxcox_transform(t.boxcox_transform(ab, 0.0)), "y") == pytest.approx([1, 2, 3, 4, 5, 6])
    with pytest.raises(ValueError):
        t.log_transform(t.log_transform(ab))
    history = np.array([1.0, 4.0, 9.0, 16.0])
    z = t.forward_values(history, "difference", {"order": 2})
    assert t.inverse_step(z[-1], "difference", {"order": 2}, history) == 25.0


def test_cleaning(spark):
    from tidepanel.operators import cleaning as c

    df = panel(spark, {"A": [1, None, 3, None, 5, 6], "B": [10, None, None, 40, 50, 60]})
    assert column(c.impute(df), "y", "B") == [10, 10, 10, 40, 50, 60]
    assert column(c.impute(df, method="backward_fill"), "y") == [1, 3, 3, 5, 5, 6]
    assert column(c.impute(df, method="linear"), "y", "B") == [10, 20, 30, 40, 50, 60]
    assert column(c.impute(df, method="seasonal", season_length=2, add_indicator=True), "y_imputed") == [False, True, False, True, False, False]
    odd = panel(spark, {"A": [10, 11, 9, 10, 100, 10, 11, 9, 10, 11]})
    for method, options in (("zscore", {"threshold": 2.0}), ("iqr", {"threshold": 1.5}), ("hampel", {"window": 5})):
        assert column(c.detect_outliers(odd, method=method, **options), "is_outlier") == [i == 4 for i in range(10)]
    assert column(c.treat_outliers(odd, replacement="interpolate", threshold=2.0), "y")[4] == 10
    hourly = spark.createDataFrame([("A", datetime(2024, 1, 1) + timedelta(hours=i), float(i)) for i in range(48)], "unique_id string, ds timestamp_ntz, y double")
    assert column(c.resample(hourly, "1d", "sum"), "y") == [276.0, 276.0 + 24 * 24]
    assert column(c.cusum(panel(spark, {"A": [5, 5, 5]})), "cusum") == [0, 0, 0]


def test_metrics(spark):
    from tidepanel.operators import metrics as m

    df = spark.createDataFrame([("A", i, float(i), float(i) + 0.5) for i in range(1, 6)], "unique_id string, ds long, y double, y_hat double")
    assert m.mae(df).first()[0] == 0.5 and m.rmse(df).first()[0] == 0.5
    assert m.mase(df).first().mase == 0.5
    assert m.bias_detect(df).first().bias_ratio == 1.0
    up = spark.createDataFrame([("A", i, float(i)) for i in range(6)] + [("B", i, float(-i)) for i in range(6)] + [("C", 0, 1.0)], "unique_id string, ds long, y double")
    got = {r.unique_id: (r.mann_kendall, r.sens_slope) for r in m.trend_statistics(up).collect()}
    assert got == {"A": (1.0, 1.0), "B": (-1.0, -1.0), "C": (0.0, 0.0)}
    first = m.pacf(up).filter("lag = 1 and unique_id = 'A'").first().pacf
    assert first == pytest.approx(m.acf(up).filter("lag = 1 and unique_id = 'A'").first().acf)


def test_special_functions():
    from tidepanel.functions import stats as s

    assert s.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert s.f_sf(4.964602743730711, 1, 10) == pytest.approx(0.05, abs=1e-9)
    assert s.student_t_cdf(2.2281388519649385, 10) == pytest.approx(0.975, abs=1e-9)
    w = s.simplex_least_squares(np.eye(3), np.array([0.2, 0.3, 0.9]))
    assert w.sum() == pytest.approx(1) and w.min() >= 0 and np.argmax(w) == 2
    x, f = s.nelder_mead(lambda p: (p[0] - 1) ** 2 + (p[1] + 2) ** 2, np.zeros(2))
    assert x == pytest.approx([1, -2], abs=1e-2)


def naive_dtw(a, b, cost=lambda x, y: abs(x - y)):
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = cost(a[i - 1], b[j - 1]) + min(d[i - 1, j - 1], d[i - 1, j], d[i, j - 1])
    return d[-1, -1]


def test_elastic_kernels():
    from tidepanel.functions import elastic as e
    from tidepanel.functions.clusters import _msm_path

    rng = np.random.default_rng(0)
    left = [rng.normal(size=rng.integers(1, 15)) for _ in range(40)]
    right = [rng.normal(size=rng.integers(1, 15)) for _ in range(40)]
    assert e.distances("dtw", left, right) == pytest.approx([naive_dtw(a, b) for a, b in zip(left, right)])
    assert e.distances("msm", left, right) == pytest.approx([_msm_path(a, b, 1.0)[0] for a, b in zip(left, right)])
    for name in e.KERNELS:
        if e.KERNELS[name][2]:
            continue
        same = e.distances(name, left[:5], left[:5])
        if name not in ("ddtw",):
            assert same == pytest.approx(np.zeros(5), abs=1e-9), name
        assert e.distances(name, left, right).shape == (40,)
    exact = np.array([naive_dtw(a, b) for a, b in zip(left, right)])
    assert (e.distances("fast_dtw", left, right, radius=1) >= exact - 1e-9).all()
    points = [np.column_stack([a, a]) for a in left]
    others = [np.column_stack([b, b]) for b in right]
    assert e.distances("dtw_multi", points, others) == pytest.approx(2 * exact)
    assert e.distances("msm", [np.zeros(0)], [np.ones(3)])[0] == 0 and np.isinf(e.distances("dtw", [np.zeros(0)], [np.ones(3)])[0])


def test_pairwise_join_and_knn(spark):
    from tidepanel.operators import similarity as s

    df = panel(spark, {"A": [1, 2, 3, 4], "B": [1, 2, 3, 5], "C": [4, 3, 2, 1]})
    pairs = {(r.id_1, r.id_2): r.dtw for r in s.compute_pairwise_distance(df).collect()}
    assert set(pairs) == {("A", "B"), ("A", "C"), ("B", "C")} and pairs["A", "B"] == 1
    with pytest.raises(ValueError):
        s.compute_pairwise_distance(df, method="nope")
    with pytest.raises(ValueError):
        s.compute_pairwise_distance(df, method="dtw", window=3)
    train = df.withColumn("label", F.when(F.col("unique_id") == "C", "down").otherwise("up"))
    got = s.knn_classify(train, panel(spark, {"X": [1, 2, 2, 4], "Y": [5, 3, 2, 0]}), k=1)
    assert {r.unique_id: r.predicted_label for r in got.collect()} == {"X": "up", "Y": "down"}


def shapes(spark, n=6):
    rng = np.random.default_rng(3)
    t = np.linspace(0, 6.28, 30)
    series = {f"{k}{i}": fn(t) * 3 + rng.normal(0, 0.1, 30) for k, fn in (("s", np.sin), ("l", lambda t: t - 3), ("d", lambda t: 3 - t)) for i in range(n)}
    return panel(spark, series)


def groups(labels):
    rows = labels.collect()
    return {frozenset(r[0][0] for r in rows if r.cluster == c) for c in {r.cluster for r in rows}}


def test_clusterings(spark):
    from tidepanel.operators import clustering as c

    df = shapes(spark).cache()
    want = {frozenset("s"), frozenset("l"), frozenset("d")}
    assert groups(c.kmedoids(df, 3)) == want
    assert groups(c.clara(df, 3, sample_size=12)) == want
    assert groups(c.agglomerative_cluster(df, n_clusters=3)) == want
    assert groups(c.dbscan_cluster(df, eps=12.0, min_samples=3)) == want
    assert groups(c.hdbscan_cluster(df, min_cluster_size=4)) == want
    assert groups(c.kasba(df, 3, seed=1)) <= want | {frozenset("sl"), frozenset("sd")}
    best = c.auto_cluster(df, distances_=["dtw"], k_range=[2, 3, 4])
    assert best.best_k == 3 and groups(best.best_labels) == want
    with pytest.raises(ValueError):
        c.kmedoids(df, 99)


def test_classifiers(spark):
    from tidepanel.operators import clustering as c

    df = shapes(spark).withColumn("label", F.substring("unique_id", 1, 1))
    for model in (c.KShapeClassifier(), c.RocketClassifier(100), c.MiniRocketClassifier(84)):
        got = model.fit(df).predict(df).collect()
        assert np.mean([r.unique_id[0] == r.predicted_label for r in got]) > 0.9


def test_scores(spark):
    from tidepanel.operators import similarity as s

    df = shapes(spark, 3)
    labels = df.select("unique_id", F.substring("unique_id", 1, 1).alias("cluster")).distinct()
    assert s.silhouette_score(df, labels).first()[0] > 0.5
    assert 0 < s.davies_bouldin_score(df, labels).first()[0] < 1
    assert s.calinski_harabasz_score(df, labels).first()[0] > 1


def test_forecasters(spark):
    from tidepanel.operators import forecasting as f
    from tidepanel.operators import ml

    line = panel(spark, {"A": np.arange(40) * 2.0, "B": 100 - np.arange(40) * 1.0})
    for model in (ml.RecursiveForecaster(None, [1, 2]), ml.ForecastPipeline(None, [1, 2], target_transform="difference"), ml.GlobalForecaster(None, [1, 2], encode_id="onehot", calendar=["day_of_week"])):
        got = model.fit(line).predict(line, 3)
        assert column(got, "y_hat") == pytest.approx([80, 82, 84], abs=0.1)
        assert column(got, "ds") == [date(2024, 2, 10), date(2024, 2, 11), date(2024, 2, 12)]
    assert column(ml.DirectForecaster(None, [1, 2], 3).fit(line).predict(line), "y_hat", "B") == pytest.approx([60, 59, 58], abs=0.1)
    assert column(f.auto_arima(line, 2), "y_hat") == pytest.approx([80, 82], abs=0.2)
    wave = panel(spark, {"A": 10 + 5 * np.sin(np.arange(48) * np.pi / 6)})
    assert column(f.holt_winters_forecast(wave, 12, 12), "y_hat") == pytest.approx(list(10 + 5 * np.sin(np.arange(48, 60) * np.pi / 6)), abs=0.8)
    future = line.select("unique_id").distinct().crossJoin(spark.createDataFrame([(date(2024, 2, 10), 1.0), (date(2024, 2, 11), 0.0)], "ds date, promo double"))
    promo = panel(spark, {"A": [10.0 + 5 * (i % 3 == 0) for i in range(40)], "B": [20.0 + 5 * (i % 3 == 0) for i in range(40)]}).withColumn("promo", (F.datediff("ds", F.lit(date(2024, 1, 1))) % 3 == 0).cast("double"))
    got = ml.GlobalForecaster(None, [], future_covariates=["promo"], encode_id="onehot").fit(promo).predict(promo, 2, future)
    assert column(got, "y_hat") == pytest.approx([15, 10], abs=0.01)


def test_validation(ab):
    from tidepanel.operators import metrics, validation as v
    from tidepanel.plans.queries import Naive

    folds = list(v.expanding_window_cv(ab, 2, 1, 1))
    assert [(a.count(), b.count()) for a, b in folds] == [(8, 2), (10, 2)]
    with pytest.raises(ValueError):
        v.fold_table(ab, 9, 3)
    got = v.backtest(Naive(), v.expanding_window_cv(ab, 2, 1, 1), {"mae": metrics.mae}, return_predictions=True, per_horizon=True)
    assert {r.score for r in got["fold_scores"].collect()} == {5.5}
    assert got["predictions"].count() == 4


def test_changes(spark):
    from tidepanel.operators import changepoint as c

    rng = np.random.default_rng(42)
    df = panel(spark, {"A": np.r_[rng.normal(0, 1, 50), rng.normal(10, 1, 50)], "B": rng.normal(0, 1, 100)})
    assert [(r.unique_id, r.changepoint_idx) for r in c.pelt(df, penalty=20).collect()] == [("A", 50)]
    v = np.r_[rng.normal(0, 1, 12), rng.normal(6, 1, 12)]
    best = min(range(2, 23), key=lambda t: v[:t].var() * t + v[t:].var() * (24 - t))
    assert c.pelt_points(v, penalty=15) == [best]
    drops = [i for i, x in enumerate(column(c.bocpd(df, hazard_rate=100), "run_drop")) if x]
    assert any(50 <= i <= 53 for i in drops)
    regime = column(c.regime_detect(df), "regime")
    assert regime[:50] == [0] * 50 and regime[50:] == [1] * 50
    x = np.zeros((200, 2))
    for t in range(1, 200):
        x[t] = [0.5 * x[t - 1, 0], 0.8 * x[t - 1, 0] + 0.1 * x[t - 1, 1]] + rng.normal(0, 1, 2)
    wide = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "ds long, x double, y double")
    assert c.var_fit(wide, ["x", "y"]).coefficients[1, 0] == pytest.approx(0.8, abs=0.15)
    assert c.granger_causality(wide, "x", "y", 1).first().p_value < 0.001 < c.granger_causality(wide, "y", "x", 1).first().p_value


def test_causal(spark):
    from tidepanel.operators import bayes

    rng = np.random.default_rng(1)
    base = rng.normal(0, 1, 65).cumsum() + 50
    s = {f"D{i}": base * (0.8 + 0.2 * i) + rng.normal(0, 0.2, 65) for i in range(3)}
    s["T"] = 0.5 * s["D0"] + 0.5 * s["D2"] + np.r_[np.zeros(50), np.full(15, 8)]
    df, when = panel(spark, s), date(2024, 1, 1) + timedelta(days=50)
    got = bayes.SyntheticControl().fit(df, "T", when)
    assert got.to_frame().agg(F.avg("point_effect")).first()[0] == pytest.approx(8, abs=0.5)
    flat = panel(spark, {"A": np.r_[rng.normal(100, 1, 60), rng.normal(110, 1, 20)]})
    effect = bayes.causal_impact(flat, date(2024, 1, 1) + timedelta(days=60), trend="local_level")
    assert effect.agg(F.avg("point_effect")).first()[0] == pytest.approx(10, abs=1.5)


def test_state_space():
    from tidepanel.functions import statespace as s

    rng = np.random.default_rng(0)
    x = rng.normal(0, 0.5, 100).cumsum()
    y = x + rng.normal(0, 1, 100)
    y[10] = np.nan
    k = s.KalmanFilter([[1.0]], [[1.0]], [[0.25]], [[1.0]])
    r = k.smooth(y)
    assert np.sqrt(((r.smoothed_states[:, 0] - x) ** 2).mean()) < np.sqrt(np.nanmean((y - x) ** 2))
    u = s.UnscentedKalmanFilter(lambda v: v, lambda v: v, [[0.25]], [[1.0]], [0.0], [[1e6]]).filter(y)
    assert u.filtered_states[-1] == pytest.approx(r.filtered_states[-1], abs=1e-2)
    p = s.ParticleFilter(2000, s.local_level_transition(0.5), s.local_level_loglik(1.0)).filter(y)
    assert abs(p.filtered_mean[-1] - r.filtered_states[-1, 0]) < 0.3
    e = s.EnsembleKalmanFilter(lambda v: v, lambda v: v, [[0.25]], [[1.0]], [0.0], [[10.0]], 500).filter(y)
    assert abs(e.filtered_states[-1, 0] - r.filtered_states[-1, 0]) < 0.4
    g = s.GaussianProcess(s.RBFKernel() + s.PeriodicKernel()).fit(np.sin(np.arange(40) / 4))
    assert g.predict(3)[0].shape == (3,)


def test_streaming(spark, tmp_path):
    from tidepanel.operators import forecasting as f
    from tidepanel.streaming.state import SlidingWindowManager, StreamingETS, StreamingKalmanFilter

    rng = np.random.default_rng(0)
    v = {"A": list(rng.normal(10, 2, 30)), "B": list(rng.normal(5, 1, 30))}
    df = panel(spark, v)
    early, late = df.filter(F.col("ds") < date(2024, 1, 21)), df.filter(F.col("ds") >= date(2024, 1, 21))
    for method, want in (("ses", f.ses_forecast(df, 3)), ("holt", f.holt_forecast(df, 3)), ("holt_winters", f.holt_winters_forecast(df, 3, 7))):
        got = StreamingETS(method).fit(early).partial_fit(late).predict(3)
        for key in "AB":
            assert column(got, "y_hat", key) == pytest.approx(column(want, "y_hat", key)), method
            assert column(got, "ds", key) == column(want, "ds", key)
    window = SlidingWindowManager(5).append(early).append(late)
    assert column(window.frame_, "y") == v["A"][-5:]
    early.coalesce(1).write.parquet(str(tmp_path / "in" / "0"))
    late.coalesce(1).write.parquet(str(tmp_path / "in" / "1"))
    rows = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = StreamingETS("ses").stream(rows).writeStream.format("memory").queryName("ets").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = {r.unique_id: r.y_hat for r in spark.table("ets").orderBy("n_obs").collect()}
    assert last["A"] == pytest.approx(column(f.ses_forecast(df, 1), "y_hat")[0])
    k = StreamingKalmanFilter([[1.0]], [[1.0]], [[1.0]], [[1.0]]).fit([1.0, float("nan"), 2.0])
    assert k.predict(2)[1][1] > k.predict(2)[1][0]


def test_imaging(spark):
    from tidepanel.operators import imaging as i

    df = panel(spark, {"A": np.arange(10.0), "B": [0, 1] * 5})
    g = np.array(i.to_gasf(df).filter("unique_id = 'A'").first().gasf)
    phi = np.arccos(np.linspace(-1, 1, 10))
    assert g == pytest.approx(np.cos(phi[:, None] + phi[None]))
    r = i.rqa_features(i.to_recurrence_plot(df)).filter("unique_id = 'B'").first()
    assert r.recurrence_rate == 0.5
    levels = i.signature(np.array([0.0, 1.0, 3.0]), 2, [])
    assert float(levels[0][0]) == pytest.approx(3.0) and float(levels[1][0][0]) == pytest.approx(2.0)


def test_reconcile(spark):
    from tidepanel.operators.reconcile import METHODS, reconcile

    rows = [(n, date(2024, 1, d), float(y + d)) for n, y in (("A", 10), ("B", 20), ("C", 5), ("D", 6), ("X", 40), ("Y", 9), ("Total", 80)) for d in (1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "unique_id string, ds date, y_hat double")
    tree = {"A": "X", "B": "X", "C": "Y", "D": "Y", "X": "Total", "Y": "Total"}
    noise = df.withColumn("residual", (F.xxhash64("unique_id", "ds") % 100) / 50.0)
    for m in METHODS:
        out = reconcile(df, tree, m, middle_level=["X", "Y"], residuals=noise, train_data=noise.withColumnRenamed("residual", "y"), n_folds=2)
        v = {(r.unique_id, r.ds): r.y_hat for r in out.collect()}
        for d in (1, 4):
            at = lambda n: v[n, date(2024, 1, d)]
            assert at("X") == pytest.approx(at("A") + at("B")) and at("Total") == pytest.approx(at("X") + at("Y")), m
    assert {r.unique_id: r.y_hat for r in reconcile(df, tree).filter("ds = '2024-01-01'").collect()}["Total"] == 45.0


def test_agents(spark):
    from tidepanel.operators import agents as a

    rng = np.random.default_rng(0)
    v = list(rng.normal(10, 1, 60))
    v[45] = 40.0
    df = panel(spark, {"A": v, "B": list(np.arange(60) * 1.0)})
    hit = [r.ds for r in a.AnomalyOrchestrator(20).run(df).detections.filter("is_anomaly and unique_id = 'A'").collect()]
    assert hit == [date(2024, 1, 1) + timedelta(days=45)]
    out = a.TimeSeriesScientist(3).run(df)
    assert out.predictions.count() == 6 and "Best" in out.report.markdown
    vit = spark.createDataFrame([(1, 80.0, 15.0, 37.0, 120.0, 98.0), (2, 140.0, 26.0, 39.5, 85.0, 90.0)], "id long, heart_rate double, respiratory_rate double, temperature double, systolic_bp double, spo2 double")
    assert [r.tier for r in a.clinical_scores(vit).orderBy("id").collect()] == [0, 3]
    assert a.demand_response([5, 1, 0], 2).tolist() == [2.0, 2.0, 2.0]
    assert a.federated_average([[1, 2], [3, 4]], [1, 3]).tolist() == [2.5, 3.5]
    assert a.bullwhip(df).filter("unique_id = 'A'").first().bullwhip_ratio < 1
    assert a.MARLOrchestrator(5).run_from_dataframe(panel(spark, {"A": 100 + rng.normal(0, 1, 40).cumsum(), "B": 50 + rng.normal(0, 1, 40).cumsum()})).weights.count() > 0


def test_sources(spark, tmp_path):
    import hashlib

    from tidepanel.sources import adapters as s
    from tidepanel.sources.registry import Experiment, ModelRegistry

    path = tmp_path / "x.csv"
    path.write_text("unique_id,ds,y\nA,2024-01-01,1.5\n")
    s.register_dataset("tiny", f"file://{path}", hashlib.sha256(path.read_bytes()).hexdigest(), "csv")
    assert s.load_dataset(spark, "tiny", str(tmp_path / "cache")).first().y == 1.5
    s.register_dataset("broken", f"file://{path}", "0", "csv")
    with pytest.raises(ValueError):
        s.load_dataset(spark, "broken", str(tmp_path / "cache"))
    with pytest.raises(KeyError):
        s.load_dataset(spark, "none")
    with pytest.raises(ImportError):
        s.OPTIONAL_MODELS["ChronosForecaster"]()
    r = ModelRegistry(str(tmp_path / "reg"))
    assert [r.save_model("m", {"a": 1}), r.save_model("m", {"a": 2})] == ["v1", "v2"] and r.load_model("m") == {"a": 2}
    with pytest.raises(ValueError):
        r.save_model("../m", 1)
    r.log_run("e", "naive", metrics={"mae": 2.0})
    r.log_run("e", "ses", metrics={"mae": 1.0})
    e = r.load_experiment("e")
    assert e.best_run("mae").model_name == "ses" and e.leaderboard(spark, "mae").first().model_name == "ses"
    assert Experiment.from_dict(e.to_dict()) == e


def test_public_names():
    import tidepanel

    for name in ("lag_features", "kasba", "NBEATSForecaster", "ModelRegistry", "StreamingETS", "compute_pairwise_dtw", "KalmanFilter", "pts"):
        assert getattr(tidepanel, name)
    with pytest.raises(AttributeError):
        tidepanel.nothing


def test_views_and_helpers(spark, ab):
    from tidepanel.functions import views as v
    from tidepanel.operators.metrics import mann_kendall, ordered
    from tidepanel.sources import adapters as s

    x = np.arange(12.0).reshape(2, 6)
    assert v.jitter(x).shape == v.scaling(x).shape == v.window_crop(x).shape == x.shape
    e = np.eye(4)
    assert v.nt_xent_loss(e, e) < v.nt_xent_loss(e, e[::-1])
    q = v.target_distribution([[0.6, 0.4], [0.3, 0.7]])
    assert q.sum(axis=1) == pytest.approx([1, 1]) and q[0, 0] > 0.6
    assert {r.m for r in ab.groupBy("unique_id").agg(mann_kendall(ordered("y", "ds")).alias("m")).collect()} == {1.0}
    f = spark.createDataFrame([("A", [7.0, 8.0])], "unique_id string, forecast array<double>")
    assert [(r.ds, r.y_hat) for r in s.build_forecast_df(f, ab, 2).orderBy("ds").collect()] == [(date(2024, 1, 7), 7.0), (date(2024, 1, 8), 8.0)]
    assert s.build_windows(ab, 3, 2).count() == 4
    rows = s.extract_classification_data(ab.withColumn("label", F.lit("x")), "label").collect()
    assert {r.label_code for r in rows} == {0}
    with pytest.raises(ImportError):
        s.dec_cluster(ab, 2)

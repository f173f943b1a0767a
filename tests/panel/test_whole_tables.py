"""Queries and operators do the whole job: every row, at every size."""

import numpy as np
import pytest
from pyspark.sql import functions as F


def brute_dtw(a, b):
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0
    for i in range(len(a)):
        for j in range(len(b)):
            d[i + 1, j + 1] = abs(a[i] - b[j]) + min(d[i, j], d[i, j + 1], d[i + 1, j])
    return d[-1, -1]


def test_vector_queries_read_the_whole_table(spark, tmp_path):
    from tidepanel.plans.queries import QUERIES

    rng = np.random.default_rng(7)
    v = rng.normal(size=(24, 64)).astype(np.float32)
    rows = [(i, v[i].tolist(), None if i == 5 else i % 4) for i in range(len(v))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    x, ids = v.astype(float), set(range(len(v)))
    pairs = {(a, b) for a in ids for b in ids if str(a) < str(b)}
    sbd = lambda a, b: 1 - np.correlate(a, b, "full").max() / np.sqrt((a @ a) * (b @ b))
    for name, fn in (("dtw", brute_dtw), ("sbd", sbd)):
        got = {(r[0], r[1]): r[2] for r in run(f"dist_{name}")}
        assert set(got) == pairs
        assert all(got[a, b] == pytest.approx(fn(x[a], x[b]), abs=1e-5) for a, b in pairs)
    for name in ("frechet", "sakoe_chiba", "wdtw", "erp", "edr", "lcss", "twe", "msm", "ddtw", "itakura", "fast_dtw"):
        assert {(r[0], r[1]) for r in run(f"dist_{name}")} == pairs
    d = np.array([[sbd(x[a], x[b]) if a != b else np.inf for b in ids] for a in ids])
    got = {(r.id_1, r["rank"]): r.id_2 for r in run("nearest_neighbours")}
    assert got == {(i, k + 1): int(j) for i in ids for k, j in enumerate(d[i].argsort()[:3])}
    assert sum(r.n for r in run("cluster_medoids")) == len(ids)
    for name in ("silhouette", "kmedoids", "clara", "clarans", "agglomerative", "dbscan", "hdbscan", "spectral_cluster", "kshape", "kmeans_dba", "kasba", "shapelet_cluster"):
        assert sorted(r.unique_id for r in run(name)) == sorted(ids), name
    assert len(run("auto_cluster")) == 6


def table_of(a, b, cell, top, side):
    """A dynamic program over all cells, one at a time; borders by function."""
    d = np.array([[0.0 if i == j == 0 else top(j) if i == 0 else side(i) if j == 0 else 0.0 for j in range(len(b) + 1)] for i in range(len(a) + 1)])
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = cell(i, j, d[i - 1, j - 1], d[i - 1, j], d[i, j - 1])
    return d[-1, -1]


def test_distances_against_brute_force(spark):
    from tidepanel.operators.similarity import pair_distances

    rng, inf = np.random.default_rng(3), lambda k: np.inf
    x = {i: rng.normal(size=20) for i in range(9)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "unique_id long, series array<double>")
    other = spark.createDataFrame([(i, x[i].tolist()) for i in (2, 7)] + [(50, rng.normal(size=20).tolist())], "key long, series array<double>")

    def brute(name, a, b):
        c = lambda i, j: abs(a[i - 1] - b[j - 1])
        at = lambda v, i: v[i - 1] if i > 0 else 0.0
        n = len(a)
        if name == "frechet":
            return table_of(a, b, lambda i, j, g, u, l: max(c(i, j), min(g, u, l)), inf, inf)
        if name == "sakoe_chiba":
            return table_of(a, b, lambda i, j, g, u, l: c(i, j) + min(g, u, l) if abs(i - j) <= 3 else np.inf, inf, inf)
        if name == "wdtw":
            return table_of(a, b, lambda i, j, g, u, l: c(i, j) ** 2 / (1 + np.exp(-0.05 * (abs(i - j) - n / 2))) + min(g, u, l), inf, inf)
        if name == "erp":
            return table_of(a, b, lambda i, j, g, u, l: min(g + c(i, j), u + abs(a[i - 1]), l + abs(b[j - 1])), lambda k: np.abs(b[:k]).sum(), lambda k: np.abs(a[:k]).sum())
        if name == "edr":
            return table_of(a, b, lambda i, j, g, u, l: min(g + (c(i, j) > 0.1), u + 1, l + 1), float, float) / n
        if name == "lcss":
            return 1 - table_of(a, b, lambda i, j, g, u, l: g + 1 if c(i, j) <= 0.05 else max(u, l), lambda k: 0.0, lambda k: 0.0) / n
        return table_of(a, b, lambda i, j, g, u, l: min(g + c(i, j) + abs(at(a, i - 1) - at(b, j - 1)) + 0.001 * min(abs(i - j), 0.002), u + abs(a[i - 1] - at(a, i - 1)) + 1.001, l + abs(b[j - 1] - at(b, j - 1)) + 1.001), inf, inf)

    for name, options in {"frechet": {}, "sakoe_chiba": {"window": 3}, "wdtw": {}, "erp": {}, "edr": {}, "lcss": {"epsilon": 0.05}, "twe": {}}.items():
        got = {(r.id_1, r.id_2): r.d for r in pair_distances(df, df, "d", name, options).collect()}
        assert set(got) == {(a, b) for a in x for b in x if a < b}
        for (a, b), d in got.items():
            assert d == pytest.approx(brute(name, x[a], x[b]), abs=1e-9), name
    two = {(r.id_1, r.id_2) for r in pair_distances(df, other, "d", "dtw", {}).collect()}
    assert two == {(i, j) for i in x for j in (2, 7, 50) if i != j and not (i in (2, 7) and j != 50 and str(i) > str(j))}
    assert pair_distances(df, other, "d", "dtw", {}, all_pairs=True).count() == 27


def test_clinical_tiers_and_demand(spark):
    from tidepanel.operators.agents import clinical_scores, demand_shift

    names = "id long, heart_rate double, systolic_bp double, respiratory_rate double, temperature double, spo2 double"
    rows = [(1, 80.0, 120.0, 22.0, 37.0, 98.0), (2, 72.0, 120.0, 16.0, 37.0, 98.0), (3, 125.0, 88.0, 26.0, 39.0, 90.0), (4, 55.0, 145.0, 21.0, 37.0, 98.0), (5, 95.0, 120.0, 21.0, 37.0, 98.0), (6, None, None, None, None, None)]
    got = {r.id: (r.sepsis_score, r.sepsis_flag, r.out_of_range, r.tier) for r in clinical_scores(spark.createDataFrame(rows, names)).collect()}
    assert got == {1: (2, True, 1, 2), 2: (0, False, 0, 0), 3: (5, True, 5, 3), 4: (1, False, 3, 2), 5: (2, True, 1, 2), 6: (0, False, 0, 0)}
    flat, energy = demand_shift([5, 4, 3], 2)
    assert flat.tolist() == [4.0] * 3 and energy == 6.0
    level, energy = demand_shift([6, 1, 0, 3], 4)
    assert level.tolist() == [4.0, 1.0, 2.0, 3.0] and energy == 2.0
    assert demand_shift([1, 2], 3)[1] == 0.0
    with pytest.raises(ValueError):
        demand_shift([1.0], 0)


def test_as_many_draws_as_asked_for():
    from tidepanel.functions.statespace import mcmc_series

    got = mcmc_series(np.random.default_rng(1).normal(size=12).cumsum(), 2, n_samples=420, burn_in=10)
    assert len(got.samples) == 420


def test_dbscan_of_a_long_chain(spark):
    from tidepanel.operators.clustering import dbscan_cluster

    # 200 cores one step apart, ids in a scattered order; two more far away, and noise.
    order = np.random.default_rng(1).permutation(200)
    rows = [(int(order[i]), [float(i)]) for i in range(200)] + [(300 + i, [500.0 + i]) for i in range(2)] + [(400, [900.0])]
    got = {r[0]: r.cluster for r in dbscan_cluster(spark.createDataFrame(rows, "unique_id long, series array<double>"), eps=1.0, min_samples=2).collect()}
    assert got == {**{i: 0 for i in range(200)}, 300: 1, 301: 1, 400: -1}
    with pytest.raises(RuntimeError):
        dbscan_cluster(spark.createDataFrame(rows, "unique_id long, series array<double>"), eps=1.0, min_samples=2, rounds=1)


def test_shapelets_label_every_series(spark):
    from tidepanel.operators.clustering import UShapeletClusterer

    rng, t = np.random.default_rng(2), np.linspace(0, 6.28, 24)
    rows = [(i, ((np.sin(3 * t) if i % 2 else t) + rng.normal(0, 0.01, 24)).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "unique_id long, series array<double>")
    got = {r[0]: r.cluster for r in UShapeletClusterer(2, n_candidates=20, most=12).fit(df).labels_.collect()}
    assert len(got) == 40 and {got[i] for i in range(0, 40, 2)} == {got[0]} and {got[i] for i in range(1, 40, 2)} == {1 - got[0]}
    assert sorted(r[0] for r in UShapeletClusterer(2, n_candidates=20, most=40).fit(df).labels_.collect()) == list(range(40))


def test_enbpi_and_streaming_use_all_rows(spark):
    from tidepanel.operators.ml import EnbPI
    from tidepanel.streaming.state import StreamingGlobalForecaster

    rng = np.random.default_rng(5)
    rows = [(k, i, float(rng.normal(0, s))) for k, s in (("a", 1.0), ("b", 30.0)) for i in range(150)]
    df = spark.createDataFrame(rows, "unique_id string, ds long, y double").coalesce(1)
    part, whole = EnbPI(None, 5, [1], max_rows=80).fit(df), EnbPI(None, 5, [1]).fit(df)
    count = lambda model: {r[0]: r[1] for r in model.sketches_.select("__id", F.kll_sketch_get_n_double("sketch")).collect()}
    width = lambda model: {r.unique_id: r.width for r in model.widths().collect()}
    before = count(part)
    # Of the wide series: the common intercept of a small sample is off by more than "a" spreads.
    assert sum(before.values()) > 270 and width(part)["b"] == pytest.approx(width(whole)["b"], rel=0.2)
    assert {k: n + 149 for k, n in before.items()} == count(part.update(df))

    class Seen:
        n = 0

        def partial_fit(self, x, y):
            self.n += len(y)

    assert StreamingGlobalForecaster(Seen(), [1], window_size=200, max_rows=80).partial_fit(df).estimator.n == 298


def test_pairs_are_formed_in_tasks_and_not_shuffled(spark):
    from tidepanel.functions.elastic import distances
    from tidepanel.operators import similarity as S

    rng = np.random.default_rng(11)
    x = [rng.normal(size=int(n)) for n in rng.integers(1, 9, 40)]
    x += [x[3].copy() for _ in range(6)]
    ids = [f"s{i}" for i in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "name string, series array<double>").repartition(3)
    d = {(a, b): float(distances("dtw", [p], [q])[0]) for a, p in zip(ids, x) for b, q in zip(ids, x) if a != b}
    pairs = S.pair_distances(df, df, "d", "dtw", {}, parts=20)
    assert "Join" not in pairs._jdf.queryExecution().toString() and "CartesianProduct" not in pairs._jdf.queryExecution().toString()
    got = {(r.id_1, r.id_2): r.d for r in pairs.collect()}
    assert len(got) == pairs.count() and set(got) == {p for p in d if p[0] < p[1]}
    assert all(v == pytest.approx(d[p], abs=1e-9) for p, v in got.items())
    near = {(r.id_1, r.id_2): r.d for r in S.pair_distances(df, df, "d", "dtw", {}, within=1.5).collect()}
    assert near == {p: pytest.approx(v, abs=1e-9) for p, v in got.items() if v <= 1.5} and 0 < len(near) < len(got)
    best = {(r.id_1, r["rank"]): r.id_2 for r in S.nearest_series(df, 3, "dtw").collect()}
    assert best == {(a, k + 1): b for a in ids for k, (_, b) in enumerate(sorted((round(d[a, b], 12), b) for b in ids if b != a)[:3])}
    labels = spark.createDataFrame([(i, int(i[1:]) % 3) for i in ids], "name string, cluster long")
    sums = {(r.id_1, r.c1, r.c2): (r.n, r.s, r.s2) for r in S.cluster_sums(df, labels, "dtw").collect()}
    for a in ids:
        for c in range(3):
            own = [d[a, b] for b in ids if b != a and int(b[1:]) % 3 == c]
            assert sums[a, int(a[1:]) % 3, c] == pytest.approx((len(own), sum(own), sum(v * v for v in own)))


def test_clara_and_clarans_without_the_matrix(spark, monkeypatch):
    from tidepanel.functions import clusters as C
    from tidepanel.operators import clustering

    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, rng.normal(i % 3, 0.4, 6).tolist()) for i in range(60)], "unique_id long, series array<double>")
    ids, d = clustering.distance_matrix(df, "dtw")
    monkeypatch.setattr(clustering, "MATRIX_SERIES", 10)
    for got, want in ((clustering.clara(df, 3, sample_size=12), C.clara(d, 3, sample_size=12)[0]), (clustering.clarans(df, 3), C.clarans(d, 3)[0])):
        assert {r.unique_id: r.cluster for r in got.collect()} == dict(zip(ids, want.tolist()))


def test_only_near_pairs_are_warped(monkeypatch):
    from tidepanel.functions import elastic

    rng = np.random.default_rng(2)
    x = [v / np.linalg.norm(v) for v in rng.normal(size=(60, 64))] + [rng.normal(size=k) / 8 for k in (1, 1, 2, 5, 40)]
    x += [v + 0.01 * rng.normal(size=len(v)) for v in x[:9]] + [np.repeat(x[0], 2), np.r_[x[1][:9], np.nan], np.empty(0)]
    cells, dtw = [0, 0], elastic.dtw

    def counted(a, na, b, nb, **options):
        cells[0] += max(len(na), len(nb))
        return dtw(a, na, b, nb, **options)

    step = elastic._dtw_step
    monkeypatch.setattr(elastic, "dtw", counted)
    monkeypatch.setitem(elastic.KERNELS, "dtw", (counted, *elastic.KERNELS["dtw"][1:]))
    whole = {(i, int(j)): v for i, at, d in elastic.block_distances("dtw", x, x) for j, v in zip(at, d)}
    monkeypatch.setattr(elastic, "_dtw_step", lambda x, y, i, *r: (cells.__setitem__(1, cells[1] + r[1].size), step(x, y, i, *r))[1])
    cells[0] = 0
    for within in (0.0, 0.3, 1.0, 5.0):
        near = {(i, int(j)): v for i, at, d in elastic.block_distances("dtw", x, x, None, within) for j, v in zip(at, d) if v <= within}
        assert near == {k: v for k, v in whole.items() if v <= within}
        if within == 1.0:
            assert len(near) > 80 and cells[0] < 0.6 * len(whole) and cells[1] < 400 * len(whole)
        cells[:] = 0, 0


def test_shapes_meet_as_products(spark, monkeypatch):
    """Series of one length need no transform for each pair, and neighbours that are
    left out before sorting lose no tie."""
    from tidepanel.functions.elastic import block_distances, sbd
    from tidepanel.operators.similarity import nearest_series

    rng = np.random.default_rng(12)
    x = [*rng.normal(size=(30, 16)), np.zeros(16), np.full(16, np.nan)]
    d = np.full((len(x), len(x)), np.nan)
    slow = lambda a, b: sbd(np.array([a, a]), np.array([16, 16]), np.array([b, b]), np.array([16, 16]))[0]
    expected = np.array([[slow(a, b) for b in x] for a in x])
    ragged = [rng.normal(size=n) for n in (5, 9, 16)]
    for i, at, found in block_distances("sbd", x[:3], ragged):
        for j, v in zip(at.tolist(), found):
            assert v == pytest.approx(1 - np.correlate(x[i], ragged[j], "full").max() / np.sqrt((x[i] @ x[i]) * (ragged[j] @ ragged[j])), abs=1e-12)
    with monkeypatch.context() as m:
        m.setattr(np.fft, "rfft", lambda *a: pytest.fail("a transform for each pair"))
        for i, at, found in block_distances("sbd", x, x, keep=lambda i: np.arange(len(x)) > i - 4):
            d[i, at] = found
    seen = np.arange(len(x)) > np.arange(len(x))[:, None] - 4
    assert np.allclose(d[seen], expected[seen], atol=1e-12, equal_nan=True)
    # Whole groups of equal series: ties go by id, whichever came first.
    base = rng.normal(size=(7, 16))
    rows = [(i, base[i % 7].tolist()) for i in range(60)]
    got = {(r.id_1, r["rank"]): r.id_2 for r in nearest_series(spark.createDataFrame(rows, "unique_id long, series array<double>"), 3, "sbd").collect()}
    assert got == {(i, k + 1): j for i in range(60) for k, j in enumerate([j for j in range(i % 7, 60, 7) if j != i][:3])}

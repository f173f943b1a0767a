"""Clusterings on blocks of the distance matrix are those of the whole matrix."""

import numpy as np
import pytest

from tidepanel.functions import clusters as C
from tidepanel.operators import blocks, clustering


@pytest.fixture
def small(monkeypatch):
    for module, name, value in ((clustering, "MATRIX_SERIES", 10), (blocks, "CHUNK", 30), (blocks, "FINISH", 30)):
        monkeypatch.setattr(module, name, value)


def frame(spark, n=70, digits=None, copies=4):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 6)) * 0.4 + np.arange(n)[:, None] % 4 * 2
    x = x if digits is None else np.round(x, digits)
    x[n // 2 : n // 2 + copies] = x[3]
    ids = [f"s{i}" for i in rng.permutation(n)]
    return spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "name string, series array<double>").repartition(3)


def whole(df, method):
    """The matrix by one function call, ids in order."""
    from tidepanel.functions.elastic import distances

    rows = sorted(df.collect())
    x = [np.array(r.series) for r in rows]
    d = np.triu([distances(method, [v] * len(x), x) for v in x], 1)
    return [r.name for r in rows], d + d.T


def labels(got):
    return {r[0]: r.cluster for r in got.collect()}


def test_kmedoids_and_hdbscan_on_blocks(spark, small):
    for digits in (None, 0):  # the second with many equal distances
        df = frame(spark, digits=digits)
        ids, d = whole(df, "dtw")
        assert labels(clustering.kmedoids(df, 3, id_col="name")) == dict(zip(ids, C.pam(d, 3)[0].tolist()))
        assert labels(clustering.hdbscan_cluster(df, min_cluster_size=3, id_col="name")) == dict(zip(ids, C.hdbscan(d, 3).tolist()))
    model = clustering.TimeSeriesKMedoids(3).fit(df, id_col="name")
    assert model.medoids_ == [ids[m] for m in C.pam(d, 3)[1]] and labels(model.labels_) == dict(zip(ids, C.pam(d, 3)[0].tolist()))


def test_agglomerative_on_blocks(spark, small):
    df = frame(spark)
    ids, d = whole(df, "dtw")
    for method in ("average", "complete"):
        got, z = clustering.agglomerative_cluster(df, n_clusters=3, linkage_method=method, id_col="name", return_linkage=True)
        want = C.linkage(d, method)
        assert labels(got) == dict(zip(ids, C.cut(want, len(ids), 3).tolist()))
        np.testing.assert_allclose(z[:, 2:], want[:, 2:])


def test_spectral_and_auto_cluster_on_blocks(spark, small):
    df = frame(spark, copies=0)
    ids, d = whole(df, "sbd")
    assert labels(clustering.spectral_cluster(df, 3, id_col="name")) == dict(zip(ids, C.spectral(d, 3).tolist()))
    got = clustering.auto_cluster(df, ["kmedoids", "agglomerative", "spectral", "clara"], distances_=["sbd"], k_range=[2, 3], id_col="name")
    sigma = float(np.median(d[d > 0]))
    for r in got.results_table.collect():
        own = {"kmedoids": lambda: C.pam(d, r.k)[0], "agglomerative": lambda: C.cut(C.linkage(d), len(ids), r.k), "spectral": lambda: C.spectral(d, r.k, sigma), "clara": lambda: C.clara(d, r.k)[0]}[r.method]()
        assert r.score == pytest.approx(clustering.silhouette_of(d, own), abs=1e-9), r
    assert sorted(labels(got.best_labels)) == ids


def test_merges_take_the_smallest_places_first():
    rng = np.random.default_rng(2)
    for method in ("average", "single", "complete", "weighted"):
        x = rng.integers(0, 4, (25, 2)).astype(float)
        d = np.abs(x[:, None] - x[None]).sum(2)
        left, size, want = d.copy(), np.ones(25), []
        np.fill_diagonal(left, np.inf)
        for _ in range(24):
            i, j = divmod(int(left.argmin()), 25)
            want.append((i, j, left[i, j]))
            left[i] = left[:, i] = C.merged(method, left[i], left[j], size[i], size[j])
            left[j] = left[:, j] = left[i, i] = np.inf
            size[i] += size[j]
        assert C.merges(d, method) == want

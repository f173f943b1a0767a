"""Clustering and classification of the series of a panel.

Distances come from the pairwise join, computed by the cluster. Algorithms that
need the whole matrix take it on the driver for up to ``MATRIX_SERIES`` series, and
work on the blocks that the cluster holds beyond (``blocks``); DBSCAN, assignment to
centres, k-NN and scores stay joins at any size.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions import clusters as C
from tidepanel.functions.elastic import block_distances, distances
from tidepanel.functions.stats import kmeans, ridge
from tidepanel.operators import similarity as S
from tidepanel.operators.convolution import MiniRocket, Rocket
from tidepanel.operators.rows import numbered
from tidepanel.panel import ID, TIME, Y, as_series, ensure, settled, type_of

MATRIX_SERIES = 5_000


def gathered(df: DataFrame, target_col: str, id_col: str, time_col: str) -> DataFrame:
    """(id, series); a frame that has a ``series`` column already stays as it is."""
    return df.select(id_col, "series") if "series" in df.columns else as_series(df, target_col, id_col, time_col)


def distance_matrix(df: DataFrame, method: str, target_col: str = Y, id_col: str = ID, time_col: str = TIME, **options) -> tuple[list, np.ndarray]:
    """Ids in order and their distances."""
    s = gathered(df, target_col, id_col, time_col)
    ids = [r[0] for r in s.select(id_col).orderBy(id_col).limit(MATRIX_SERIES + 1).collect()]
    ensure(len(ids) <= MATRIX_SERIES, f"a distance matrix is limited to {MATRIX_SERIES} series; use dbscan_cluster, clara on a subset, or kasba")
    kernel, options = S._kernel(method, options)
    pairs = S.pair_distances(s, s, "d", kernel, options).toPandas()
    at = {k: i for i, k in enumerate(ids)}
    d = np.zeros((len(ids), len(ids)))
    i, j = pairs["id_1"].map(at).to_numpy(), pairs["id_2"].map(at).to_numpy()
    d[i, j] = d[j, i] = pairs["d"].to_numpy()
    return ids, d


def _blocks(df: DataFrame, method: str, columns: tuple, options: dict):
    """The matrix as blocks, if there are more series than the driver takes; else None."""
    from tidepanel.operators.blocks import Blocks

    s = gathered(df, *columns)
    return Blocks(s, method, options) if s.limit(MATRIX_SERIES + 1).count() > MATRIX_SERIES else None


def _labels(df: DataFrame, ids: list, labels, id_col: str) -> DataFrame:
    rows = [(i, int(c)) for i, c in zip(ids, labels)]
    return df.sparkSession.createDataFrame(rows, f"`{id_col}` {type_of(df, id_col)}, cluster long")


def _check_k(k: int, n: int) -> None:
    ensure(1 <= k <= n, f"k must be from 1 to {n}")


def kmedoids(df: DataFrame, k: int, method: str = "dtw", max_iter: int = 100, seed: int = 42, id_col: str = ID, target_col: str = Y, time_col: str = TIME, **options) -> DataFrame:
    if blocks := _blocks(df, method, (target_col, id_col, time_col), options):
        _check_k(k, blocks.n)
        labels = blocks.pam(k, max_iter, seed)[0]
        blocks.close()
        return blocks.labelled(labels)
    ids, d = distance_matrix(df, method, target_col, id_col, time_col, **options)
    _check_k(k, len(ids))
    return _labels(df, ids, C.pam(d, k, max_iter, seed)[0], id_col)


class _Medoids:
    """Series numbered in the order of their ids. Only those asked for come to the driver;
    distances of all series to some medoids are worked out where the series are."""

    def __init__(self, df: DataFrame, k: int, method: str, columns: tuple, options: dict):
        self.id_col = columns[1]
        self.kernel, self.options = S._kernel(method, options)
        self.rows, self.n = numbered(gathered(df, *columns), [self.id_col])
        _check_k(k, self.n)
        self.held: dict[int, np.ndarray] = {}

    def series(self, places) -> list[np.ndarray]:
        new = [int(i) for i in set(places) - set(self.held)]
        if new:
            self.held |= {r["__i"]: np.array(r["series"], float) for r in self.rows.filter(F.col("__i").isin(new)).collect()}
        return [self.held[i] for i in places]

    def among(self, places) -> np.ndarray:
        v = self.series(places)
        d = np.array([distances(self.kernel, [x] * len(v), v, **self.options) for x in v])
        d = np.triu(d, 1)
        return d + d.T

    def _least(self, sets: list[list[int]], fn, schema: str) -> DataFrame:
        places = sorted({int(i) for m in sets for i in m})
        medoids, at, kernel, options, id_col = self.series(places), {p: j for j, p in enumerate(places)}, self.kernel, self.options, self.id_col

        def run(batches):
            for batch in batches:
                d = np.empty((len(medoids), len(batch)))
                for j, take, found in block_distances(kernel, medoids, S._arrays(batch.column(1), False), **options):
                    d[j, take] = found
                yield pa.RecordBatch.from_arrays(*fn(batch.column(0), [d[[at[int(i)] for i in m]] for m in sets], id_col))

        return self.rows.select(id_col, "series").mapInArrow(run, schema)

    def costs(self, sets: list[list[int]]) -> list[float]:
        """The sum of distances to the nearest medoid, for each set of medoids."""
        part = self._least(sets, lambda ids, d, _: ([pa.array([float(x.min(axis=0).sum())]) for x in d], [f"c{j}" for j in range(len(d))]), ", ".join(f"c{j} double" for j in range(len(sets))))
        return list(part.agg(*[F.sum(c) for c in part.columns]).first())

    def labels(self, medoids) -> DataFrame:
        return self._least([list(medoids)], lambda ids, d, name: ([ids, pa.array(d[0].argmin(axis=0))], [name, "cluster"]), f"`{self.id_col}` {type_of(self.rows, self.id_col)}, cluster long")


def clara(df: DataFrame, k: int, method: str = "dtw", n_samples: int = 5, sample_size: int = 40, max_iter: int = 100, seed: int = 42, id_col: str = ID, target_col: str = Y, time_col: str = TIME, **options) -> DataFrame:
    """Medoids of samples, valued on all series in one pass; the same as ``C.clara``."""
    every, rng, found = _Medoids(df, k, method, (target_col, id_col, time_col), options), random.Random(seed), []
    for s in range(n_samples):
        take = sorted(rng.sample(range(every.n), min(max(sample_size, k), every.n)))
        found.append(sorted(take[i] for i in C.pam(every.among(take), k, max_iter, seed + s)[1]))
    return every.labels(found[int(np.argmin(every.costs(found)))])


def clarans(df: DataFrame, k: int, method: str = "dtw", num_local: int = 2, max_neighbor: int = 10, seed: int = 42, id_col: str = ID, target_col: str = Y, time_col: str = TIME, **options) -> DataFrame:
    """The same as ``C.clarans``. All neighbours that can still be tried are drawn and valued
    in one pass; where one is better, the draws after it are taken back."""
    every, rng, best = _Medoids(df, k, method, (target_col, id_col, time_col), options), random.Random(seed), None

    def outside(m: list[int], j: int) -> int:
        for x in sorted(m):
            j += j >= x
        return j

    for _ in range(num_local):
        m = rng.sample(range(every.n), k)
        cost, tries = every.costs([m])[0], 0
        while tries < max_neighbor and k < every.n:
            drawn = []
            for _ in range(max_neighbor - tries):
                other = list(m)
                other[rng.randrange(k)] = outside(m, rng.choice(range(every.n - k)))
                drawn.append((other, rng.getstate()))
            new = every.costs([o for o, _ in drawn])
            better = next((t for t, c in enumerate(new) if c < cost), None)
            if better is None:
                break
            (m, state), cost, tries = drawn[better], new[better], 0
            rng.setstate(state)
        if best is None or cost < best[0]:
            best = (cost, sorted(m))
    return every.labels(best[1])


def agglomerative_cluster(df: DataFrame, method: str = "dtw", n_clusters: int = 2, linkage_method: str = "average", id_col: str = ID, target_col: str = Y, time_col: str = TIME, *, return_linkage: bool = False, **options):
    ensure(linkage_method in ("single", "complete", "average", "weighted"), f"unknown linkage {linkage_method!r}")
    if blocks := _blocks(df, method, (target_col, id_col, time_col), options):
        _check_k(n_clusters, blocks.n)
        z = blocks.linkage(linkage_method)
        blocks.close()
        out = blocks.labelled(C.cut(z, blocks.n, n_clusters))
        return (out, z) if return_linkage else out
    ids, d = distance_matrix(df, method, target_col, id_col, time_col, **options)
    _check_k(n_clusters, len(ids))
    z = C.linkage(d, linkage_method)
    out = _labels(df, ids, C.cut(z, len(ids), n_clusters), id_col)
    return (out, z) if return_linkage else out


def dbscan_cluster(df: DataFrame, method: str = "dtw", eps: float = 0.5, min_samples: int = 5, id_col: str = ID, target_col: str = Y, time_col: str = TIME, rounds: int = 50, **options) -> DataFrame:
    """Noise is -1; clusters are numbered by their smallest core id. Edges of at
    most eps, core counts and components are joins. A component is done in a number of
    rounds that grows with the logarithm of its length; more than ``rounds`` raises."""
    s = gathered(df, target_col, id_col, time_col)
    kernel, options = S._kernel(method, options)
    near = S.symmetric(S.pair_distances(s, s, "d", kernel, options, within=eps)).select("id_1", "id_2").cache()
    core = s.select(F.col(id_col).alias("id_1")).join(near, "id_1", "left").groupBy("id_1").agg((F.count("id_2") + 1).alias("n")).filter(F.col("n") >= min_samples).select(F.col("id_1").alias("c")).cache()
    edges = near.join(core, F.col("id_1") == F.col("c"), "left_semi").join(core, F.col("id_2") == F.col("c"), "left_semi").cache()
    label = _components(core, edges, rounds)
    from pyspark.sql import Window

    number = label.select("root").distinct().withColumn("cluster", F.row_number().over(Window.orderBy("root")).cast("long") - 1)
    known = label.join(number, "root").select("c", "cluster")
    border = near.join(known, F.col("id_2") == F.col("c")).groupBy(F.col("id_1").alias("b")).agg(F.min("cluster").alias("near"))
    out = s.select(id_col).join(known, F.col(id_col) == F.col("c"), "left").join(border, F.col(id_col) == F.col("b"), "left")
    return out.select(id_col, F.coalesce("cluster", "near", F.lit(-1).cast("long")).alias("cluster"))


def _components(core: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """(c, root): the smallest id of each node's component, by large and small stars
    (Kiveris et al. 2014). ``core``: c; ``edges``: id_1, id_2 in both directions."""

    def stars(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(low, "u").filter("v > u" if large else "v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out if large else out.unionByName(low.select("u", F.col("m").alias("v")))
        return out.filter("u <> v").distinct()

    pairs = settled(edges.filter("id_1 > id_2").select(F.col("id_1").alias("u"), F.col("id_2").alias("v")))
    sums = lambda p: tuple(p.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())
    before = sums(pairs)
    for _ in range(rounds):
        pairs = settled(stars(stars(pairs, True), False))
        now = sums(pairs)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return core.join(pairs, F.col("c") == F.col("u"), "left").select("c", F.coalesce("v", "c").alias("root"))


def hdbscan_cluster(df: DataFrame, method: str = "dtw", min_cluster_size: int = 5, min_samples: int | None = None, id_col: str = ID, target_col: str = Y, time_col: str = TIME, **options) -> DataFrame:
    if blocks := _blocks(df, method, (target_col, id_col, time_col), options):
        labels = blocks.hdbscan(min_cluster_size, min_samples)
        blocks.close()
        return blocks.labelled(labels)
    ids, d = distance_matrix(df, method, target_col, id_col, time_col, **options)
    return _labels(df, ids, C.hdbscan(d, min_cluster_size, min_samples), id_col)


def spectral_cluster(df: DataFrame, k: int = 3, method: str = "sbd", sigma: float = 1.0, id_col: str = ID, target_col: str = Y, time_col: str = TIME, seed: int = 42, **options) -> DataFrame:
    if blocks := _blocks(df, method, (target_col, id_col, time_col), options):
        _check_k(k, blocks.n)
        labels = blocks.spectral(k, sigma, seed)
        blocks.close()
        return blocks.labelled(labels)
    ids, d = distance_matrix(df, method, target_col, id_col, time_col, **options)
    _check_k(k, len(ids))
    return _labels(df, ids, C.spectral(d, k, sigma, seed), id_col)


# -- centres ---------------------------------------------------------------


def _sample(df: DataFrame, target_col: str, id_col: str, time_col: str, most: int | None = MATRIX_SERIES) -> tuple[list, list[np.ndarray]]:
    """Series to fit centres on: a hash sample of ``most``, or all if that is None."""
    rows = gathered(df, target_col, id_col, time_col)
    rows = rows.collect() if most is None else rows.orderBy(F.xxhash64(F.lit(1), id_col), id_col).limit(most).collect()
    rows.sort(key=lambda r: r[0])
    return [r[0] for r in rows], [np.array(r["series"], float) for r in rows]


def assign_to_centres(df: DataFrame, centres: list[np.ndarray], fn, target_col: str, id_col: str, time_col: str) -> DataFrame:
    """The nearest centre of every series; ``fn(list of series, centre)`` gives the
    distances of an Arrow batch."""

    @F.pandas_udf("long")
    def near(v: pd.Series) -> pd.Series:
        batch = [np.asarray(s, float) for s in v]
        return pd.Series(np.argmin([fn(batch, c) for c in centres], axis=0) if batch else [], dtype="int64")

    return gathered(df, target_col, id_col, time_col).select(id_col, near("series").alias("cluster"))


class KShape:
    """k-Shape. Beyond ``fit_series`` series the centres are those of a hash sample
    of so many (None: of all, on the driver); every series is assigned."""

    def __init__(self, n_clusters: int = 2, max_iter: int = 100, fit_series: int | None = MATRIX_SERIES):
        self.n_clusters, self.max_iter, self.fit_series = n_clusters, max_iter, fit_series

    def fit(self, df: DataFrame, id_col: str = ID, target_col: str = Y, time_col: str = TIME) -> KShape:
        _, series = _sample(df, target_col, id_col, time_col, self.fit_series)
        width = max(map(len, series))
        x = np.array([np.pad(s, (0, width - len(s))) for s in series])
        _check_k(self.n_clusters, len(x))
        _, self.centroids_ = C.kshape(x, self.n_clusters, self.max_iter)
        c, n = self.centroids_, width

        def shape(batch, m):
            return C.sbd_matrix(np.array([C.znorm(np.pad(s[:n], (0, n - len(s[:n])))) for s in batch]), m[None])[:, 0]

        self.labels_ = assign_to_centres(df, list(c), shape, target_col, id_col, time_col)
        return self


class TimeSeriesKMeans:
    """DTW assignment and barycentres. Beyond ``fit_series`` series the centres are
    those of a hash sample of so many (None: of all, on the driver)."""

    def __init__(self, n_clusters: int = 2, metric: str = "dtw", max_iter: int = 50, dba_max_iter: int = 30, seed: int = 42, fit_series: int | None = 1_000):
        ensure(metric == "dtw", "metric must be dtw")
        self.fit_series = fit_series
        self.n_clusters, self.max_iter, self.dba_max_iter, self.seed = n_clusters, max_iter, dba_max_iter, seed

    def fit(self, df: DataFrame, id_col: str = ID, target_col: str = Y, time_col: str = TIME) -> TimeSeriesKMeans:
        _, series = _sample(df, target_col, id_col, time_col, self.fit_series)
        _check_k(self.n_clusters, len(series))
        _, self.centroids_ = C.kmeans_dba(series, self.n_clusters, self.max_iter, self.dba_max_iter, self.seed)
        self.labels_ = assign_to_centres(df, self.centroids_, C.squared_dtw, target_col, id_col, time_col)
        return self


def kmeans_dba(df: DataFrame, k: int, max_iter: int = 50, seed: int = 42, **columns) -> DataFrame:
    return TimeSeriesKMeans(k, "dtw", max_iter, seed=seed).fit(df, **columns).labels_


class KASBAClusterer:
    def __init__(self, n_clusters: int = 8, c: float = 1.0, ba_subset_size: float = 0.5, initial_step_size: float = 0.05, decay_rate: float = 0.1, max_iter: int = 10, seed: int = 42, fit_series: int | None = 2_000):
        self.fit_series = fit_series  # as in TimeSeriesKMeans
        self.args = dict(k=n_clusters, c=c, max_iter=max_iter, subset=ba_subset_size, step=initial_step_size, decay=decay_rate, seed=seed)

    def fit(self, df: DataFrame, id_col: str = ID, target_col: str = Y, time_col: str = TIME) -> KASBAClusterer:
        self.columns = (target_col, id_col, time_col)
        _, series = _sample(df, target_col, id_col, time_col, self.fit_series)
        _check_k(self.args["k"], len(series))
        _, self.centroids_, self.inertia_ = C.kasba(series, **self.args)
        self.labels_ = self.predict(df)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        c = self.args["c"]
        return assign_to_centres(df, self.centroids_, lambda batch, m: distances("msm", batch, [m] * len(batch), c=c), *self.columns)


def kasba(df: DataFrame, k: int, *, c: float = 1.0, max_iter: int = 10, seed: int = 42, id_col: str = ID, target_col: str = Y, time_col: str = TIME) -> DataFrame:
    return KASBAClusterer(k, c, max_iter=max_iter, seed=seed).fit(df, id_col, target_col, time_col).labels_


class TimeSeriesKMedoids:
    def __init__(self, n_clusters: int = 2, metric: str = "dtw", max_iter: int = 100, seed: int = 42, **options):
        self.n_clusters, self.metric, self.max_iter, self.seed, self.options = n_clusters, metric, max_iter, seed, options

    def fit(self, df: DataFrame, id_col: str = ID, target_col: str = Y, time_col: str = TIME) -> TimeSeriesKMedoids:
        if blocks := _blocks(df, self.metric, (target_col, id_col, time_col), self.options):
            _check_k(self.n_clusters, blocks.n)
            labels, medoids = blocks.pam(self.n_clusters, self.max_iter, self.seed)
            blocks.close()
            found = {r["__i"]: r[id_col] for r in blocks.rows.filter(F.col("__i").isin(medoids.tolist())).collect()}
            self.medoids_, self.labels_ = [found[m] for m in medoids.tolist()], blocks.labelled(labels)
            return self
        ids, d = distance_matrix(df, self.metric, target_col, id_col, time_col, **self.options)
        _check_k(self.n_clusters, len(ids))
        labels, medoids = C.pam(d, self.n_clusters, self.max_iter, self.seed)
        self.medoids_, self.labels_ = [ids[m] for m in medoids], _labels(df, ids, labels, id_col)
        return self


class UShapeletClusterer:
    """Distances to the subsequences that split the series best, then k-means. Beyond
    ``most`` series, shapelets and centres come from a hash sample of them; every other
    series gets the nearest centre."""

    def __init__(self, n_clusters: int = 3, n_shapelets: int = 10, shapelet_lengths: list[int] | None = None, n_candidates: int = 100, target_col: str = Y, id_col: str = ID, time_col: str = TIME, seed: int = 42, most: int = MATRIX_SERIES):
        self.most = most
        self.k, self.n_shapelets, self.lengths, self.n_candidates, self.seed = n_clusters, n_shapelets, shapelet_lengths, n_candidates, seed
        self.columns = (target_col, id_col, time_col)

    @staticmethod
    def distance(s: np.ndarray, shapelet: np.ndarray) -> float:
        if len(s) < len(shapelet):
            s, shapelet = shapelet, s
        w = np.lib.stride_tricks.sliding_window_view(s, len(shapelet))
        return float(np.sqrt(((C.znorm(w) - C.znorm(shapelet)) ** 2).mean(1)).min())

    def fit(self, df: DataFrame) -> UShapeletClusterer:
        ids, series = _sample(df, *self.columns, self.most)
        _check_k(self.k, len(ids))
        rng = np.random.default_rng(self.seed)
        short = min(map(len, series))
        lengths = self.lengths or sorted({max(3, short // 4), max(3, short // 3), max(3, short // 2)})
        scored = []
        for _ in range(self.n_candidates):
            s, n = series[int(rng.integers(len(series)))], int(rng.choice(lengths))
            at = int(rng.integers(max(1, len(s) - n + 1)))
            shapelet = s[at : at + n]
            d = np.sort([self.distance(x, shapelet) for x in series])
            scored.append((float(np.diff(d).max(initial=0.0)), shapelet))
        scored.sort(key=lambda p: -p[0])
        self.shapelets_ = [s for _, s in scored[: self.n_shapelets]]
        x = np.array([[self.distance(s, p) for p in self.shapelets_] for s in series])
        found = np.asarray(kmeans(x, self.k, self.seed))
        self.labels_ = _labels(df, ids, found, self.columns[1])
        if len(ids) == self.most:
            names, distance, shapelets = np.unique(found), self.distance, self.shapelets_
            centres, id_col = np.array([x[found == c].mean(0) for c in names]), self.columns[1]

            @F.pandas_udf("long")
            def near(v: pd.Series) -> pd.Series:
                own = np.array([[distance(np.asarray(s, float), p) for p in shapelets] for s in v]).reshape(-1, 1, len(shapelets))
                return pd.Series(names[((own - centres) ** 2).sum(2).argmin(1)], dtype="int64")

            rest = gathered(df, *self.columns).join(self.labels_.select(id_col), id_col, "left_anti")
            self.labels_ = self.labels_.unionByName(rest.select(id_col, near("series").alias("cluster")))
        return self


def shapelet_cluster(df: DataFrame, k: int = 3, **options) -> DataFrame:
    return UShapeletClusterer(k, **options).fit(df).labels_


@dataclass
class AutoClusterResult:
    best_labels: DataFrame
    best_method: str
    best_distance: str
    best_k: int
    best_score: float
    results_table: DataFrame


def auto_cluster(df: DataFrame, methods: list[str] | None = None, distances_: list[str] | None = None, k_range: list[int] | None = None, metric: str = "silhouette", id_col: str = ID, target_col: str = Y, time_col: str = TIME, seed: int = 42) -> AutoClusterResult:
    """Methods by distances by k. Each distance is computed once and shared."""
    ensure(metric == "silhouette", "metric must be silhouette")
    methods, names, ks = methods or ["kmedoids", "agglomerative", "spectral"], distances_ or ["sbd", "dtw"], k_range or [2, 3, 4]
    rows, best = [], None
    for name in names:
        blocks = _blocks(df, name, (target_col, id_col, time_col), {})
        if blocks:
            n, tree, scale = blocks.n, cache(blocks.linkage), cache(blocks.median)
            make = {"kmedoids": lambda k: blocks.pam(k, seed=seed)[0], "agglomerative": lambda k: C.cut(tree(), n, k), "spectral": lambda k: blocks.spectral(k, scale(), seed)}
            make |= {m: lambda k, fit=fit: _in_order(fit(df, k, name, seed=seed, id_col=id_col, target_col=target_col, time_col=time_col), id_col) for m, fit in (("clara", clara), ("clarans", clarans))}
            value_of, label = blocks.silhouette, blocks.labelled
        else:
            ids, d = distance_matrix(df, name, target_col, id_col, time_col)
            n, tree, scale = len(ids), cache(lambda: C.linkage(d)), float(np.median(d[d > 0])) if (d > 0).any() else 1.0
            make = {"kmedoids": lambda k: C.pam(d, k, seed=seed)[0], "agglomerative": lambda k: C.cut(tree(), n, k), "spectral": lambda k: C.spectral(d, k, scale, seed), "clara": lambda k: C.clara(d, k, seed=seed)[0], "clarans": lambda k: C.clarans(d, k, seed=seed)[0]}
            value_of, label = (lambda labels: silhouette_of(d, labels)), (lambda labels: _labels(df, ids, labels, id_col))
        for method in methods:
            ensure(method in make, f"unknown method {method!r}")
            for k in [k for k in ks if 1 < k < n]:
                labels = make[method](k)
                value = value_of(labels)
                rows.append((method, name, k, value))
                if best is None or value > best[0]:
                    best = (value, method, name, k, labels, label)
        if blocks:
            blocks.close()
    ensure(best is not None, "nothing to compare")
    table = df.sparkSession.createDataFrame(rows, "method string, distance string, k long, score double")
    return AutoClusterResult(best[5](best[4]), best[1], best[2], best[3], best[0], table)


def _in_order(labels: DataFrame, id_col: str) -> np.ndarray:
    return np.array([r.cluster for r in labels.orderBy(id_col).collect()])


def silhouette_of(d: np.ndarray, labels: np.ndarray) -> float:
    found, own = np.unique(labels, return_inverse=True)
    if len(found) < 2:
        return 0.0
    return C.silhouette(np.stack([d[:, labels == c].sum(1) for c in found], axis=1), own)


# -- classifiers -----------------------------------------------------------


class KShapeClassifier:
    """The nearest class centroid by shape-based distance."""

    def __init__(self, n_centroids_per_class: int = 1, max_iter: int = 100):
        self.n, self.max_iter = n_centroids_per_class, max_iter

    def fit(self, df: DataFrame, label_col: str = "label", id_col: str = ID, target_col: str = Y, time_col: str = TIME) -> KShapeClassifier:
        self.columns = (target_col, id_col, time_col)
        ids, series = _sample(df, *self.columns)
        label = {r[0]: r[1] for r in df.groupBy(id_col).agg(F.min(label_col)).collect() if r[0] in set(ids)}
        self.width_ = max(map(len, series))
        x = C.znorm(np.array([np.pad(s, (0, self.width_ - len(s))) for s in series]))
        self.centroids_, self.classes_ = [], []
        for c in sorted(set(label.values())):
            own = x[[label[i] == c for i in ids]]
            found = [C.znorm(own.mean(0))] if self.n == 1 else list(C.kshape(own, min(self.n, len(own)), self.max_iter)[1])
            self.centroids_ += found
            self.classes_ += [c] * len(found)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        n, classes = self.width_, self.classes_

        def shape(batch, m):
            return C.sbd_matrix(np.array([C.znorm(np.pad(s[:n], (0, n - len(s[:n])))) for s in batch]), m[None])[:, 0]

        near = assign_to_centres(df, self.centroids_, shape, *self.columns)
        table = F.array(*[F.lit(c) for c in classes])
        return near.select(self.columns[1], F.get(table, F.col("cluster").cast("int")).alias("predicted_label"))


class _KernelClassifier:
    kind = Rocket

    def __init__(self, n_kernels: int = 500, alpha: float = 1.0, seed: int = 42, id_col: str = ID, target_col: str = Y, time_col: str = TIME):
        self.n_kernels, self.alpha, self.seed = n_kernels, alpha, seed
        self.columns = (target_col, id_col, time_col)

    def fit(self, df: DataFrame, label_col: str = "label") -> _KernelClassifier:
        ids, series = _sample(df, *self.columns)
        label = {r[0]: r[1] for r in df.groupBy(self.columns[1]).agg(F.min(label_col)).collect()}
        self.kernels_ = self.kind(self.n_kernels, self.seed).fit(series)
        x = self.kernels_.transform(series)
        self.classes_ = sorted({label[i] for i in ids})
        y = np.array([[1.0 if label[i] == c else -1.0 for c in self.classes_] for i in ids])
        self.scale_ = (x.mean(0), np.maximum(x.std(0), 1e-9))
        self.coef_, self.intercept_ = ridge((x - self.scale_[0]) / self.scale_[1], y, self.alpha)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        kernels, coef, intercept, scale = self.kernels_, self.coef_, self.intercept_, self.scale_

        @F.pandas_udf("int")
        def best(v: pd.Series) -> pd.Series:
            x = kernels.transform([np.asarray(s, float) for s in v])
            return pd.Series((((x - scale[0]) / scale[1]) @ coef + intercept).argmax(1))

        rows = gathered(df, *[self.columns[0], self.columns[1], self.columns[2]])
        table = F.array(*[F.lit(c) for c in self.classes_])
        return rows.select(self.columns[1], F.get(table, best("series")).alias("predicted_label"))


class RocketClassifier(_KernelClassifier):
    kind = Rocket


class MiniRocketClassifier(_KernelClassifier):
    kind = MiniRocket

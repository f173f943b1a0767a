"""Clustering of a distance matrix or of equal-length series, in numpy."""

from __future__ import annotations

import heapq
import random

import numpy as np

from tidepanel.functions.elastic import distances, pad
from tidepanel.functions.stats import kmeans


class Lcg:
    """The 64-bit linear congruential generator of k-medoids."""

    def __init__(self, seed: int):
        self.state = seed & (2**64 - 1)

    def next(self) -> int:
        self.state = (self.state * 6364136223846793005 + 1442695040888963407) & (2**64 - 1)
        return self.state >> 33


def start(n: int, k: int, seed: int) -> list[int]:
    """The medoids that k-medoids begins with."""
    rng, pool, medoids = Lcg(seed), list(range(n)), []
    for _ in range(k):
        j = rng.next() % len(pool)
        medoids.append(pool[j])
        pool[j] = pool[-1]
        pool.pop()
    return medoids


def pam(d: np.ndarray, k: int, max_iter: int = 100, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Labels and sorted medoids: seeded start, best swap per round. All swaps of a
    round are valued by one array expression per medoid."""
    n, medoids = len(d), start(len(d), k, seed)
    for _ in range(max_iter):
        near = np.sort(d[:, medoids], axis=1)
        best = (near[:, 0].sum() - 1e-12, None)
        for i in range(k):
            rest = [m for j, m in enumerate(medoids) if j != i]
            base = d[:, rest].min(axis=1) if rest else np.full(n, np.inf)
            cost = np.minimum(base[:, None], d).sum(axis=0)
            cost[medoids] = np.inf
            j = int(np.argmin(cost))
            if cost[j] < best[0]:
                best = (cost[j], (i, j))
        if best[1] is None:
            break
        medoids[best[1][0]] = best[1][1]
    medoids = np.array(sorted(medoids))
    return d[:, medoids].argmin(axis=1), medoids


def clara(d: np.ndarray, k: int, n_samples: int = 5, sample_size: int = 40, max_iter: int = 100, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    rng, best = random.Random(seed), None
    for s in range(n_samples):
        take = sorted(rng.sample(range(len(d)), min(max(sample_size, k), len(d))))
        _, m = pam(d[np.ix_(take, take)], k, max_iter, seed + s)
        m = np.array(sorted(take[i] for i in m))
        cost = d[:, m].min(axis=1).sum()
        if best is None or cost < best[0]:
            best = (cost, m)
    return d[:, best[1]].argmin(axis=1), best[1]


def clarans(d: np.ndarray, k: int, num_local: int = 2, max_neighbor: int = 10, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    rng, best = random.Random(seed), None
    for _ in range(num_local):
        m = rng.sample(range(len(d)), k)
        cost, tries = d[:, m].min(axis=1).sum(), 0
        while tries < max_neighbor and k < len(d):
            other = list(m)
            other[rng.randrange(k)] = rng.choice([i for i in range(len(d)) if i not in m])
            new = d[:, other].min(axis=1).sum()
            if new < cost:
                m, cost, tries = other, new, 0
            else:
                tries += 1
        if best is None or cost < best[0]:
            best = (cost, np.array(sorted(m)))
    return d[:, best[1]].argmin(axis=1), best[1]


def merged(method: str, a, b, n_a, n_b):
    """Distances of the union of two clusters of n_a and n_b members from theirs."""
    if method == "average":
        return (n_a * a + n_b * b) / (n_a + n_b)
    return {"single": np.minimum, "complete": np.maximum, "weighted": lambda x, y: (x + y) / 2}[method](a, b)


def merges(d: np.ndarray, method: str = "average", size: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """(i, j, height) by Lance and Williams' update; the union of i and j, i < j, keeps
    place i. The smallest places go first among equal heights."""
    n = len(d)
    d = np.minimum(d, d.T).astype(float)
    np.fill_diagonal(d, np.inf)
    size, out, low = np.ones(n) if size is None else np.array(size, float), [], d.min(axis=1, initial=np.inf)
    live = np.ones(n, bool)
    for _ in range(n - 1):
        i = int(np.argmin(low))
        i, j = (i, int(np.argmin(d[i]))) if low[i] < np.inf else np.flatnonzero(live)[:2].tolist()
        out.append((i, j, float(d[i, j])))
        stale = (np.minimum(d[i], d[j]) <= low) & (low < np.inf)  # whose nearest one was one of the two
        new = merged(method, d[i], d[j], size[i], size[j])
        d[i], d[:, i] = new, new
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        live[j] = False
        size[i] += size[j]
        low = np.minimum(low, d[i])
        stale[[i, j]] = True
        low[stale] = d[stale].min(axis=1)
    return out


def named(found: list[tuple[int, int, float]], n: int) -> np.ndarray:
    """Rows (a, b, height, size) of merges; the union of step s is named n + s."""
    name, size, out = list(range(n)), [1] * n, []
    for step, (i, j, h) in enumerate(found):
        out.append((min(name[i], name[j]), max(name[i], name[j]), h, size[i] + size[j]))
        name[i], size[i] = n + step, size[i] + size[j]
    return np.array(out).reshape(-1, 4)


def linkage(d: np.ndarray, method: str = "average") -> np.ndarray:
    """Rows (a, b, height, size) by Lance and Williams' update."""
    return named(merges(d, method), len(d))


class Sets:
    """Disjoint sets; each is known by its smallest member."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b

    def roots(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.parent))])


def bottlenecks(n: int, tree: list[tuple[float, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The place of each node in an order in which the longest edge between two nodes
    of a tree is the largest gap between their places, and the largest of 2^k gaps from
    each place on."""
    sets, head, tail, after, gap = Sets(n), list(range(n)), list(range(n)), [-1] * n, [0.0] * n
    for w, a, b in sorted(tree):
        a, b = sets.find(a), sets.find(b)
        after[tail[a]], gap[tail[a]] = head[b], w
        sets.join(a, b)
        head[min(a, b)], tail[min(a, b)] = head[a], tail[b]
    place, gaps, at = np.zeros(n, int), np.zeros(n), head[sets.find(0)]
    for p in range(n):
        place[at], gaps[p] = p, gap[at]
        at = after[at]
    table = [gaps]
    while 1 << len(table) < n:
        half = 1 << (len(table) - 1)
        table.append(np.maximum(table[-1], np.append(table[-1][half:], np.zeros(half))))
    return place, np.array(table)


def single_merges(n: int, w: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, float]]:
    """The merges of single linkage, as ``merges`` orders them, from all edges that are as
    long as the longest one on the way between their ends in a least tree."""
    sets, out, order = Sets(n), [], np.argsort(w, kind="stable")
    bounds = np.append(np.flatnonzero(np.diff(w[order], prepend=-np.inf)), len(order))
    for lo, hi in zip(bounds, bounds[1:]):
        beside: dict[int, set[int]] = {}
        for e in order[lo:hi].tolist():
            p, q = sets.find(int(a[e])), sets.find(int(b[e]))
            if p != q:
                beside.setdefault(p, set()).add(q)
                beside.setdefault(q, set()).add(p)
        done: set[int] = set()
        for p in sorted(beside):
            if p in done:
                continue
            done.add(p)
            todo = list(beside[p])
            heapq.heapify(todo)
            while todo:
                q = heapq.heappop(todo)
                if q not in done:
                    done.add(q)
                    out.append((p, q, float(w[order[lo]])))
                    sets.join(p, q)
                    for x in beside[q] - done:
                        heapq.heappush(todo, x)
    return out


def cut(z: np.ndarray, n: int, k: int) -> np.ndarray:
    """Labels from 0 (by first member) after merging down to k clusters."""
    parent = list(range(2 * n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for step in range(max(n - k, 0)):
        parent[find(int(z[step, 0]))] = parent[find(int(z[step, 1]))] = n + step
    roots = [find(i) for i in range(n)]
    order = {r: i for i, r in enumerate(dict.fromkeys(roots))}
    return np.array([order[r] for r in roots])


def dbscan(d: np.ndarray, eps: float, min_samples: int) -> np.ndarray:
    near = d <= eps
    core, labels, c = near.sum(1) >= min_samples, np.full(len(d), -1), 0
    for i in np.flatnonzero(core):
        if labels[i] >= 0:
            continue
        todo, labels[i] = [i], c
        while todo:
            for j in np.flatnonzero(near[todo.pop()]):
                if labels[j] < 0:
                    labels[j] = c
                    if core[j]:
                        todo.append(j)
        c += 1
    return labels


def hdbscan(d: np.ndarray, min_cluster_size: int = 5, min_samples: int | None = None) -> np.ndarray:
    """Mutual reachability, single linkage, condensed tree, excess of mass."""
    n, m = len(d), min_samples or min_cluster_size
    if n < 2 or n < min_cluster_size:
        return np.full(n, -1)
    core = np.sort(d, axis=1)[:, min(m - 1, n - 1)]
    return flat_clusters(linkage(np.maximum(np.maximum(core[:, None], core[None, :]), d), "single"), n, min_cluster_size)


def flat_clusters(z: np.ndarray, n: int, min_cluster_size: int) -> np.ndarray:
    """The condensed tree of merges ``z`` and its clusters by excess of mass."""
    kids = {n + i: (int(a), int(b)) for i, (a, b, _, _) in enumerate(z)}
    height = {n + i: float(h) for i, (_, _, h, _) in enumerate(z)}
    size = {**{i: 1 for i in range(n)}, **{n + i: int(s) for i, (*_, s) in enumerate(z)}}

    def leaves(node):
        out, todo = [], [node]
        while todo:
            x = todo.pop()
            if x < n:
                out.append(x)
            else:
                todo += kids[x]
        return out

    root = 2 * n - 2
    clusters: dict[int, dict] = {}  # parents before their children
    todo = [(root, 0.0)]
    while todo:
        node, birth = todo.pop()
        here = clusters[node] = {"stability": 0.0, "children": []}
        at = node
        while at >= n:
            lam = 1 / max(height[at], 1e-12)
            big = [x for x in kids[at] if size[x] >= min_cluster_size]
            if len(big) == 2:
                here["stability"] += size[at] * (lam - birth)
                here["children"] = list(kids[at])
                todo += [(x, lam) for x in kids[at]]
                break
            here["stability"] += sum(size[x] for x in kids[at] if x not in big) * (lam - birth)
            if not big:
                break
            at = big[0]
    picked: dict[int, tuple[float, list[int]]] = {}
    for node in reversed(clusters):
        c = clusters[node]
        below = [picked.pop(x) for x in c["children"]]
        total = sum(b[0] for b in below)
        if node != root and c["stability"] >= total:
            picked[node] = (c["stability"], [node])
        else:
            picked[node] = (total, [x for b in below for x in b[1]]) if below else (c["stability"], [])
    labels = np.full(n, -1)
    members = sorted((leaves(x) for x in picked[root][1]), key=min)
    for i, found in enumerate(members):
        labels[found] = i
    return labels


def leading(times, n: int, k: int, block: int, basis: int, steps: int) -> np.ndarray:
    """Eigenvectors of the k largest eigenvalues of a symmetric matrix with norm about 1,
    from its products with some vectors: Rayleigh-Ritz with residuals as new directions,
    restarted from the best half when the basis is full."""
    rng, block = np.random.default_rng(0), min(block, n)
    q = np.linalg.qr(rng.normal(size=(n, block)))[0]
    aq = times(q)
    for _ in range(steps):
        value, y = np.linalg.eigh((q.T @ aq + aq.T @ q) / 2)
        y, value = y[:, ::-1], value[::-1]
        wide = y[:, :block]
        x = q @ wide
        rest = aq @ wide - x * value[:block]
        if q.shape[1] == n or np.linalg.norm(rest[:, :k], axis=0).max() <= 1e-10:
            return x[:, :k]
        if q.shape[1] + block > max(basis, 3 * block):
            q, aq = q @ y[:, : q.shape[1] // 2], aq @ y[:, : q.shape[1] // 2]
        rest = rest[:, : n - q.shape[1]]
        rest /= np.maximum(np.linalg.norm(rest, axis=0), 1e-300)
        for _ in range(3):
            rest = np.linalg.qr(rest - q @ (q.T @ rest))[0]
        q, aq = np.concatenate([q, rest], axis=1), np.concatenate([aq, times(rest)], axis=1)
    raise RuntimeError(f"eigenvectors did not settle in {steps} steps")


def spectral(d: np.ndarray, k: int, sigma: float = 1.0, seed: int = 42) -> np.ndarray:
    w = np.exp(-(d**2) / (2 * sigma**2))
    np.fill_diagonal(w, 0)
    s = 1 / np.sqrt(np.maximum(w.sum(1), 1e-12))
    _, vec = np.linalg.eigh(np.eye(len(d)) - s[:, None] * w * s[None, :])
    x = vec[:, :k]
    return kmeans(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12), k, seed)


def silhouette(sums: np.ndarray, own: np.ndarray) -> float:
    """From each one's sums of distances to the clusters, and the place of its own."""
    size, at = np.bincount(own, minlength=sums.shape[1]), np.arange(len(sums))
    means = sums / np.maximum(size - (own[:, None] == np.arange(sums.shape[1])), 1)
    a = means[at, own]
    means[at, own] = np.inf
    b = means.min(axis=1)
    return float(np.where(np.maximum(a, b) > 0, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0).mean())


def znorm(x: np.ndarray) -> np.ndarray:
    s = x.std(axis=-1, keepdims=True)
    return (x - x.mean(axis=-1, keepdims=True)) / np.where(s > 0, s, 1)


def sbd_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shape-based distances of all rows of a to all rows of b, by FFT."""
    n = a.shape[1] + b.shape[1] - 1
    fa, fb = np.fft.rfft(a, n), np.fft.rfft(b, n)
    cc = np.fft.irfft(fa[:, None] * np.conj(fb)[None], n).max(-1)
    norm = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None]
    return np.where(norm > 0, 1 - cc / np.where(norm > 0, norm, 1), 1.0)


def kshape(x: np.ndarray, k: int, max_iter: int = 100) -> tuple[np.ndarray, np.ndarray]:
    x = znorm(x)
    labels, c = np.arange(len(x)) % k, np.zeros((k, x.shape[1]))
    centre = np.eye(x.shape[1]) - 1 / x.shape[1]
    for _ in range(max_iter):
        for j in range(k):
            own = x[labels == j]
            if len(own):
                v = np.linalg.eigh(centre @ (own.T @ own) @ centre)[1][:, -1]
                c[j] = znorm(v if ((own - v) ** 2).sum() < ((own + v) ** 2).sum() else -v)
        new = sbd_matrix(x, c).argmin(1)
        if np.array_equal(new, labels):
            break
        labels = new
    return labels, c


# -- elastic averages ------------------------------------------------------


def _warped(series: list[np.ndarray], centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cumulated squared costs of all series against one centre, filled over
    anti-diagonals: (series, lengths, costs with a border row and column; the
    centre runs along axis 1)."""
    x, length = pad(series)
    n, m = len(centre), x.shape[1]
    d = np.full((len(series), n + 1, m + 1), np.inf)
    d[:, 0, 0] = 0.0
    for s in range(2, n + m + 1):
        i = np.arange(max(1, s - m), min(n, s - 1) + 1)
        j = s - i
        least = np.minimum(np.minimum(d[:, i - 1, j - 1], d[:, i - 1, j]), d[:, i, j - 1])
        d[:, i, j] = (centre[i - 1] - x[:, j - 1]) ** 2 + least
    return x, length, d


#: Series in a batch of ``_warped``: its costs stay near 100 MB at 200 values.
_BATCH = 256


def squared_dtw(series: list[np.ndarray], centre: np.ndarray) -> np.ndarray:
    """Squared-cost DTW of every series to the centre."""
    out = []
    for at in range(0, len(series), _BATCH):
        _, length, d = _warped(series[at : at + _BATCH], centre)
        out.append(d[np.arange(len(d)), len(centre), length])
    return np.concatenate(out) if out else np.zeros(0)


def _barycentre(series: list[np.ndarray], mean: np.ndarray) -> np.ndarray:
    """Means of the values that the warping paths of all series put on each place."""
    total, count = np.zeros(len(mean)), np.zeros(len(mean))
    for at in range(0, len(series), _BATCH):
        x, j, d = _warped(series[at : at + _BATCH], mean)
        r, i = np.arange(len(d)), np.full(len(d), len(mean))
        while len(r):
            np.add.at(total, i - 1, x[r, j - 1])
            np.add.at(count, i - 1, 1)
            # A tie prefers the diagonal, then the step along the centre.
            way = np.argmin([d[r, i - 1, j - 1], d[r, i - 1, j], d[r, i, j - 1]], axis=0)
            i, j = i - (way < 2), j - (way != 1)
            on = (i > 0) & (j > 0)
            r, i, j = r[on], i[on], j[on]
    return total / np.maximum(count, 1)


def dba(series: list[np.ndarray], max_iter: int = 30, tol: float = 1e-5, init: np.ndarray | None = None) -> np.ndarray:
    """DTW barycentre; starts from the medoid of the zero-padded series."""
    if init is None:
        p = pad(series)[0]
        init = series[int(np.argmin([np.linalg.norm(p - q, axis=1).sum() for q in p]))]
    mean = np.array(init, float)
    for _ in range(max_iter):
        new = _barycentre(series, mean)
        if np.abs(new - mean).max() < tol:
            return new
        mean = new
    return mean


def kmeans_dba(series: list[np.ndarray], k: int, max_iter: int = 50, dba_max_iter: int = 30, seed: int = 42) -> tuple[np.ndarray, list[np.ndarray]]:
    rng = random.Random(seed)
    c = [np.array(series[i], float) for i in rng.sample(range(len(series)), k)]
    labels = None
    for _ in range(max_iter):
        new = np.argmin([squared_dtw(series, m) for m in c], axis=0)
        if labels is not None and np.array_equal(new, labels):
            break
        labels = new
        c = [dba([s for s, g in zip(series, labels) if g == j], dba_max_iter, init=c[j]) if (labels == j).any() else c[j] for j in range(k)]
    return labels, c


def _msm_path(x: np.ndarray, y: np.ndarray, c: float) -> tuple[float, list[tuple[int, int]]]:
    def cost(new, before, other):
        inside = min(before, other) <= new <= max(before, other)
        return c if inside else c + min(abs(new - before), abs(new - other))

    n, m = len(x), len(y)
    d = np.full((n, m), np.inf)
    d[0, 0] = abs(x[0] - y[0])
    for i in range(1, n):
        d[i, 0] = d[i - 1, 0] + cost(x[i], x[i - 1], y[0])
    for j in range(1, m):
        d[0, j] = d[0, j - 1] + cost(y[j], x[0], y[j - 1])
    for i in range(1, n):
        for j in range(1, m):
            d[i, j] = min(d[i - 1, j - 1] + abs(x[i] - y[j]), d[i - 1, j] + cost(x[i], x[i - 1], y[j]), d[i, j - 1] + cost(y[j], x[i], y[j - 1]))
    i, j, out = n - 1, m - 1, [(n - 1, m - 1)]
    while i or j:
        i, j = min(((a, b) for a, b in ((i - 1, j - 1), (i - 1, j), (i, j - 1)) if a >= 0 and b >= 0), key=lambda p: d[p])
        out.append((i, j))
    return float(d[-1, -1]), out


def kasba(x: list[np.ndarray], k: int, c: float = 1.0, max_iter: int = 10, subset: float = 0.5, step: float = 0.05, decay: float = 0.1, seed: int = 42) -> tuple[np.ndarray, list[np.ndarray], float]:
    """k-means under move-split-merge with stochastic subgradient barycentres:
    labels, centres and inertia. Centres that lie twice as far from a centre as the
    series does are not compared (triangle inequality)."""
    rng = np.random.default_rng(seed)
    centres = [x[int(rng.integers(len(x)))].copy()]
    while len(centres) < k:
        d = np.min([distances("msm", x, [m] * len(x), c=c) for m in centres], axis=0)
        centres.append(x[int(rng.choice(len(x), p=d / d.sum())) if d.sum() > 0 else int(rng.integers(len(x)))].copy())

    def assign():
        between = np.array([[distances("msm", [a], [b], c=c)[0] for b in centres] for a in centres])
        labels, best = np.zeros(len(x), int), distances("msm", x, [centres[0]] * len(x), c=c)
        for j in range(1, k):
            may = np.flatnonzero(between[labels, j] < 2 * best)
            if len(may):
                d = distances("msm", [x[i] for i in may], [centres[j]] * len(may), c=c)
                better = may[d < best[may]]
                best[better], labels[better] = d[d < best[may]], j
        return labels, best

    labels, best = assign()
    for _ in range(max_iter):
        for j in range(k):
            own = np.flatnonzero(labels == j)
            if not len(own):
                far = int(best.argmax())
                centres[j], best[far] = x[far].copy(), 0.0
                continue
            take = rng.permutation(own)[: max(min(10, len(own)), int(subset * len(own)))]
            for i, s in enumerate(take):
                rate = step * np.exp(-decay * i)
                grad = np.zeros(len(centres[j]))
                for a, b in _msm_path(centres[j], x[s], c)[1]:
                    grad[a] += 2 * (centres[j][a] - x[s][b])
                centres[j] = centres[j] - rate * grad
        new, best = assign()
        if np.array_equal(new, labels):
            break
        labels = new
    return labels, centres, float((best**2).sum())

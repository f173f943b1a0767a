"""Kernels pass over cells that cannot count, and give the values of a program over all cells."""

import numpy as np
import pytest

from tidepanel.functions import elastic


def table_of(a, b, cell):
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = cell(i, j, d[i - 1, j - 1], d[i - 1, j], d[i, j - 1])
    return d


def pairs_of(name, left, right, **options):
    return {(i, int(j)): v for i, at, d in elastic.block_distances(name, left, right, **options) for j, v in zip(at, d)}


def some(rng, sizes):
    return [rng.normal(size=k) for k in sizes]


@pytest.mark.parametrize("name, options, share", [("sakoe_chiba", {"window": 3}, 0.2), ("itakura", {}, 0.5)])
def test_bands_are_all_that_is_filled(monkeypatch, name, options, share):
    rng, seen, step = np.random.default_rng(1), [0], elastic._dtw_step
    left, right = some(rng, [64] * 3), some(rng, [64] * 9)
    monkeypatch.setattr(elastic, "_dtw_step", lambda x, y, i, j, g, u, l: (seen.__setitem__(0, seen[0] + g.size), step(x, y, i, j, g, u, l))[1])
    got = pairs_of(name, left, right, **options)
    assert seen[0] < share * 27 * 64 * 64

    def inside(i, j):
        if name == "sakoe_chiba":
            return abs(i - j) <= 3
        x, y = i - 1, j - 1
        return x / 2 <= y <= 2 * x and (63 - x) / 2 <= 63 - y <= 2 * (63 - x)

    for (p, q), v in got.items():
        a, b = left[p], right[q]
        assert v == pytest.approx(table_of(a, b, lambda i, j, g, u, l: abs(a[i - 1] - b[j - 1]) + min(g, u, l) if inside(i, j) else np.inf)[-1, -1])


def brute_fast(a, b, radius):
    """FastDTW with cells in sets and the path by a walk back."""
    n, m = len(a), len(b)
    cells = {(i, j) for i in range(n) for j in range(m)}
    if n > radius + 2 and m > radius + 2:
        half = lambda v: [*v[: len(v) // 2 * 2].reshape(-1, 2).mean(axis=1), *v[len(v) // 2 * 2 :]]
        path = brute_fast(np.array(half(a)), np.array(half(b)), radius)[1]
        spans = {}
        for p, q in path:
            for i in range(max(0, 2 * p - 2 * radius), min(n, 2 * p + 2 * radius + 2)):
                lo, hi = spans.get(i, (m, -1))
                spans[i] = min(lo, max(0, 2 * (q - radius))), max(hi, min(m - 1, 2 * (q + radius) + 1))
        cells = {(i, j) for i, (lo, hi) in spans.items() for j in range(lo, hi + 1)}
    d = table_of(a, b, lambda i, j, g, u, l: abs(a[i - 1] - b[j - 1]) + min(g, u, l) if (i - 1, j - 1) in cells else np.inf)
    i, j, path = n, m, []
    while i and j:
        path.append((i - 1, j - 1))
        k = int(np.argmin([d[i - 1, j - 1], d[i - 1, j], d[i, j - 1]]))
        i, j = i - (k < 2), j - (k != 1)
    return d[-1, -1], path


def test_fast_dtw_against_brute_force():
    rng = np.random.default_rng(4)
    left, right = some(rng, [24, 24, 37, 5, 1]), some(rng, [24, 24, 24, 31, 8, 3])
    right += [np.repeat(left[0], 2), np.round(left[2])]
    for radius in (0, 2):
        got = pairs_of("fast_dtw", left, right, radius=radius)
        assert len(got) == len(left) * len(right)
        for (p, q), v in got.items():
            assert v == pytest.approx(brute_fast(left[p], right[q], radius)[0]), (p, q, radius)


def test_msm_and_lcss_against_brute_force():
    rng = np.random.default_rng(6)
    left, right = some(rng, [12, 12, 7, 1]), [*some(rng, [12, 12, 9, 1]), np.round(rng.normal(size=12)), rng.normal(size=200)]

    def cost(new, back, other):
        return 0.5 if min(back, other) <= new <= max(back, other) else 0.5 + min(abs(new - back), abs(new - other))

    msm, lcss = pairs_of("msm", left, right, c=0.5), pairs_of("lcss", left, right, epsilon=0.3)
    for p, a in enumerate(left):
        for q, b in enumerate(right):
            whole = table_of(a, b, lambda i, j, g, u, l: min(g + abs(a[i - 1] - b[j - 1]), u + cost(a[i - 1], a[i - 2], b[j - 1]) if i > 1 else np.inf, l + cost(b[j - 1], b[j - 2], a[i - 1]) if j > 1 else np.inf))
            assert msm[p, q] == pytest.approx(whole[-1, -1])
            t = np.zeros((len(a) + 1, len(b) + 1))
            for i in range(len(a)):
                for j in range(len(b)):
                    t[i + 1, j + 1] = t[i, j] + 1 if abs(a[i] - b[j]) <= 0.3 else max(t[i, j + 1], t[i + 1, j])
            assert lcss[p, q] == pytest.approx(1 - t[-1, -1] / min(len(a), len(b)))


def test_msm_fills_what_its_bound_reaches(monkeypatch):
    rng, seen, sweep = np.random.default_rng(10), [0], elastic.sweep

    def counted(left, na, right, nb, step, **more):
        return sweep(left, na, right, nb, lambda x, y, i, j, g, u, l: (seen.__setitem__(0, seen[0] + g.size), step(x, y, i, j, g, u, l))[1], **more)

    monkeypatch.setattr(elastic, "sweep", counted)
    unit = lambda v: v / np.linalg.norm(v)
    left, right = [unit(v) for v in some(rng, [64] * 3)], [unit(v) for v in some(rng, [64] * 300)]
    right[0] = left[0].copy()
    right[1] = np.roll(left[0], 9) * 20  # far beyond the others
    got = pairs_of("msm", left, right)
    assert len(got) == 900 and seen[0] < 0.25 * 900 * 64 * 64 and got[0, 0] == 0

    def brute(a, b, c):
        cost = lambda new, back, other: c if min(back, other) <= new <= max(back, other) else c + min(abs(new - back), abs(new - other))
        return table_of(a, b, lambda i, j, g, u, l: min(g + abs(a[i - 1] - b[j - 1]), u + cost(a[i - 1], a[i - 2], b[j - 1]) if i > 1 else np.inf, l + cost(b[j - 1], b[j - 2], a[i - 1]) if j > 1 else np.inf))[-1, -1]

    for (p, q), v in got.items():
        if q < 4:
            assert v == pytest.approx(brute(left[p], right[q], 1.0)), (p, q)
    # Bounds of every width, shapes that differ, and values that bound nothing.
    for n, m, c in ((9, 9, 0.05), (9, 9, 0.6), (7, 12, 0.1), (12, 7, 0.3), (1, 5, 0.2), (6, 6, 0.0)):
        a, b = rng.normal(size=(8, n)).cumsum(axis=1), rng.normal(size=(8, m)).cumsum(axis=1) * 3
        for gain in (0, 5000):
            found = elastic.msm(a, np.full(8, n), b, np.full(8, m), c=c, gain=gain)
            assert found == pytest.approx([brute(x, y, c) for x, y in zip(a, b)])
    a[0, 2], b[1, 3], b[2, 5] = np.nan, np.inf, np.nan
    found = elastic.msm(a, np.full(8, 6), b, np.full(8, 6))
    assert np.isnan(found[[0, 2]]).all() and np.isinf(found[1]) and found[3:] == pytest.approx([brute(x, y, 1.0) for x, y in zip(a[3:], b[3:])])


def test_pairs_of_short_chunks_go_together(monkeypatch):
    rng, calls, (erp, *rest) = np.random.default_rng(8), [0], elastic.KERNELS["erp"]
    left, right = some(rng, [16] * 30 + [9, 0]), some(rng, [16] * 20 + [5])
    monkeypatch.setitem(elastic.KERNELS, "erp", (lambda *a, **o: (calls.__setitem__(0, calls[0] + 1), erp(*a, **o))[1], *rest))
    got = pairs_of("erp", left, right)
    assert calls[0] <= 2 and len(got) == len(left) * len(right)
    for (p, q), v in list(got.items())[::17]:
        assert v == elastic.distances("erp", [left[p]], [right[q]])[0]

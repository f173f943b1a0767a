"""Complex exponential smoothing (Svetunkov, Kourentzes and Ord, 2022).

A state is a complex number z, its real part the level and its imaginary part what
is known beyond it. With the error e as the other half of the observation,
``z' = a (y + i e) + (1 + i - a) z`` for a complex rate a. Seasonal forms: ``simple``
(z of one season ago), ``partial`` (z and real seasonal terms with one rate),
``full`` (z of one step and of one season ago, a rate each)."""

from __future__ import annotations

import numpy as np

from tidepanel.functions.stats import nelder_mead

FORMS = ("none", "simple", "partial", "full")
#: Where the search for rates begins, and how far the imaginary part
#: of a first state lies below its real part.
_START, _BELOW = (1.3, 1.0), 1.1


def rates_of(form: str) -> int:
    return {"none": 2, "simple": 2, "partial": 3, "full": 4}[form]


def first_states(v: np.ndarray, form: str, m: int) -> tuple[complex, np.ndarray]:
    """The state before the first value, and those (or the terms) of one season."""
    if form == "simple":
        return 0j, v[:m] * (1 + 1j / _BELOW)
    level = float(np.mean(v[: min(max(10, m), len(v))]))
    if form == "none":
        return level * (1 + 1j / _BELOW), np.zeros(0, complex)
    whole = len(v) // m * m
    phases = v[:whole].reshape(-1, m).mean(0)
    phases = phases - phases.mean()
    return level * (1 + 1j / _BELOW), phases * (1 + (1j / _BELOW if form == "full" else 0))


def run(v: np.ndarray, rates: np.ndarray, form: str, m: int, h: int) -> tuple[np.ndarray, np.ndarray]:
    """h forecasts and the one-step errors."""
    a = complex(rates[0], rates[1])
    b = complex(rates[2], rates[3]) if form == "full" else None
    z, season = first_states(v, form, m)
    season = list(season)
    errors, ahead = [], []
    for t in range(len(v) + h):
        own = season[t % m] if form != "none" else 0j
        level = own.real if form == "simple" else z.real + own.real
        y = v[t] if t < len(v) else level
        e = float(y) - level
        if t < len(v):
            errors.append(e)
        else:
            ahead.append(level)
        # With y = level + e, the recursion of a state needs its own level and e.
        if form != "simple":
            z = a * complex(z.real + e, e) + (1 + 1j - a) * z
        if form == "simple":
            season[t % m] = a * complex(own.real + e, e) + (1 + 1j - a) * own
        elif form == "partial":
            season[t % m] = own + rates[2] * e
        elif form == "full":
            season[t % m] = b * complex(own.real + e, e) + (1 + 1j - b) * own
    return np.array(ahead), np.array(errors)


def _loss(v: np.ndarray, rates: np.ndarray, form: str, m: int) -> float:
    with np.errstate(over="ignore", invalid="ignore"):
        try:
            e = run(v, rates, form, m, 0)[1]
        except OverflowError:
            return 1e300
        total = float(np.sum(e * e))
    return total if np.isfinite(total) else 1e300


def fit(v: np.ndarray, form: str, m: int, max_iter: int = 80) -> tuple[np.ndarray, float]:
    """Rates of least squared error and the corrected information criterion."""
    start = np.array({"none": _START, "simple": _START, "partial": (*_START, 0.1), "full": (*_START, *_START)}[form])
    rates, loss = nelder_mead(lambda x: _loss(v, x, form, m), start, max_iter=max_iter, step=0.1)
    n = len(v)
    k = rates_of(form) + {"none": 2, "simple": 2 * m, "partial": 2 + m, "full": 2 + 2 * m}[form] + 1
    slack = n - k - 1
    return rates, n * np.log(max(loss / n, 1e-300)) + 2 * k + (2 * k * (k + 1) / slack if slack > 0 else np.inf)


def auto(v: np.ndarray, m: int = 1, forms: tuple[str, ...] = FORMS) -> tuple[str, np.ndarray]:
    """The form with the least criterion; seasonal ones need two seasons. A series
    too short for a criterion has the form without seasons."""
    best: tuple[float, str, np.ndarray] | None = None
    for form in forms:
        if form != "none" and (m < 2 or len(v) < 2 * m):
            continue
        rates, score = fit(v, form, m)
        if best is None or score < best[0]:
            best = (score, form, rates)
    return (best[1], best[2]) if best else ("none", np.array(_START))

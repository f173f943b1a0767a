"""Queries of the decomposition by local regression, and the same in SQL."""

from __future__ import annotations

from tidepanel.functions.stl import odd_from
from tidepanel.operators import cleaning, stl
from tidepanel.plans.queries import DAILY, query, rounded
from tidepanel.sources.tables import daily_events

PERIODS = [7, 14]


def _loess(name: str, source: str, window: int, degree: int, beyond: int = 0) -> str:
    """A local regression of ``source`` (k, x, v; x from 0) at all x, and so many
    places beyond both ends, as ``name`` (k, x, v)."""
    line = f"s0 * s2 - s1 * s1 > pow(0.001 * (n - 1), 2) * s0 * s0" if degree else "false"
    return f"""{name} AS MATERIALIZED (SELECT k, p AS x, CASE WHEN {line} THEN (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) ELSE t0 / s0 END AS v FROM (
  SELECT k, p, n, sum(w) AS s0, sum(w * d) AS s1, sum(w * d * d) AS s2, sum(w * v) AS t0, sum(w * d * v) AS t1 FROM (
    SELECT k, p, n, d, v, CASE WHEN reach = 0 OR abs(d) / reach <= 0.001 THEN 1.0 WHEN abs(d) / reach <= 0.999 THEN pow(1 - pow(abs(d) / reach, 3), 3) ELSE 0.0 END AS w FROM (
      SELECT g.k, p, n, CAST(s.x - p AS DOUBLE) AS d, s.v, CAST(greatest(abs(f - p), abs(f + q - 1 - p)) + greatest(0, {window} - n) // 2 AS DOUBLE) AS reach FROM (
        SELECT k, p, n, q, least(greatest(p - (q - 1) // 2, 0), n - q) AS f FROM (
          SELECT k, n, least({window}, n) AS q, unnest(range({-beyond}, n + {beyond})) AS p FROM (SELECT k, count(*) AS n FROM {source} GROUP BY k))) g
      JOIN {source} s ON s.k = g.k AND s.x BETWEEN f AND f + q - 1)) GROUP BY k, p, n) z)"""


def _mean(name: str, source: str, size: int) -> str:
    """Means of ``size`` places, the first at x = 0."""
    w = f"OVER (PARTITION BY k ORDER BY x ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING)"
    return f"{name} AS MATERIALIZED (SELECT k, x, m AS v FROM (SELECT k, x, avg(v) {w} AS m, count(*) {w} AS c FROM {source}) z WHERE c = {size})"


def mstl_sql(source: str, periods: list[int], rounds: int = 2, inner: int = 2) -> str:
    """CTEs that end in ``mstl`` (k, x, v, trend, seasonal{p}) for ``source`` (k, x, v)."""
    steps: list[str] = []
    seasons = {p: None for p in periods}
    trend = None
    for turn in range(rounds if len(periods) > 1 else 1):
        for rank, p in enumerate(sorted(periods)):
            at = f"{turn}_{p}"
            window = 7 + 4 * (rank + 1)
            trend_window, low_window = odd_from(1.5 * p / (1 - 1.5 / window)), odd_from(p)
            others = [s for q, s in seasons.items() if s and q != p]
            joins = " ".join(f"JOIN {s} ON {s}.k = a.k AND {s}.x = a.x" for s in others)
            steps.append(f"rest_{at} AS MATERIALIZED (SELECT a.k, a.x, a.v{''.join(f' - {s}.v' for s in others)} AS v FROM {source} a {joins})")
            trend = None
            for i in range(inner):
                n = f"{at}_{i}"
                bare = f"SELECT a.k, a.x, a.v - t.v AS v FROM rest_{at} a JOIN {trend} t ON t.k = a.k AND t.x = a.x" if trend else f"SELECT k, x, v FROM rest_{at}"
                steps.append(f"phase_{n} AS MATERIALIZED (SELECT struct_pack(u := k, ph := x % {p}) AS k, x // {p} AS x, v FROM ({bare}) b)")
                steps.append(_loess(f"cycles_{n}", f"phase_{n}", window, 0, beyond=1))
                steps.append(f"cycle_{n} AS MATERIALIZED (SELECT k.u AS k, (x + 1) * {p} + k.ph AS x, v FROM cycles_{n})")
                steps.append(_mean(f"mean1_{n}", f"cycle_{n}", p))
                steps.append(_mean(f"mean2_{n}", f"mean1_{n}", p))
                steps.append(_mean(f"mean3_{n}", f"mean2_{n}", 3))
                steps.append(_loess(f"low_{n}", f"mean3_{n}", low_window, 1))
                steps.append(f"season_{n} AS MATERIALIZED (SELECT l.k, l.x, c.v - l.v AS v FROM low_{n} l JOIN cycle_{n} c ON c.k = l.k AND c.x = l.x + {p})")
                steps.append(f"plain_{n} AS MATERIALIZED (SELECT a.k, a.x, a.v - s.v AS v FROM rest_{at} a JOIN season_{n} s ON s.k = a.k AND s.x = a.x)")
                steps.append(_loess(f"trend_{n}", f"plain_{n}", trend_window, 1))
                trend = f"trend_{n}"
            seasons[p] = f"season_{at}_{inner - 1}"
    columns = ", ".join(f"{s}.v AS seasonal{p}" for p, s in seasons.items())
    joins = " ".join(f"JOIN {s} ON {s}.k = a.k AND {s}.x = a.x" for s in seasons.values())
    steps.append(f"mstl AS MATERIALIZED (SELECT a.k, a.x, a.v, t.v AS trend, {columns} FROM {source} a JOIN {trend} t ON t.k = a.k AND t.x = a.x {joins})")
    return ",\n".join(steps)


_PLACED = f"{DAILY}, placed AS (SELECT unique_id AS k, ds, row_number() OVER (PARTITION BY unique_id ORDER BY ds, y) - 1 AS x, y AS v FROM daily)"
_MSTL = f"WITH {_PLACED},\n{mstl_sql('placed', PERIODS)},\nz AS (SELECT m.*, ds, v - trend - seasonal7 - seasonal14 AS resid FROM (SELECT m.*, p.ds FROM mstl m JOIN placed p ON p.k = m.k AND p.x = m.x) m)\n"


@query("mstl_decomposition", _MSTL + "SELECT k AS unique_id, ds, " + ", ".join(f"round({c}, 4) + 0.0 AS {n}" for c, n in (("v", "y"), ("trend", "trend"), ("seasonal7", "seasonal7"), ("seasonal14", "seasonal14"), ("resid", "resid"))) + " FROM z")
def mstl_decomposition(spark, d):
    return rounded(stl.mstl_decomposition(daily_events(spark, d), PERIODS), 4)


def _strength(c: str) -> str:
    return f"round(abs(var_samp(resid) / nullif(var_samp({c} + resid), 0) - 1), 6)"


@query("mstl_features", _MSTL + f"SELECT k AS unique_id, {_strength('trend')} AS trend_strength, {_strength('seasonal7')} AS seasonal7_strength, {_strength('seasonal14')} AS seasonal14_strength, round(stddev_samp(resid) / nullif(avg(v), 0), 6) AS resid_var FROM z GROUP BY k")
def mstl_features(spark, d):
    return rounded(cleaning.seasonal_decompose_features(daily_events(spark, d), 365, PERIODS, "mstl"))

"""Queries over one long frame: lags and permutations of all its rows."""

from __future__ import annotations

from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from tidepanel.operators import bayes, changepoint, features, forecasting, metrics
from tidepanel.operators.rows import permutation_keys, permuted_sql
from tidepanel.plans.queries import DAILY, ORACLES, _wide, query, rounded
from tidepanel.sources.tables import daily_events, table

_TYPES = ("click", "error", "purchase", "signup", "view")
_WIDE_SQL = f"{DAILY}, wide AS (SELECT ds, " + ", ".join(f"coalesce(sum(y) FILTER (WHERE unique_id = '{t}'), 0.0) AS {t}" for t in _TYPES) + " FROM daily GROUP BY ds)"


def var_sql(p: int, horizon: int) -> str:
    """Moments of the lagged rows, Gauss-Jordan elimination of the normal equations,
    and the recursion of the forecast."""
    k = len(_TYPES)
    n = k * p + 1
    back = " ".join(f"JOIN l b{j} ON b{j}.i = a.i - {j}" for j in range(1, p + 1))
    lags = ", ".join(f"b{j}.y" for j in range(1, p + 1))
    latest = ", ".join(f"(SELECT y FROM l ORDER BY i DESC LIMIT 1 OFFSET {j})" for j in range(p))
    return f"""WITH RECURSIVE {_WIDE_SQL}, l AS (SELECT row_number() OVER (ORDER BY ds, {', '.join(_TYPES)}) AS i, [{', '.join(_TYPES)}] AS y FROM wide),
x AS (SELECT flatten([{lags}, [1.0]]) AS x, a.y FROM l a {back}),
cells AS (SELECT r, c, sum(x[r] * (flatten([x, y]))[c]) AS v FROM x, (SELECT unnest(range(1, {n + 1})) AS r) r, (SELECT unnest(range(1, {n + k + 1})) AS c) c GROUP BY r, c),
lines AS (SELECT r, list(v ORDER BY c) AS line FROM cells GROUP BY r),
g(k, a) AS (SELECT 1, list(line ORDER BY r) FROM lines UNION ALL
  SELECT k + 1, list_transform(a, lambda line, j: CASE WHEN j = k THEN list_transform(line, lambda v: v / line[k]) ELSE list_transform(line, lambda v, c: v - line[k] * a[k][c] / a[k][k]) END) FROM g WHERE k <= {n}),
f(step, a, seen) AS (SELECT 0, a, [{latest}] FROM g WHERE k = {n + 1} UNION ALL
  SELECT step + 1, a, list_prepend(list_transform(range(1, {k + 1}), lambda c: list_sum(list_transform(flatten([flatten(seen[1:{p}]), [1.0]]), lambda v, r: v * a[r][{n} + c]))), seen) FROM f WHERE step < {horizon})
SELECT CAST(step AS BIGINT) AS ds, {', '.join(f'round(seen[1][{j + 1}], 3) + 0.0 AS {t}' for j, t in enumerate(_TYPES))} FROM f WHERE step > 0"""


#: The query itself stands with the other forecasts.
ORACLES["var_forecast"] = var_sql(2, 5)


@query("var_lags", f"WITH {_WIDE_SQL} SELECT ds, round(click, 4) AS click, round(view, 4) AS view, " + ", ".join(f"round(lag({c}, {k}) OVER (ORDER BY ds, click, view), 4) AS {c}_{k}" for k in (1, 2) for c in ("click", "view")) + " FROM wide")
def var_lags(spark, d):
    """The lags that a VAR is fitted on, looked up in chunks of seven rows."""
    rows = changepoint._lagged(_wide(spark, d), ["click", "view"], 2, "ds", chunk=7)
    return rounded(rows.select("ds", "click", "view", *[F.col(f"__{c}_{k}").alias(f"{c}_{k}") for k in (1, 2) for c in ("click", "view")]), 4)


class Line:
    """A linear model with given coefficients."""

    coefficients = np.array([1500.0, -20_000.0, 5_000.0])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return x @ self.coefficients


_FEATURES, _REPEATS, _SEED = ("l_quantity", "l_discount", "l_tax"), 2, 42
_SLOTS = [(f, r) for f in _FEATURES for r in range(_REPEATS)]


def _line(**changed: str) -> str:
    return " + ".join(f"{b} * {changed.get(f, f'a.{f}')}" for f, b in zip(_FEATURES, Line.coefficients))


_ORDER = ["l_orderkey", "l_linenumber", "l_extendedprice", *_FEATURES]
_ITEMS = f"items AS (SELECT row_number() OVER (ORDER BY {', '.join(_ORDER)}) - 1 AS i, count(*) OVER () AS n, l_extendedprice AS y, CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_discount AS DOUBLE) AS l_discount, CAST(l_tax AS DOUBLE) AS l_tax FROM lineitem)"
_SENT = ", ".join(f"s{s} AS (SELECT {permuted_sql('i', 'n', permutation_keys(_SEED, s))} AS i, {f} AS v FROM items)" for s, (f, _) in enumerate(_SLOTS))
_ERRORS = ", ".join(f"avg(abs(y - ({_line(**{f: f's{s}.v'})}))) AS e{s}" for s, (f, _) in enumerate(_SLOTS))
_BRED = " UNION ALL ".join(f"SELECT '{f}' AS feature, unnest([{', '.join(f'e{s} - e' for s, (g, _) in enumerate(_SLOTS) if g == f)}]) AS gain FROM e" for f in _FEATURES)


@query("permutation_importance", f"WITH {_ITEMS}, {_SENT}, e AS (SELECT avg(abs(y - ({_line()}))) AS e, {_ERRORS} FROM items a {' '.join(f'JOIN s{s} ON s{s}.i = a.i' for s in range(len(_SLOTS)))}) SELECT feature, round(avg(gain), 4) AS importance_mean, round(stddev_pop(gain), 4) AS importance_std FROM ({_BRED}) z GROUP BY feature")
def importance(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", *_FEATURES)
    return rounded(metrics.permutation_importance(items, Line(), list(_FEATURES), "l_extendedprice", n_repeats=_REPEATS, seed=_SEED, order=_ORDER), 4)


@query("ces_forecast", f"""WITH RECURSIVE {DAILY}, o AS (SELECT unique_id AS u, ds, y, row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS i FROM daily),
n AS (SELECT u, count(*) AS n, max(ds) AS last, avg(y) FILTER (WHERE i <= 10) AS l FROM o GROUP BY u),
z(u, i, l, c) AS (SELECT u, CAST(1 AS BIGINT), l, l / 1.1 FROM n UNION ALL
  SELECT u, i + 1, l - 0.25 * c + 0.35 * e, l - 0.1 * c + 1.85 * e FROM (SELECT z.*, CASE WHEN z.i <= n.n THEN o.y - l ELSE 0.0 END AS e FROM (SELECT u, i, l, c FROM z) z JOIN (SELECT u, n FROM n) n ON n.u = z.u LEFT JOIN o ON o.u = z.u AND o.i = z.i WHERE z.i < n.n + 7) s)
SELECT z.u AS unique_id, last + CAST(z.i - n AS INTEGER) * INTERVAL 1 DAY AS ds, round(z.l, 4) AS y_hat FROM z JOIN n ON n.u = z.u WHERE z.i > n""")
def ces_forecast(spark, d):
    return rounded(forecasting.ces_forecast(daily_events(spark, d), 7, form="none", rates=(1.1, 0.75)), 4)


_EASTER = """y AS (SELECT DISTINCT year(ts) AS y FROM events), a AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y),
h AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM a), l AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM h),
m AS (SELECT *, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 AS m FROM l), e AS (SELECT y, make_date(y, m // 31, m % 31 + 1) AS e FROM m)"""


@query("country_holidays", f"""WITH {_EASTER}, d AS (SELECT e + n AS d FROM e, (VALUES (-2), (1), (39), (50)) v(n) UNION SELECT make_date(y, v.m, v.n) FROM y, (VALUES (1, 1), (5, 1), (10, 3), (12, 25), (12, 26)) v(m, n) UNION SELECT make_date(2017, 10, 31) FROM y WHERE y = 2017)
SELECT event_id, CAST(CAST(ts AS DATE) IN (SELECT d FROM d) AS BIGINT) AS is_holiday, coalesce((SELECT min(date_diff('day', CAST(ts AS DATE), d)) FROM d WHERE d >= CAST(ts AS DATE)), 365) AS days_to_holiday,
  coalesce((SELECT min(date_diff('day', d, CAST(ts AS DATE))) FROM d WHERE d <= CAST(ts AS DATE)), 365) AS days_since_holiday FROM events""")
def country_holidays(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("ts").alias("ds"))
    return rounded(features.holiday_features(e, "DE", distance=True).drop("ds"))


@query("synthetic_two_donors", """WITH e AS (SELECT event_type AS u, date_trunc('day', ts)::TIMESTAMP AS ds, sum(value) AS y, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2),
r AS (SELECT t.ds, t.ds < TIMESTAMP '2024-01-21' AS pre, t.y, t.n, a.y AS ay, a.n AS an, b.y AS cy, b.n AS cn FROM e t JOIN e a ON a.ds = t.ds AND a.u = 'error' JOIN e b ON b.ds = t.ds AND b.u = 'view' WHERE t.u = 'click'),
k AS (SELECT (stddev_pop(y) / stddev_pop(n)) ^ 2 AS k FROM r WHERE pre),
w AS (SELECT greatest(0, least(1, sum((y - cy) * (ay - cy) + k * (n - cn) * (an - cn)) / sum((ay - cy) ^ 2 + k * (an - cn) ^ 2))) AS w FROM r, k WHERE pre),
s AS (SELECT stddev_samp(y - w * ay - (1 - w) * cy) AS s FROM r, w WHERE pre)
SELECT ds, round(y, 3) AS y, round(w * ay + (1 - w) * cy + n - w * an - (1 - w) * cn, 2) AS counterfactual, round(y - w * ay - (1 - w) * cy - n + w * an + (1 - w) * cn, 2) AS point_effect FROM r, w, s WHERE NOT pre""")
def synthetic_two_donors(spark, d):
    """Clicks against two donors, their daily counts matched too and carried on."""
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("unique_id"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ds")).agg(F.sum("value").alias("y"), F.count("*").alias("n"))
    found = bayes.SyntheticControl(covariates=["n"], covariate_role={"n": "always"}).fit(e, "click", datetime(2024, 1, 21), ["error", "view"]).to_frame()
    return found.select("ds", F.round("y", 3).alias("y"), F.round("counterfactual", 2).alias("counterfactual"), F.round("point_effect", 2).alias("point_effect"))

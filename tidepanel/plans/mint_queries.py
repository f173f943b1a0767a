"""Minimum-trace reconciliation of the nations' orders, and the same in SQL with an
elimination of the constraints' equations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.operators import reconcile
from tidepanel.operators.mint import RIDGE, SHRINK
from tidepanel.plans.queries import _NAT, _hierarchy, _incoherent, query, rounded
from tidepanel.sources.tables import nation_orders

_FOLDS = 4


def _sql(residuals: str) -> str:
    """``residuals``: e (j, t, e) from y (j, t, y: 0 where missing), n times."""
    return f"""WITH RECURSIVE {_NAT}, kin AS (SELECT DISTINCT n_name AS child, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT DISTINCT r_name, 'Total' FROM nation JOIN region ON n_regionkey = r_regionkey),
nodes AS (SELECT child AS j FROM kin UNION SELECT parent FROM kin), tops AS (SELECT parent AS a, row_number() OVER (ORDER BY parent) AS r, count(*) OVER () AS m FROM (SELECT DISTINCT parent FROM kin)),
actual AS (SELECT coalesce(n_name, r_name, 'Total') AS j, ds, sum(y) AS y FROM nat GROUP BY GROUPING SETS ((n_name, ds), (r_name, ds), (ds))),
times AS (SELECT ds, row_number() OVER (ORDER BY ds) AS t, count(*) OVER () AS n FROM (SELECT DISTINCT ds FROM actual)),
y AS (SELECT j, t, n, coalesce(y, 0) AS y, y AS seen FROM nodes CROSS JOIN times LEFT JOIN actual USING (j, ds)),
f AS (SELECT j, t AS k, y * CASE WHEN j IN (SELECT a FROM tops) THEN 1.1 ELSE 1 END AS y FROM y),
{residuals},
d AS (SELECT j, {SHRINK} * sum(e * e) + {RIDGE} AS d FROM e GROUP BY j), c AS (SELECT a, r, a AS j, 1.0 AS c FROM tops UNION ALL SELECT a, r, child, -1.0 FROM tops JOIN kin ON parent = a),
g AS (SELECT r, t, sum(c * e) AS g FROM c JOIN e USING (j) GROUP BY r, t),
cells AS (SELECT r, q, sum(v) AS v FROM (SELECT a.r, b.r AS q, {1 - SHRINK} * sum(a.g * b.g) AS v FROM g a JOIN g b USING (t) GROUP BY 1, 2 UNION ALL SELECT a.r, b.r, sum(a.c * b.c * d) FROM c a JOIN c b USING (j) JOIN d USING (j) GROUP BY 1, 2
  UNION ALL SELECT r, (SELECT max(m) FROM tops) + k, sum(c * f.y) FROM c JOIN f USING (j) GROUP BY 1, 2) z GROUP BY r, q),
lines AS (SELECT r, list(v ORDER BY q) AS line FROM cells GROUP BY r),
s(p, a) AS (SELECT 1, list(line ORDER BY r) FROM lines UNION ALL
  SELECT p + 1, list_transform(a, lambda line, i: CASE WHEN i = p THEN list_transform(line, lambda v: v / line[p]) ELSE list_transform(line, lambda v, q: v - line[p] * a[p][q] / a[p][p]) END) FROM s WHERE p <= len(a)),
u AS (SELECT j, k, sum(c * s.a[r][m + k]) AS u FROM c JOIN tops USING (a, r) JOIN (SELECT a FROM s WHERE p = len(a) + 1) s ON true, (SELECT t AS k FROM times) k GROUP BY j, k),
x AS (SELECT t, k, sum(e * u) AS x FROM e JOIN u USING (j) GROUP BY t, k),
w AS (SELECT u.j, u.k, d * u + {1 - SHRINK} * v AS w FROM u JOIN d USING (j) JOIN (SELECT j, k, sum(e * x) AS v FROM e JOIN x USING (t) GROUP BY j, k) v ON v.j = u.j AND v.k = u.k),
leaf AS (SELECT n.n_name, n.r_name, times.ds, f.y - w AS y FROM (SELECT DISTINCT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) n JOIN f ON f.j = n.n_name JOIN w ON w.j = f.j AND w.k = f.k JOIN times ON times.t = f.k)
SELECT coalesce(n_name, r_name, 'Total') AS unique_id, ds, round(sum(y), 0) + 0.0 AS y_hat FROM leaf GROUP BY GROUPING SETS ((n_name, ds), (r_name, ds), (ds))"""


def _nodes(spark, d):
    return reconcile.bottom_up(nation_orders(spark, d), _hierarchy(spark, d), ["y_hat"])


@query("reconcile_permbu", _sql("e AS (SELECT j, t, coalesce(seen - avg(seen) OVER (PARTITION BY j), 0) / sqrt(n) AS e FROM y)"))
def reconcile_permbu(spark, d):
    """Residuals: the deviations of every node from its mean."""
    rows = _nodes(spark, d).select("unique_id", "ds", (F.col("y_hat") - F.avg("y_hat").over(Window.partitionBy("unique_id"))).alias("residual"))
    return rounded(reconcile.reconcile(_incoherent(spark, d), _hierarchy(spark, d), "permbu", residuals=rows), 0)


@query("reconcile_mint_cv", _sql(f"""p AS (SELECT *, least((t - 1) // (n // {_FOLDS}), {_FOLDS - 1}) AS fold FROM y), h AS (SELECT *, count(*) OVER own AS size, (sum(y) OVER (PARTITION BY j) - sum(y) OVER own) / (n - count(*) OVER own) AS other FROM p WINDOW own AS (PARTITION BY j, fold)),
e AS (SELECT j, t, (y - other) / sqrt(size * {_FOLDS}.0) AS e FROM h)"""))
def reconcile_mint_cv(spark, d):
    train = _nodes(spark, d).withColumnRenamed("y_hat", "y")
    return rounded(reconcile.reconcile(_incoherent(spark, d), _hierarchy(spark, d), "mint_cv", train_data=train, n_folds=_FOLDS), 0)

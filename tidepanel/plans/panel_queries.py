"""More queries over whole panels, and the same in SQL.

The dynamic programs of the distances are recursive queries there: one step a cell,
in row order, over all pairs of the daily panel at once.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators import bayes, cleaning, forecasting, imaging, metrics, reconcile, similarity, validation
from tidepanel.plans.queries import _FOLDS, _H, _NAT, DAILY, USERS, Naive, W, _cells, _hierarchy, _incoherent, query, rounded
from tidepanel.sources.tables import daily_events, table, user_events

# -- distances over the daily panel ----------------------------------------

_TWO = "two AS (SELECT event_type AS unique_id, date_trunc('day', ts)::TIMESTAMP AS ds, sum(value) AS y, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2)"
_SERIES = f"{_TWO}, s AS (SELECT unique_id, list(y ORDER BY ds) AS v, list(n ORDER BY ds) AS c FROM two GROUP BY 1)"
_SLOPES = f"{_TWO}, t AS (SELECT unique_id, list(y ORDER BY ds) AS v FROM two GROUP BY 1), s AS (SELECT unique_id, [(v[q] - v[q - 1] + (v[q + 1] - v[q - 1]) / 2) / 2 for q in [greatest(2, least(len(v) - 1, i)) for i in range(1, len(v) + 1)]] AS v, v AS c FROM t)"
_INF = "'inf'::DOUBLE"


def _program(step: str, top: str = "CASE WHEN {q} = 0 THEN 0 ELSE 'inf'::DOUBLE END", left: str | None = None, series: str = _SERIES, pairs: str = "x.unique_id < z.unique_id") -> str:
    """CTEs up to ``dp`` (id_1, id_2, d, n, m): ``step`` fills a cell from its values x
    and y and the cells g (diagonal), u (above) and l (left); ``top`` and ``left`` give
    the cells before the first row and column at distance q. Only the last row is kept."""
    left = left or top
    at = lambda side, q: f"({side.format(q=q)})"
    return f"""WITH RECURSIVE {series}, p AS (SELECT x.unique_id AS id_1, z.unique_id AS id_2, x.v AS a, z.v AS b, x.c AS a2, z.c AS b2, len(x.v) AS n, len(z.v) AS m FROM s x JOIN s z ON {pairs}),
r AS (SELECT id_1, id_2, 0::BIGINT AS k, []::DOUBLE[] AS row FROM p
UNION ALL SELECT id_1, id_2, k + 1, list_append(row[-m:], ({step})::DOUBLE) FROM (
SELECT *, CASE WHEN i > 0 AND j > 0 THEN row[-m - 1] WHEN i = 0 THEN {at(top, 'j')} ELSE {at(left, 'i')} END AS g, CASE WHEN i > 0 THEN row[-m] ELSE {at(top, '(j + 1)')} END AS u, CASE WHEN j > 0 THEN row[-1] ELSE {at(left, '(i + 1)')} END AS l, a[i + 1] AS x, b[j + 1] AS y, a[i] AS xp, b[j] AS yp, a2[i + 1] AS x2, b2[j + 1] AS y2, a2[i] AS xp2, b2[j] AS yp2
FROM (SELECT r.*, p.* EXCLUDE (id_1, id_2), k // m AS i, k % m AS j FROM r JOIN p USING (id_1, id_2) WHERE k < n * m))),
dp AS (SELECT id_1, id_2, row[-1] AS d, n, m FROM r JOIN p USING (id_1, id_2) WHERE k = n * m)"""


def _split(new: str, before: str, other: str) -> str:
    return f"CASE WHEN ({before} <= {new} AND {new} <= {other}) OR ({before} >= {new} AND {new} >= {other}) THEN 1 ELSE 1 + least(abs({new} - {before}), abs({new} - {other})) END"


def _square(p: tuple[str, str], q: tuple[str, str]) -> str:
    return f"(({p[0]} - {q[0]}) ^ 2 + ({p[1]} - {q[1]}) ^ 2)"


def _split_points(new: tuple[str, str], before: tuple[str, str], other: tuple[str, str]) -> str:
    middle = tuple(f"(({b} + {o}) / 2)" for b, o in zip(before, other))
    return f"CASE WHEN {_square(middle, new)} <= {_square(before, other)} / 2 THEN 1 ELSE 1 + least({_square(new, before)}, {_square(new, other)}) END"


def _edit(move: str, up: str, left: str) -> str:
    return f"CASE WHEN i = 0 AND j = 0 THEN {move} WHEN i = 0 THEN l + {left} WHEN j = 0 THEN u + {up} ELSE least(g + {move}, u + {up}, l + {left}) END"


_NEAR = "least(g, u, l)"
_DTW = f"abs(x - y) + {_NEAR}"
_X, _Y, _XP, _YP = ("x", "x2"), ("y", "y2"), ("xp", "xp2"), ("yp", "yp2")
_PROGRAMS = {
    "dtw": ({}, _program(_DTW), "d"),
    "sakoe_chiba": ({"window": 3}, _program(f"CASE WHEN abs(i - j) <= greatest(3, abs(n - m)) THEN {_DTW} ELSE {_INF} END"), "d"),
    "itakura": ({}, _program(f"CASE WHEN j <= 2 * i AND j >= i / 2 AND m - 1 - j <= 2 * (n - 1 - i) AND m - 1 - j >= (n - 1 - i) / 2 THEN {_DTW} ELSE {_INF} END"), "d"),
    "ddtw": ({}, _program(_DTW, series=_SLOPES), "d"),
    "wdtw": ({}, _program(f"(x - y) ^ 2 / (1 + exp(-0.05 * (abs(i - j) - greatest(n, m) / 2))) + {_NEAR}"), "d"),
    "msm": ({}, _program(_edit("abs(x - y)", f"({_split('x', 'xp', 'y')})", f"({_split('y', 'x', 'yp')})")), "d"),
    "erp": ({}, _program("least(g + abs(x - y), u + abs(x), l + abs(y))", "coalesce(list_sum([abs(w) for w in b[1:{q}]]), 0)", "coalesce(list_sum([abs(w) for w in a[1:{q}]]), 0)"), "d"),
    "lcss": ({"epsilon": 40.0}, _program("CASE WHEN abs(x - y) <= 40 THEN g - 1 ELSE least(u, l) END", "0::DOUBLE"), "1 + d / least(n, m)"),
    "edr": ({"epsilon": 40.0}, _program("least(g + (abs(x - y) > 40)::INT, u + 1, l + 1)", "{q}::DOUBLE"), "d / greatest(n, m)"),
    "twe": ({}, _program("least(g + abs(x - y) + abs(coalesce(xp, 0) - coalesce(yp, 0)) + 0.001 * least(abs(i - j), 0.002), u + abs(x - coalesce(xp, 0)) + 1.001, l + abs(y - coalesce(yp, 0)) + 1.001)"), "d"),
    "frechet": ({}, _program(f"greatest(abs(x - y), {_NEAR})"), "d"),
    "dtw_multi": ({}, _program(f"abs(x - y) + abs(x2 - y2) + {_NEAR}"), "d"),
    "msm_multi": ({}, _program(_edit(_square(_X, _Y), f"({_split_points(_X, _XP, _Y)})", f"({_split_points(_Y, _X, _YP)})")), "d"),
}


def two_channels(spark, d):
    """Daily sums and counts of events."""
    e = table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("unique_id"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ds")).agg(F.sum("value").alias("y"), F.count("*").cast("double").alias("n"))


def _panel_distance(method: str, options: dict):
    def run(spark, d):
        rows = two_channels(spark, d)
        return rounded(similarity.compute_pairwise_distance(rows, None, method, **options), 4)

    return run


for _m, (_o, _cte, _value) in _PROGRAMS.items():
    query(f"panel_{_m}", f"{_cte} SELECT id_1, id_2, round({_value}, 4) + 0.0 AS {_m} FROM dp")(_panel_distance(_m, _o))


@query("panel_dtw_multi_euclidean", f"{_program('sqrt((x - y) ^ 2 + (x2 - y2) ^ 2) + ' + _NEAR)} SELECT id_1, id_2, round(d, 4) AS dtw_multi FROM dp")
def panel_dtw_euclidean(spark, d):
    return rounded(similarity.compute_pairwise_distance(two_channels(spark, d), None, "dtw_multi", metric="euclidean"), 4)


@query("panel_sbd", f"WITH {DAILY}, n AS (SELECT *, row_number() OVER ({W}) AS i, sqrt(sum(y * y) OVER (PARTITION BY unique_id)) AS norm FROM daily), c AS (SELECT a.unique_id AS id_1, b.unique_id AS id_2, sum(a.y * b.y) / max(a.norm * b.norm) AS c FROM n a JOIN n b ON a.unique_id < b.unique_id GROUP BY 1, 2, a.i - b.i) SELECT id_1, id_2, round(1 - max(c), 6) + 0.0 AS sbd FROM c GROUP BY 1, 2")
def panel_sbd(spark, d):
    return rounded(similarity.compute_pairwise_distance(daily_events(spark, d), None, "sbd"))


@query("two_panels_dtw", _program(_DTW, series=_SERIES.replace(", s AS", ", o AS") + ", s AS (SELECT unique_id, v, c FROM o UNION ALL SELECT 'n_' || unique_id, c, v FROM o)", pairs="x.unique_id NOT LIKE 'n#_%' ESCAPE '#' AND z.unique_id LIKE 'n#_%' ESCAPE '#'") + " SELECT id_1, id_2, round(d, 4) AS dtw FROM dp")
def two_panels_dtw(spark, d):
    both = two_channels(spark, d)
    counts = both.select(F.concat(F.lit("n_"), "unique_id").alias("unique_id"), "ds", F.col("n").alias("y"))
    return rounded(similarity.compute_distances(both.select("unique_id", "ds", "y"), counts), 4)


# -- neighbours and scores over DTW ----------------------------------------

#: A fixed grouping of the daily series, by the length of their names.
_GROUP = "length({}) % 2"
_BOTH = f"{_program(_DTW)}, e AS (SELECT id_1, id_2, d FROM dp UNION ALL SELECT id_2, id_1, d FROM dp), g AS (SELECT unique_id, {_GROUP.format('unique_id')} AS c FROM s)"
_MEDOIDS = "w AS (SELECT g.unique_id, g.c, coalesce(sum(d), 0) AS s, coalesce(sum(d * d), 0) AS s2 FROM g LEFT JOIN (SELECT e.*, h.c AS c2 FROM e JOIN g h ON h.unique_id = id_2) e ON e.id_1 = g.unique_id AND e.c2 = g.c GROUP BY 1, 2), m AS (SELECT c, arg_min(unique_id, (s, unique_id)) AS medoid, count(*) AS n, arg_min(s, (s, unique_id)) / count(*) AS scatter, arg_min(s2, (s, unique_id)) AS inside FROM w GROUP BY 1)"


def _groups(spark, d):
    return daily_events(spark, d).select("unique_id").distinct().withColumn("cluster", (F.length("unique_id") % 2).cast("long"))


@query("symmetric_pairs", f"{_BOTH} SELECT id_1, id_2, round(d, 4) AS d FROM e")
def symmetric_pairs(spark, d):
    return rounded(similarity.symmetric(similarity.compute_pairwise_distance(daily_events(spark, d))), 4)


@query("silhouette_score", f"{_BOTH}, q AS (SELECT id_1, a.c AS c1, b.c AS c2, avg(d) AS v FROM e JOIN g a ON a.unique_id = id_1 JOIN g b ON b.unique_id = id_2 GROUP BY 1, 2, 3), z AS (SELECT id_1, coalesce(max(v) FILTER (WHERE c1 = c2), 0) AS a, min(v) FILTER (WHERE c1 <> c2) AS b FROM q GROUP BY 1) SELECT round(avg(CASE WHEN b IS NULL THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END), 6) + 0.0 AS silhouette FROM z")
def silhouette_score(spark, d):
    return rounded(similarity.silhouette_score(daily_events(spark, d), _groups(spark, d)))


@query("davies_bouldin", f"{_BOTH}, {_MEDOIDS}, q AS (SELECT x.c, max((x.scatter + y.scatter) / d) AS r FROM m x JOIN m y ON x.c <> y.c JOIN e ON id_1 = x.medoid AND id_2 = y.medoid GROUP BY 1) SELECT round(avg(r), 6) AS davies_bouldin FROM q")
def davies_bouldin(spark, d):
    return rounded(similarity.davies_bouldin_score(daily_events(spark, d), _groups(spark, d)))


@query("calinski_harabasz", f"{_BOTH}, {_MEDOIDS}, o AS (SELECT arg_min(id_1, (s, id_1)) AS centre FROM (SELECT id_1, sum(d) AS s FROM e GROUP BY 1)), b AS (SELECT coalesce(sum(n * d * d), 0) AS b FROM m JOIN e ON id_1 = medoid JOIN o ON id_2 = centre) SELECT round(max(b) * (sum(n) - count(*)) / (sum(inside) * (count(*) - 1)), 6) AS calinski_harabasz FROM m, b")
def calinski_harabasz(spark, d):
    return rounded(similarity.calinski_harabasz_score(daily_events(spark, d), _groups(spark, d)))


@query("knn_classify", f"{_program(_DTW, pairs='TRUE')}, k AS (SELECT id_1, id_2, row_number() OVER (PARTITION BY id_1 ORDER BY d, id_2) AS rank FROM dp), v AS (SELECT id_1, {_GROUP.format('id_2')} AS label, count(*) AS n, min(rank) AS f FROM k WHERE rank <= 3 GROUP BY 1, 2) SELECT id_1 AS unique_id, arg_min(label, (-n, f)) AS predicted_label FROM v GROUP BY 1")
def knn_classify(spark, d):
    daily = daily_events(spark, d)
    train = daily.withColumn("label", (F.length("unique_id") % 2).cast("long"))
    return similarity.TimeSeriesKNNClassifier(3).fit(train).predict(daily)


# -- validation ------------------------------------------------------------

_NAIVE_FOLDS = f"{_FOLDS}, c AS (SELECT fold, 15 + fold * 2 AS b FROM k), l AS (SELECT fold, unique_id, arg_max(y, ds) AS y_hat FROM daily JOIN t USING (ds), c WHERE i < b GROUP BY 1, 2), j AS (SELECT c.fold, daily.unique_id, i - b + 1 AS horizon_step, y, y_hat FROM daily JOIN t USING (ds), c JOIN l ON l.fold = c.fold WHERE l.unique_id = daily.unique_id AND i >= b AND i < b + 3)"


def _origins(daily):
    return validation.rolling_origin_cv(daily, 3, 15, 3, 2)


@query("rolling_origin_cv", f"WITH {DAILY}, {_FOLDS}, e AS (SELECT ds, fold, i, 15 + fold * 2 AS b FROM t, k) SELECT unique_id, ds, round(y, 6) AS y, fold, CASE WHEN i < b THEN 'train' ELSE 'test' END AS role FROM daily JOIN e USING (ds) WHERE i < b + 3")
def rolling_origin(spark, d):
    out = None
    for k, (train, test) in enumerate(_origins(daily_events(spark, d))):
        for rows, role in ((train, "train"), (test, "test")):
            part = rows.withColumn("fold", F.lit(k)).withColumn("role", F.lit(role))
            out = part if out is None else out.unionByName(part)
    return rounded(out)


@query("horizon_scores", f"WITH {DAILY}, {_NAIVE_FOLDS} SELECT fold, 'mae' AS metric, horizon_step, round(avg(abs(y - y_hat)), 6) AS score FROM j GROUP BY ALL")
def horizon_scores(spark, d):
    got = validation.backtest(Naive(), _origins(daily_events(spark, d)), {"mae": metrics.mae}, per_horizon=True)
    return rounded(got["horizon_scores"])


class Average(Naive):
    """The mean of the last three values as a model."""

    def predict(self, df, h):
        return forecasting.moving_average_forecast(df, h, 3)


@query("compare_models", f"WITH {DAILY}, {_NAIVE_FOLDS}, a AS (SELECT fold, unique_id, list_avg(list(y ORDER BY ds)[-3:]) AS w FROM daily JOIN t USING (ds), c WHERE i < b GROUP BY 1, 2), u AS (SELECT fold, 'naive' AS model, avg(abs(y - y_hat)) AS s FROM j GROUP BY 1 UNION ALL SELECT fold, 'mean', avg(abs(y - w)) FROM j JOIN a USING (fold, unique_id) GROUP BY 1) SELECT model, 'mae' AS metric, round(avg(s), 6) AS mean, round(stddev_samp(s), 6) AS std FROM u GROUP BY 1")
def compare_models(spark, d):
    cv = lambda df: _origins(df)
    return rounded(validation.compare_models({"naive": Naive(), "mean": Average()}, daily_events(spark, d), cv, {}, {"mae": metrics.mae})["comparison"])


@query("kaboudan_backtest", f"WITH {DAILY}, n AS (SELECT unique_id, y, row_number() OVER ({W}) AS t, (SELECT count(DISTINCT ds) FROM daily) AS n FROM daily), k AS (SELECT unnest(range(5)) AS k), b AS (SELECT unique_id, y, t, n // 2 + k * greatest(1, (n - n // 2) // 5) AS e, greatest(1, (n - n // 2) // 5) AS h, k FROM n, k), l AS (SELECT unique_id, k, y AS y_hat FROM b WHERE t = e) SELECT b.unique_id, round(sum((y - y_hat) ^ 2), 3) AS sse FROM b JOIN l USING (unique_id, k) WHERE t > e AND t <= e + h GROUP BY 1")
def kaboudan_backtest(spark, d):
    return rounded(metrics.Kaboudan(forecasting.naive_forecast).backtest(daily_events(spark, d)), 3)


# -- diagnostics, filling, forecasts, reconciliation -----------------------

_ACF = f"{DAILY}, n AS (SELECT unique_id, row_number() OVER ({W}) AS i, y - avg(y) OVER (PARTITION BY unique_id) AS v, count(*) OVER (PARTITION BY unique_id) AS n FROM daily), z AS (SELECT unique_id, sum(v * v) AS s, max(n) AS n FROM n GROUP BY 1), r AS (SELECT a.unique_id, a.i - b.i AS lag, sum(a.v * b.v) / max(s) AS r, max(z.n) AS n FROM n a JOIN n b ON a.unique_id = b.unique_id AND a.i >= b.i JOIN z ON z.unique_id = a.unique_id GROUP BY 1, 2)"


@query("pacf", f"""WITH RECURSIVE {_ACF}, q AS (SELECT unique_id, list(r ORDER BY lag) AS r, max(n) AS n FROM r GROUP BY 1),
f AS (SELECT unique_id, 0 AS k, []::DOUBLE[] AS phi, 1::DOUBLE AS pacf FROM q UNION ALL
SELECT unique_id, k + 1, list_append([phi[j] - last * phi[k + 1 - j] for j in range(1, k + 1)], last), last FROM (SELECT f.*, (q.r[k + 2] - coalesce(list_sum([phi[j] * q.r[k + 2 - j] for j in range(1, k + 1)]), 0)) / (1 - coalesce(list_sum([phi[j] * q.r[j + 1] for j in range(1, k + 1)]), 0)) AS last FROM f JOIN q USING (unique_id) WHERE k < 7))
SELECT unique_id, k::BIGINT AS lag, round(pacf, 6) + 0.0 AS pacf, round(-1.96 / sqrt(n), 6) AS lower, round(1.96 / sqrt(n), 6) AS upper FROM f JOIN q USING (unique_id)""")
def pacf(spark, d):
    return rounded(metrics.pacf(daily_events(spark, d), max_lags=7))


@query("ljung_box_even", f"WITH {_ACF}, k AS (SELECT unnest([4, 10]) AS k), q AS (SELECT unique_id, k, max(n) * (max(n) + 2) * sum(r * r / (n - lag)) AS q FROM r, k WHERE lag BETWEEN 1 AND k GROUP BY 1, 2) SELECT unique_id, k::BIGINT AS lag, round(q, 6) AS statistic, round(exp(-q / 2) * list_sum([(q / 2) ^ i / gamma(i + 1) for i in range(k // 2)]), 6) AS p_value FROM q")
def ljung_box_even(spark, d):
    """Lags whose chi-squared tail is a finite sum, so that SQL has it too."""
    return rounded(metrics.ljung_box(daily_events(spark, d), lags=[4, 10]))


@query("impute_seasonal", f"WITH {USERS}, c AS (SELECT unique_id, ds, y, last_value(y IGNORE NULLS) OVER (PARTITION BY unique_id, ds % 7 ORDER BY ds) AS b, first_value(y IGNORE NULLS) OVER (PARTITION BY unique_id, ds % 7 ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM users) SELECT unique_id, ds, round(coalesce(y, b, a), 6) + 0.0 AS y, y IS NULL AS y_imputed FROM c")
def impute_seasonal(spark, d):
    return rounded(cleaning.impute(user_events(spark, d).drop("value"), method="seasonal", season_length=7, add_indicator=True))


@query("fft_forecast", f"WITH {DAILY}, {_H}, n AS (SELECT unique_id, y, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY unique_id) AS n FROM daily), z AS (SELECT unique_id, f, max(n) AS n, sum(y * cos(2 * pi() * f * i / n)) AS re, -sum(y * sin(2 * pi() * f * i / n)) AS im FROM n, (SELECT unnest(range(1, 1000)) AS f) WHERE f <= n // 2 GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY re * re + im * im DESC) AS rank FROM z), w AS (SELECT unique_id, h.k, sum(2 * sqrt(re * re + im * im) / n * cos(2 * pi() * f / n * (n + h.k - 1) + atan2(im, re))) AS w FROM o, h WHERE rank <= 5 GROUP BY 1, 2) SELECT unique_id, (last + k * INTERVAL 1 DAY)::TIMESTAMP AS ds, round(list_avg(s) + w, 4) + 0.0 AS y_hat FROM w JOIN l USING (unique_id)")
def fft_forecast(spark, d):
    return rounded(forecasting.fft_forecast(daily_events(spark, d), 14), 4)


@query("reconcile_ols", f"""WITH {_NAT}, leaf AS (SELECT DISTINCT n_name, r_name, count(*) OVER (PARTITION BY r_name) AS m FROM nation JOIN region ON n_regionkey = r_regionkey), days AS (SELECT DISTINCT ds FROM nat),
z AS (SELECT n_name, r_name, m, ds, coalesce(y, 0) + 1.1 * coalesce(sum(y) OVER (PARTITION BY r_name, ds), 0) + 1.1 * sum(y) OVER (PARTITION BY ds) AS z FROM leaf CROSS JOIN days LEFT JOIN nat USING (n_name, r_name, ds)),
a AS (SELECT *, z - sum(z) OVER (PARTITION BY r_name, ds) / (1 + m) AS az, 1 / (1 + m) AS a1 FROM z),
b AS (SELECT *, az - a1 * sum(az) OVER p / (1 + sum(a1) OVER p) AS beta FROM a WINDOW p AS (PARTITION BY ds))
SELECT coalesce(n_name, r_name, 'Total') AS unique_id, ds, round(sum(beta), 0) + 0.0 AS y_hat FROM b GROUP BY GROUPING SETS ((n_name, ds), (r_name, ds), (ds))""")
def reconcile_ols(spark, d):
    """In SQL by the inverse of identity + ones within regions + ones (Woodbury)."""
    return rounded(reconcile.reconcile(_incoherent(spark, d), _hierarchy(spark, d), "ols"), 0)


@query("kalman_filter", f"""WITH RECURSIVE {DAILY}, n AS (SELECT unique_id, ds, y, row_number() OVER ({W}) AS i, count(*) OVER (PARTITION BY unique_id) AS n FROM daily),
f AS (SELECT unique_id, 0::BIGINT AS i, 0::DOUBLE AS xp, 0::DOUBLE AS pp, 0::DOUBLE AS x, 1e6::DOUBLE AS p, 0::DOUBLE AS ll FROM n WHERE i = 1
UNION ALL SELECT unique_id, i, x, pp, x + pp / (pp + 1) * (y - x), (1 - pp / (pp + 1)) ^ 2 * pp + (pp / (pp + 1)) ^ 2, ll - 0.5 * (ln(2 * pi()) + ln(pp + 1) + (y - x) ^ 2 / (pp + 1)) FROM (SELECT f.unique_id, n.i, f.x, f.p + 1 AS pp, f.ll, n.y FROM f JOIN n ON n.unique_id = f.unique_id AND n.i = f.i + 1)),
b AS (SELECT f.unique_id, f.i, x AS xs, p AS ps FROM f JOIN n ON n.unique_id = f.unique_id AND f.i = n.n AND n.i = n.n
UNION ALL SELECT b.unique_id, f.i, f.x + f.p / q.pp * (xs - q.xp), f.p + (f.p / q.pp) ^ 2 * (ps - q.pp) FROM b JOIN f ON f.unique_id = b.unique_id AND f.i = b.i - 1 AND f.i >= 1 JOIN f q ON q.unique_id = b.unique_id AND q.i = b.i)
SELECT unique_id, ds, round(x, 5) + 0.0 AS state, round(p, 5) AS variance, round(xs, 5) + 0.0 AS smoothed_state, round(ps, 5) AS smoothed_variance, round(last, 3) AS log_likelihood FROM n JOIN f USING (unique_id, i) JOIN b USING (unique_id, i) JOIN (SELECT unique_id, arg_max(ll, i) AS last FROM f GROUP BY 1) USING (unique_id)""")
def kalman_filter(spark, d):
    """A local level: its state has one component."""
    out = bayes.kalman_filter(daily_events(spark, d), [[1.0]], [[1.0]], [[1.0]], [[1.0]])
    one = [F.round(F.col(c)[0], 5).alias(c) for c in ("state", "variance", "smoothed_state", "smoothed_variance")]
    return out.select("unique_id", "ds", *one, F.round("log_likelihood", 3).alias("log_likelihood"))


# -- images ----------------------------------------------------------------

_N = f"{DAILY}, n AS (SELECT unique_id, y, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY unique_id) AS n FROM daily)"


@query("spectrogram", f"WITH {_N}, x AS (SELECT unique_id, y, i + 8 AS t FROM n), f AS (SELECT DISTINCT unique_id, unnest(range((n + 7) // 8 + 1)) AS j FROM n), k AS (SELECT unnest(range(9)) AS i) SELECT f.unique_id, k.i, f.j, round(ln(1 + sqrt(coalesce(sum(y * (0.5 - 0.5 * cos(pi() * (t - 8 * j) / 8)) * cos(pi() * k.i * (t - 8 * j) / 8)), 0) ^ 2 + coalesce(sum(y * (0.5 - 0.5 * cos(pi() * (t - 8 * j) / 8)) * sin(pi() * k.i * (t - 8 * j) / 8)), 0) ^ 2) / 8), 5) + 0.0 AS spectrogram FROM f CROSS JOIN k LEFT JOIN x ON x.unique_id = f.unique_id AND t >= 8 * j AND t < 8 * j + 16 GROUP BY 1, 2, 3")
def spectrogram(spark, d):
    return _cells(imaging.to_spectrogram(daily_events(spark, d), 16), "spectrogram")


@query("scalogram", f"WITH {_N}, k AS (SELECT unnest(range(8)) AS k), a AS (SELECT DISTINCT unique_id, k, greatest(n / 2, 2) ^ (k / 7) AS a, n FROM n, k), h AS (SELECT unique_id, k, a, floor(least(10 * a + 1e-9, n * 5) / 2) AS h FROM a) SELECT t.unique_id, k AS i, t.i AS j, round(sqrt(sum(s.y * exp(((s.i - t.i) / a) ^ 2 / -2) * cos(5 * (s.i - t.i) / a)) ^ 2 + sum(s.y * exp(((s.i - t.i) / a) ^ 2 / -2) * sin(5 * (s.i - t.i) / a)) ^ 2) * pi() ^ (-0.25) / sqrt(max(a)), 5) + 0.0 AS scalogram FROM n t JOIN h ON h.unique_id = t.unique_id JOIN n s ON s.unique_id = t.unique_id AND abs(s.i - t.i) <= h GROUP BY 1, 2, 3")
def scalogram(spark, d):
    return _cells(imaging.to_scalogram(daily_events(spark, d), n_scales=8), "scalogram")


@query("to_mtf", f"WITH {_N}, e AS (SELECT unique_id, quantile_cont(y, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS e FROM n GROUP BY 1), b AS (SELECT n.unique_id, i, len([q for q in e if q <= y]) AS b FROM n JOIN e USING (unique_id)), c AS (SELECT x.unique_id, x.b AS b1, y.b AS b2, count(*) AS c FROM b x JOIN b y ON x.unique_id = y.unique_id AND y.i = x.i + 1 GROUP BY 1, 2, 3), m AS (SELECT unique_id, b1, b2, c / sum(c) OVER (PARTITION BY unique_id, b1) AS m FROM c) SELECT x.unique_id, x.i, y.i AS j, round(coalesce(m, 0), 5) + 0.0 AS mtf FROM b x JOIN b y ON x.unique_id = y.unique_id LEFT JOIN m ON m.unique_id = x.unique_id AND b1 = x.b AND b2 = y.b")
def to_mtf(spark, d):
    return _cells(imaging.to_mtf(daily_events(spark, d)), "mtf")


_RUNS = "SELECT unique_id, {line} AS line, {at} - row_number() OVER (PARTITION BY unique_id, {line} ORDER BY {at}) AS g FROM r WHERE on_ AND {which}"


@query("rqa", f"""WITH {_N}, z AS (SELECT unique_id, i, n, (y - avg(y) OVER p) / stddev_pop(y) OVER p AS z FROM n WINDOW p AS (PARTITION BY unique_id)), r AS (SELECT a.unique_id, a.i, b.i AS j, a.n, abs(a.z - b.z) <= 0.1 AS on_ FROM z a JOIN z b ON a.unique_id = b.unique_id),
dl AS (SELECT unique_id, count(*) AS len FROM ({_RUNS.format(line='j - i', at='i', which='j > i')}) GROUP BY unique_id, line, g HAVING count(*) >= 2), vl AS (SELECT unique_id, count(*) AS len FROM ({_RUNS.format(line='j', at='i', which='TRUE')}) GROUP BY unique_id, line, g HAVING count(*) >= 2),
q AS (SELECT unique_id, len, count(*) / sum(count(*)) OVER (PARTITION BY unique_id) AS p FROM dl GROUP BY 1, 2), h AS (SELECT unique_id, -sum(p * ln(p)) AS h FROM q GROUP BY 1), t AS (SELECT unique_id, sum(on_::INT) AS total, sum((on_ AND j > i)::INT) AS upper, max(n) AS n FROM r GROUP BY 1)
SELECT unique_id, round(total / (n * n), 6) AS recurrence_rate, round(coalesce((SELECT sum(len) FROM dl WHERE dl.unique_id = t.unique_id) / nullif(upper, 0), 0), 6) AS determinism, round(coalesce((SELECT sum(len) FROM vl WHERE vl.unique_id = t.unique_id) / total, 0), 6) AS laminarity, round(coalesce((SELECT avg(len) FROM dl WHERE dl.unique_id = t.unique_id), 0), 6) AS mean_diagonal, round(coalesce((SELECT avg(len) FROM vl WHERE vl.unique_id = t.unique_id), 0), 6) AS mean_vertical, round(coalesce((SELECT h FROM h WHERE h.unique_id = t.unique_id), 0), 6) + 0.0 AS entropy FROM t""")
def rqa(spark, d):
    return rounded(imaging.rqa_features(imaging.to_recurrence_plot(daily_events(spark, d))))


def _signature_sql() -> str:
    w = "OVER (PARTITION BY unique_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    two = [(a, b) for a in "tv" for b in "tv"]
    first = ", ".join(f"coalesce(sum(d{a}) {w}, 0) AS b{a}" for a in "tv")
    second = ", ".join(f"coalesce(sum(b{a} * d{b}) {w}, 0) AS c{a}{b}" for a, b in two)
    cells = [f"sum(d{a})" for a in "tv"] + [f"sum(b{a} * d{b})" for a, b in two] + [f"sum(c{a}{b} * d{c})" for a, b in two for c in "tv"]
    return f"WITH {_N}, d AS (SELECT unique_id, i, 1 / (n - 1) AS dt, y - lag(y) OVER (PARTITION BY unique_id ORDER BY i) AS dv FROM n QUALIFY i > 0), f AS (SELECT *, {first} FROM d), g AS (SELECT *, {second} FROM f) SELECT unique_id, " + ", ".join(f"round({c}, 4) + 0.0 AS sig_{k}" for k, c in enumerate(cells)) + " FROM g GROUP BY 1"


@query("signature_features", _signature_sql())
def signature_features(spark, d):
    return rounded(imaging.signature_features(daily_events(spark, d)), 4)

"""Queries of adapters, windows, ensembles, causality tests and the rules of the
agents over whole tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel import pts
from tidepanel.operators import agents, changepoint, imaging, reconcile, validation
from tidepanel.plans.queries import _NAIVE, DAILY, W, _hierarchy, _wide, naive_frame, query, rounded
from tidepanel.sources import adapters
from tidepanel.sources.tables import daily_events, nation_orders, table
from tidepanel.streaming import state

_LIST = "l AS (SELECT unique_id, list(y ORDER BY ds) AS s, max(ds) AS last, min(ds) AS first FROM daily GROUP BY 1)"


def _items(df, column: str, *keys: str):
    """A row for each item of an array."""
    return rounded(df.select(*keys, F.posexplode(column).alias("i", column)))


# -- adapters --------------------------------------------------------------


@query("neuralforecast_frames", f"WITH {DAILY} SELECT unique_id, ds, round(y, 6) AS y_hat FROM daily")
def neuralforecast_frames(spark, d):
    """There and back: the values return as the forecast column."""
    return rounded(adapters.from_neuralforecast(adapters.to_neuralforecast(daily_events(spark, d))))


@query("pytorch_forecasting_rows", f"WITH {DAILY} SELECT unique_id, ds, round(y, 6) AS y, row_number() OVER ({W}) - 1 AS time_idx FROM daily")
def pytorch_forecasting_rows(spark, d):
    got = adapters.to_pytorch_forecasting(daily_events(spark, d))
    back = spark.createDataFrame(got["data"])
    return rounded(back.withColumn("ds", F.col("ds").cast("timestamp_ntz")))


@query("hf_records", f"WITH {DAILY}, {_LIST} SELECT unique_id, strftime(first, '%Y-%m-%d %H:%M:%S') AS start, unnest(range(len(s))) AS i, round(unnest(s), 6) AS target FROM l")
def hf_records(spark, d):
    return _items(adapters.to_hf_records(daily_events(spark, d)), "target", "unique_id", "start")


@query("build_windows", f"WITH {DAILY}, n AS (SELECT *, row_number() OVER ({W}) AS i, count(*) OVER (PARTITION BY unique_id) AS n FROM daily) SELECT a.unique_id, a.ds, b.i - a.i AS step, round(b.y, 6) AS y FROM n a JOIN n b ON a.unique_id = b.unique_id AND b.i BETWEEN a.i - 6 AND a.i + 3 WHERE a.i >= 7 AND a.i + 3 <= a.n")
def build_windows(spark, d):
    rows = adapters.build_windows(daily_events(spark, d), 7, 3)
    items = rows.select("unique_id", "ds", F.posexplode(F.concat("input", "target")).alias("p", "y"))
    return rounded(items.select("unique_id", "ds", (F.col("p") - 6).alias("step"), "y"))


@query("build_forecast_df", f"WITH {DAILY}, {_LIST} SELECT unique_id, (last + k * INTERVAL 1 DAY)::TIMESTAMP AS ds, round(s[k], 6) AS y_hat FROM l, (SELECT unnest(range(1, 6)) AS k)")
def build_forecast_df(spark, d):
    daily = daily_events(spark, d)
    first = daily.groupBy("unique_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ds", "y"))), lambda r: r["y"]).alias("forecast"))
    return rounded(adapters.build_forecast_df(first, daily, 5))


@query("classification_data", f"WITH {DAILY}, {_LIST}, c AS (SELECT *, length(unique_id)::BIGINT AS label FROM l) SELECT unique_id, label, dense_rank() OVER (ORDER BY label) - 1 AS label_code, unnest(range(len(s))) AS i, round(unnest(s), 6) AS series FROM c")
def classification_data(spark, d):
    rows = daily_events(spark, d).withColumn("label", F.length("unique_id").cast("long"))
    return _items(adapters.extract_classification_data(rows, "label"), "series", "unique_id", "label", "label_code")


@query("signature_image", f"WITH {DAILY}, n AS (SELECT unique_id, row_number() OVER ({W}) AS k, 1.0::DOUBLE / (count(*) OVER (PARTITION BY unique_id) - 1) AS dt, y - lag(y) OVER ({W}) AS dv FROM daily), c AS (SELECT unique_id, k, unnest([0, 1]) AS i, unnest([dt, dv]) AS d FROM n WHERE k > 1) SELECT a.unique_id, a.i, b.i AS j, round(sum(a.d * b.d), 4) + 0.0 AS signature FROM c a JOIN c b ON a.unique_id = b.unique_id AND a.k < b.k GROUP BY 1, 2, 3")
def signature_image(spark, d):
    rows = imaging.to_signature_image(daily_events(spark, d)).select("unique_id", F.posexplode("signature").alias("i", "row"))
    return rounded(rows.select("unique_id", "i", F.posexplode("row").alias("j", "signature")), 4)


@query("accessor_rmse", f"WITH {DAILY}, {_NAIVE} SELECT unique_id, round(sqrt(avg((y - y_hat) ^ 2)), 6) AS rmse FROM f GROUP BY 1")
def accessor_rmse(spark, d):
    return rounded(pts(naive_frame(spark, d)).rmse(id_col="unique_id"))


# -- windows, ensembles, causality, hierarchies ----------------------------


@query("sliding_window", f"WITH {DAILY} SELECT unique_id, ds, round(y, 6) AS y FROM daily QUALIFY row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) <= 10")
def sliding_window(spark, d):
    """Two batches by time; the window keeps the last ten rows of each series."""
    daily = daily_events(spark, d)
    early = F.dayofmonth("ds") <= 25
    return rounded(state.SlidingWindowManager(10).append(daily.filter(early)).append(daily.filter(~early)).frame_)


@query("stacking", f"WITH {DAILY}, f AS (SELECT unique_id, ds, y, lag(y, 1) OVER ({W}) AS a, lag(y, 7) OVER ({W}) AS b FROM daily QUALIFY b IS NOT NULL), m AS (SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_, var_pop(a) AS va, var_pop(b) AS vb FROM f), w AS (SELECT *, (ay * vb - by_ * ab) / (va * vb - ab * ab) AS wa, (by_ * va - ay * ab) / (va * vb - ab * ab) AS wb FROM m) SELECT unique_id, ds, round(my + wa * (a - ma) + wb * (b - mb), 3) + 0.0 AS y_hat FROM f, w")
def stacking(spark, d):
    """Least squares over two lags as forecasts."""
    from tidepanel.operators.features import lag_features

    rows = lag_features(daily_events(spark, d), [1, 7]).filter("y_lag_7 is not null")
    parts = [rows.select("unique_id", "ds", F.col(c).alias("y_hat")) for c in ("y_lag_1", "y_lag_7")]
    return rounded(validation.StackingForecaster().fit(parts, rows).predict(parts), 3)


_P = "1 - sin(atan(sqrt(f / v))) * (1 + coalesce(list_sum([gamma(2 * i + 1) / (gamma(i + 1) ^ 2 * 4 ^ i) * cos(atan(sqrt(f / v))) ^ (2 * i) for i in range(1, v // 2)]), 0))"


@query("granger_one_lag", f"WITH {DAILY}, g AS (SELECT DISTINCT ds FROM daily), u AS (SELECT unique_id, ds, coalesce(y, 0) AS y FROM g CROSS JOIN (SELECT DISTINCT unique_id FROM daily) LEFT JOIN daily USING (unique_id, ds)), x AS (SELECT a.unique_id AS cause, b.y, lag(b.y) OVER w AS o, lag(a.y) OVER w AS c FROM u a JOIN u b ON a.ds = b.ds AND a.unique_id <> 'view' AND b.unique_id = 'view' WINDOW w AS (PARTITION BY a.unique_id ORDER BY a.ds) QUALIFY o IS NOT NULL), m AS (SELECT cause, count(*) - 3 AS v, var_pop(y) AS yy, var_pop(o) AS oo, var_pop(c) AS cc, covar_pop(o, c) AS oc, covar_pop(o, y) AS oy, covar_pop(c, y) AS cy FROM x GROUP BY 1), r AS (SELECT cause, v, yy - oy * oy / oo AS r1, yy - (oy * (oy * cc - cy * oc) + cy * (cy * oo - oy * oc)) / (oo * cc - oc * oc) AS r2 FROM m), f AS (SELECT cause, v, (r1 - r2) / (r2 / v) AS f FROM r) SELECT cause, 1::BIGINT AS lag, round(f, 4) + 0.0 AS f_statistic, round({_P}, 4) AS p_value FROM f")
def granger_one_lag(spark, d):
    """Whether another event type helps to predict views. The tail of F(1, v) is a
    finite sum for even v, as in the months of the tables."""
    wide = _wide(spark, d)
    out = None
    for cause in sorted(set(wide.columns) - {"ds", "view"}):
        part = changepoint.granger_causality(wide, cause, "view", 1).withColumn("cause", F.lit(cause))
        out = part if out is None else out.unionByName(part)
    return rounded(out, 4)


@query("reconcile_grouped", "WITH nat AS (SELECT n_name, r_name, 'size ' || length(n_name) AS size, date_trunc('month', o_orderdate)::TIMESTAMP AS ds, sum(o_totalprice) AS y FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3, 4) SELECT coalesce(n_name, r_name, size, 'Total') AS unique_id, ds, round(sum(y), 2) AS y_hat FROM nat GROUP BY GROUPING SETS ((n_name, ds), (r_name, ds), (size, ds), (ds))")
def reconcile_grouped(spark, d):
    """Leaves with two parents: their region and the length of their name."""
    tree = _hierarchy(spark, d)
    names = [r.n_name for r in table(spark, d, "nation").select("n_name").collect()]
    grouped = {k: ([v, f"size {len(k)}"] if k in names else [v]) for k, v in tree.items()} | {f"size {len(n)}": ["Total"] for n in names}
    return rounded(reconcile.reconcile(nation_orders(spark, d), grouped), 2)


# -- rules of the agents ---------------------------------------------------

_LINE = ("l_orderkey", "l_linenumber")


def _lines(spark, d):
    l = table(spark, d, "lineitem")
    return l.select(*_LINE, "l_quantity", "l_discount", (F.col("l_tax") * 500).alias("temperature"), (F.col("l_discount") * 300).alias("generation"), "l_tax")


@query("weather_adjusted", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(l_quantity + CASE WHEN l_tax * 500 > 18 THEN (l_tax * 500 - 18) * 2 ELSE (18 - l_tax * 500) * 3 END, 4) + 0.0 AS adjusted FROM lineitem")
def weather_adjusted(spark, d):
    return rounded(agents.weather_adjusted(_lines(spark, d), "l_quantity", "temperature").select(*_LINE, "adjusted"), 4)


@query("net_demand", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(greatest(l_quantity - l_discount * 300, 0), 4) + 0.0 AS net_demand FROM lineitem")
def net_demand(spark, d):
    return rounded(agents.net_demand(_lines(spark, d), "l_quantity", "generation", curtail=True).select(*_LINE, "net_demand"), 4)


@query("sensed_demand", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(greatest(l_quantity * (1 + l_discount * 0.5 - l_tax), 0), 4) + 0.0 AS sensed FROM lineitem")
def sensed_demand(spark, d):
    return rounded(agents.sensed_demand(_lines(spark, d), "l_quantity", {"l_discount": 0.5, "l_tax": -1.0}).select(*_LINE, "sensed"), 4)


_SMOOTH = "[list_reduce({s}[1:k], lambda a, y: 0.5 * y + 0.5 * a) for k in range(1, len({s}) + 1)]"


@query("bullwhip", f"WITH {DAILY}, {_LIST}, o AS (SELECT unique_id, s, {_SMOOTH.format(s='s')} AS o1 FROM l), q AS (SELECT unique_id, s, o1, {_SMOOTH.format(s='o1')} AS o2 FROM o) SELECT unique_id, unnest(range(len(s))) AS i, round(unnest(o1), 4) AS orders_1, round(unnest(o2), 4) AS orders_2, round(list_var_pop(o2) / list_var_pop(s), 6) AS bullwhip_ratio FROM q")
def bullwhip(spark, d):
    rows = agents.bullwhip(daily_events(spark, d))
    items = rows.select("unique_id", F.posexplode(F.arrays_zip("orders_1", "orders_2")).alias("i", "o"), F.round("bullwhip_ratio", 6).alias("bullwhip_ratio"))
    return items.select("unique_id", F.col("i").cast("long").alias("i"), F.round("o.orders_1", 4).alias("orders_1"), F.round("o.orders_2", 4).alias("orders_2"), "bullwhip_ratio")


@query("remaining_life", f"WITH {DAILY}, n AS (SELECT unique_id, row_number() OVER ({W}) AS i, y / max(y) OVER (PARTITION BY unique_id) AS h FROM daily), a AS (SELECT unique_id, regr_slope(h, i) AS s, regr_intercept(h, i) AS b, max(i) AS n FROM n GROUP BY 1) SELECT unique_id, CASE WHEN s < 0 THEN round(greatest((0.2 - b) / s - n, 0), 3) ELSE 'inf'::DOUBLE END AS rul FROM a")
def remaining_life(spark, d):
    from tidepanel.panel import whole

    rows = daily_events(spark, d).withColumn("health", F.col("y") / F.max("y").over(whole("unique_id")))
    return rounded(agents.remaining_life(rows), 3)


_VITALS = "v AS (SELECT event_id, (35 + event_id % 101)::DOUBLE AS hr, (6 + event_id % 23)::DOUBLE AS rr, 34 + (event_id % 61)::DOUBLE / 10::DOUBLE AS t, (80 + event_id % 151)::DOUBLE AS bp, CASE WHEN event_id % 7 <> 0 THEN (88 + event_id % 13)::DOUBLE END AS ox FROM events)"


@query("clinical_scores", f"""WITH {_VITALS}, s AS (SELECT event_id,
(rr >= 22)::INT + (rr > 20)::INT + (bp <= 100)::INT + (hr > 90)::INT + (t > 38 OR t < 36)::INT AS sepsis_score,
(hr < 60 OR hr > 100)::INT + (rr < 12 OR rr > 20)::INT + (t < 36 OR t > 38)::INT + (bp < 100 OR bp > 140)::INT + coalesce((ox < 94 OR ox > 100)::INT, 0) AS out_of_range,
CASE WHEN rr <= 8 OR rr >= 25 THEN 3 WHEN rr >= 21 THEN 2 WHEN rr <= 11 THEN 1 ELSE 0 END + CASE WHEN ox <= 91 THEN 3 WHEN ox <= 93 THEN 2 WHEN ox <= 95 THEN 1 ELSE 0 END + CASE WHEN bp <= 90 OR bp >= 220 THEN 3 WHEN bp <= 100 THEN 2 WHEN bp <= 110 THEN 1 ELSE 0 END + CASE WHEN hr <= 40 OR hr >= 131 THEN 3 WHEN hr >= 111 THEN 2 WHEN hr <= 50 OR hr >= 91 THEN 1 ELSE 0 END + CASE WHEN t <= 35 THEN 3 WHEN t >= 39.1::DOUBLE THEN 2 WHEN t <= 36 OR t >= 38.1::DOUBLE THEN 1 ELSE 0 END AS news FROM v)
SELECT event_id, sepsis_score::BIGINT AS sepsis_score, out_of_range::BIGINT AS out_of_range, news::BIGINT AS news, sepsis_score >= 2 AS sepsis_flag, least(3, greatest(CASE WHEN news >= 7 THEN 3 WHEN news >= 5 THEN 2 WHEN news >= 1 THEN 1 ELSE 0 END, CASE WHEN sepsis_score >= 2 THEN 2 ELSE 0 END) + (out_of_range >= 3)::INT)::BIGINT AS tier FROM s""")
def clinical_scores(spark, d):
    """Vitals made from the event ids, one of them missing in every seventh row."""
    e = F.col("event_id")
    made = {"heart_rate": 35 + e % 101, "respiratory_rate": 6 + e % 23, "temperature": 34 + (e % 61).cast("double") / 10.0, "systolic_bp": 80 + e % 151, "spo2": F.when(e % 7 != 0, 88 + e % 13)}
    rows = table(spark, d, "events").select("event_id", *[v.cast("double").alias(k) for k, v in made.items()])
    return rounded(agents.clinical_scores(rows).drop(*made))

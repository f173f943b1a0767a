"""Registered queries over the driver tables, and the same in SQL.

Panels: ``daily`` (event type by day), ``monthly`` (order priority by month),
``users`` (events of a user in order), each over its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.operators import cleaning, features, forecasting, metrics, reconcile, similarity, transforms, validation
from tidepanel.sources.tables import daily_events, labelled_vectors, monthly_orders, nation_orders, table, user_events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DAILY = "daily AS (SELECT event_type AS unique_id, date_trunc('day', ts)::TIMESTAMP AS ds, sum(value) AS y FROM events GROUP BY 1, 2)"
MONTHLY = "monthly AS (SELECT o_orderpriority AS unique_id, date_trunc('month', o_orderdate)::TIMESTAMP AS ds, sum(o_totalprice) AS y FROM orders GROUP BY 1, 2)"
USERS = "users AS (SELECT user_id AS unique_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ds, CASE WHEN event_id % 7 <> 0 THEN value END AS y, value FROM events)"


def query(name: str, sql: str | None = None):
    def put(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return put


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, small integers widened: sums in another order agree."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        if kind in ("double", "float"):
            # Adding 0.0 turns -0.0 into 0.0.
            c = F.round(c, digits) + F.lit(0.0)
        elif kind in ("tinyint", "smallint", "int"):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def rd(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n.split('.')[-1]}" for n in names)


W = "PARTITION BY unique_id ORDER BY ds"

# -- features --------------------------------------------------------------


@query("lag_features", f"WITH {DAILY} SELECT unique_id, ds, {rd('y')}, round(lag(y, 1) OVER (PARTITION BY unique_id ORDER BY ds), 6) AS y_lag_1, round(lag(y, 7) OVER (PARTITION BY unique_id ORDER BY ds), 6) AS y_lag_7 FROM daily")
def lag_features(spark, d):
    return rounded(features.lag_features(daily_events(spark, d), [1, 7]))


@query("covariate_lag_features", f"WITH c AS (SELECT event_type AS unique_id, date_trunc('day', ts)::TIMESTAMP AS ds, sum(value) AS y, count(*) AS n FROM events GROUP BY 1, 2) SELECT unique_id, ds, {rd('y')}, n, round(lag(y, 1) OVER ({W}), 6) AS y_lag_1, lag(n, 1) OVER ({W}) AS n_lag_1 FROM c")
def covariate_lags(spark, d):
    c = table(spark, d, "events").groupBy(F.col("event_type").alias("unique_id"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ds")).agg(F.sum("value").alias("y"), F.count("*").alias("n"))
    return rounded(features.covariate_lag_features(c, ["y", "n"], [1]))


_ROLL = {"mean": "avg(y)", "std": "stddev_samp(y)", "min": "min(y)", "max": "max(y)", "sum": "sum(y)", "var": "var_samp(y)", "median": "median(y)"}


def _roll(frame: str, digits: int = 5) -> str:
    w = f"({W} {frame})"
    return ", ".join(f"CASE WHEN count(y) OVER {w} >= 5 THEN round({sql} OVER {w}, {digits}) END AS y_rolling_{a}_5" for a, sql in _ROLL.items())


@query("rolling_features", f"WITH {DAILY} SELECT unique_id, ds, {rd('y', digits=5)}, {_roll('ROWS BETWEEN 4 PRECEDING AND CURRENT ROW')} FROM daily")
def rolling(spark, d):
    return rounded(features.rolling_features(daily_events(spark, d), [5], list(_ROLL)), 5)


@query("rolling_centered", f"WITH {DAILY} SELECT unique_id, ds, {rd('y', digits=5)}, {_roll('ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING')} FROM daily")
def rolling_centered(spark, d):
    return rounded(features.rolling_features(daily_events(spark, d), [5], list(_ROLL), center=True), 5)


@query("calendar_features", "SELECT event_id, ts AS ds, isodow(ts) AS day_of_week, day(ts) AS day_of_month, dayofyear(ts) AS day_of_year, week(ts) AS week, month(ts) AS month, quarter(ts) AS quarter, year(ts) AS year, hour(ts) AS hour, minute(ts) AS minute, CAST(isodow(ts) >= 6 AS BIGINT) AS is_weekend FROM events")
def calendar(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("ts").alias("ds"))
    return rounded(features.calendar_features(e, ["day_of_week", "day_of_month", "day_of_year", "week", "month", "quarter", "year", "hour", "minute", "is_weekend"]))


@query("fourier_features", f"WITH {MONTHLY}, t AS (SELECT *, row_number() OVER ({W}) - 1 AS t FROM monthly) SELECT unique_id, ds, round(y, 2) AS y, " + ", ".join(f"round({f}(2 * pi() * {k} * t / 12.0), 6) + 0.0 AS fourier_{f}_12.0_{k}".replace("fourier_sin_12.0_" + str(k), f'"fourier_sin_12.0_{k}"').replace("fourier_cos_12.0_" + str(k), f'"fourier_cos_12.0_{k}"') for k in (1, 2) for f in ("sin", "cos")) + " FROM t")
def fourier(spark, d):
    out = features.fourier_features(monthly_orders(spark, d), 12, 2)
    return out.select("unique_id", "ds", F.round("y", 2).alias("y"), *[(F.round(F.col(f"`fourier_{f}_12.0_{k}`"), 6) + F.lit(0.0)).alias(f"fourier_{f}_12.0_{k}") for k in (1, 2) for f in ("sin", "cos")])


@query("time_embeddings", "SELECT event_id, ts AS ds, round(sin(2 * pi() * hour(ts) / 24), 6) + 0.0 AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) + 0.0 AS hour_cos, round(sin(2 * pi() * isodow(ts) / 7), 6) + 0.0 AS day_of_week_sin, round(cos(2 * pi() * isodow(ts) / 7), 6) + 0.0 AS day_of_week_cos FROM events")
def embeddings_of_time(spark, d):
    return rounded(features.time_embeddings(table(spark, d, "events").select("event_id", F.col("ts").alias("ds")), components=["hour", "day_of_week"]))


@query("interaction_features", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * l_discount, 6) AS l_extendedprice_x_l_discount, round(l_quantity + l_tax, 6) AS l_quantity_plus_l_tax FROM lineitem")
def interaction(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_quantity", "l_tax")
    out = features.interaction_features(features.interaction_features(rows, [("l_extendedprice", "l_discount")]), [("l_quantity", "l_tax")], "add")
    return rounded(out.drop("l_extendedprice", "l_discount", "l_quantity", "l_tax")).withColumn("l_linenumber", F.col("l_linenumber").cast("int"))


@query("target_encode", "WITH p AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS m FROM lineitem GROUP BY 1), g AS (SELECT avg(l_quantity) AS g FROM lineitem) SELECT l_orderkey, l_linenumber, round((n * m + 10 * g) / (n + 10), 6) AS l_returnflag_encoded FROM lineitem JOIN p USING (l_returnflag), g")
def encode(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return features.target_encode(rows, "l_returnflag", "l_quantity").select("l_orderkey", "l_linenumber", F.round("l_returnflag_encoded", 6).alias("l_returnflag_encoded"))


@query("holiday_features", "WITH h(date) AS (VALUES (DATE '2024-01-01'), (DATE '2024-01-15')) SELECT event_id, CAST(CAST(ts AS DATE) IN (SELECT date FROM h) AS BIGINT) AS is_holiday, coalesce((SELECT min(date_diff('day', CAST(ts AS DATE), date)) FROM h WHERE date >= CAST(ts AS DATE)), 365) AS days_to_holiday, coalesce((SELECT min(date_diff('day', date, CAST(ts AS DATE))) FROM h WHERE date <= CAST(ts AS DATE)), 365) AS days_since_holiday FROM events")
def holidays(spark, d):
    days = spark.sql("SELECT explode(array(date'2024-01-01', date'2024-01-15')) AS date")
    out = features.holiday_features(table(spark, d, "events").select("event_id", F.col("ts").alias("ds")), days, distance=True)
    return rounded(out.drop("ds"))


# -- transforms ------------------------------------------------------------


@query("log_transform", f"WITH {MONTHLY} SELECT unique_id, ds, round(ln(1 + y), 6) AS y, round(y, 2) AS y_original FROM monthly")
def log_transform(spark, d):
    return transforms.log_transform(monthly_orders(spark, d)).select("unique_id", "ds", F.round("y", 6).alias("y"), F.round("y_original", 2).alias("y_original"))


@query("log_round_trip", f"WITH {MONTHLY} SELECT unique_id, ds, round(y, 2) AS y FROM monthly")
def log_round_trip(spark, d):
    return rounded(transforms.inverse_log_transform(transforms.log_transform(monthly_orders(spark, d))), 2)


@query("boxcox_transform", f"WITH {MONTHLY} SELECT unique_id, ds, round((y ^ 0.5 - 1) / 0.5, 4) AS y, CAST(0.5 AS DOUBLE) AS y_boxcox_lambda FROM monthly")
def boxcox(spark, d):
    return rounded(transforms.boxcox_transform(monthly_orders(spark, d), 0.5).drop("y_original"), 4)


@query("boxcox_round_trip", f"WITH {MONTHLY} SELECT unique_id, ds, round(y, 2) AS y FROM monthly")
def boxcox_round_trip(spark, d):
    return rounded(transforms.inverse_boxcox_transform(transforms.boxcox_transform(monthly_orders(spark, d), 0.5)), 2)


@query("difference", f"WITH {MONTHLY}, a AS (SELECT unique_id, ds, y - lag(y, 12) OVER ({W}) AS y FROM monthly), b AS (SELECT unique_id, ds, y - lag(y, 12) OVER ({W}) AS y FROM a) SELECT unique_id, ds, round(y, 2) + 0.0 AS y FROM b WHERE y IS NOT NULL")
def difference(spark, d):
    return rounded(transforms.difference(monthly_orders(spark, d), 2, 12).drop("y_diff_initial"), 2)


@query("undifference", f"WITH {MONTHLY}, t AS (SELECT *, row_number() OVER ({W}) AS i FROM monthly) SELECT unique_id, ds, round(y, 2) + 0.0 AS y FROM t WHERE i > 6")
def undifference(spark, d):
    return rounded(transforms.undifference(transforms.difference(monthly_orders(spark, d), 2, 3), 2, 3), 2)


# -- cleaning --------------------------------------------------------------

_BACK = "(PARTITION BY unique_id ORDER BY ds ROWS UNBOUNDED PRECEDING)"
_AHEAD = "(PARTITION BY unique_id ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
_LINEAR = f"n AS (SELECT *, last_value(y IGNORE NULLS) OVER {_BACK} AS v0, first_value(y IGNORE NULLS) OVER {_AHEAD} AS v1, last_value(CASE WHEN y IS NOT NULL THEN ds END IGNORE NULLS) OVER {_BACK} AS i0, first_value(CASE WHEN y IS NOT NULL THEN ds END IGNORE NULLS) OVER {_AHEAD} AS i1 FROM users)"
_IMPUTE = {
    "forward_fill": f"SELECT unique_id, ds, round(last_value(y IGNORE NULLS) OVER {_BACK}, 6) AS y FROM users",
    "backward_fill": f"SELECT unique_id, ds, round(first_value(y IGNORE NULLS) OVER {_AHEAD}, 6) AS y FROM users",
    "mean": "SELECT unique_id, ds, round(coalesce(y, avg(y) OVER (PARTITION BY unique_id)), 6) AS y FROM users",
    "median": "SELECT unique_id, ds, round(coalesce(y, median(y) OVER (PARTITION BY unique_id)), 6) AS y FROM users",
}


def _impute(method: str):
    def run(spark, d):
        return rounded(cleaning.impute(user_events(spark, d).drop("value"), method=method))

    return run


for _m, _sql in _IMPUTE.items():
    query(f"impute_{_m}", f"WITH {USERS} {_sql}")(_impute(_m))
query("impute_linear", f"WITH {USERS}, {_LINEAR} SELECT unique_id, ds, round(CASE WHEN y IS NOT NULL THEN y ELSE v0 + (v1 - v0) * (ds - i0) / (i1 - i0) END, 6) AS y FROM n")(_impute("linear"))


_U = "u AS (SELECT unique_id, ds, value AS y FROM users)"


@query("outliers_zscore", f"WITH {USERS}, {_U} SELECT unique_id, ds, round(y, 6) AS y, coalesce(abs(y - avg(y) OVER p) / nullif(stddev_samp(y) OVER p, 0), 0) > 2 AS is_outlier FROM u WINDOW p AS (PARTITION BY unique_id)")
def outliers_zscore(spark, d):
    return rounded(cleaning.detect_outliers(_values(spark, d), threshold=2.0))


def _values(spark, d):
    return user_events(spark, d).select("unique_id", "ds", F.col("value").alias("y"))


@query("outliers_iqr", f"WITH {USERS}, {_U}, q AS (SELECT unique_id, quantile_cont(y, 0.25) AS a, quantile_cont(y, 0.75) AS b FROM u GROUP BY 1) SELECT unique_id, ds, round(y, 6) AS y, y < a - 1.5 * (b - a) OR y > b + 1.5 * (b - a) AS is_outlier FROM u JOIN q USING (unique_id)")
def outliers_iqr(spark, d):
    return rounded(cleaning.detect_outliers(_values(spark, d), method="iqr", threshold=1.5))


@query("outliers_hampel", f"WITH {USERS}, {_U}, m AS (SELECT *, list(y) OVER f AS l, median(y) OVER f AS m FROM u WINDOW f AS ({W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)), s AS (SELECT *, 1.4826 * list_median(list_transform(l, lambda x: abs(x - m))) AS mad FROM m) SELECT unique_id, ds, round(y, 6) AS y, coalesce(mad > 0 AND abs(y - m) > 3 * mad, false) AS is_outlier FROM s")
def outliers_hampel(spark, d):
    return rounded(cleaning.detect_outliers(_values(spark, d), method="hampel", window=7))


@query("outliers_rolling_zscore", f"WITH {USERS}, {_U} SELECT unique_id, ds, round(y, 6) AS y, coalesce(CASE WHEN count(y) OVER f >= 10 THEN abs(y - avg(y) OVER f) / nullif(stddev_samp(y) OVER f, 0) END > 2, false) AS is_outlier FROM u WINDOW f AS ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def outliers_rolling(spark, d):
    return rounded(cleaning.detect_outliers(_values(spark, d), method="rolling_zscore", window=10, threshold=2.0))


@query("treat_clip", f"WITH {USERS}, {_U} SELECT unique_id, ds, round(greatest(least(y, avg(y) OVER p + 2 * coalesce(stddev_samp(y) OVER p, 0)), avg(y) OVER p - 2 * coalesce(stddev_samp(y) OVER p, 0)), 6) AS y FROM u WINDOW p AS (PARTITION BY unique_id)")
def treat_clip(spark, d):
    return rounded(cleaning.treat_outliers(_values(spark, d), threshold=2.0))


_FLAG = f"f AS (SELECT *, coalesce(abs(y - avg(y) OVER p) / nullif(stddev_samp(y) OVER p, 0), 0) > 2 AS o, median(y) OVER p AS m FROM u WINDOW p AS (PARTITION BY unique_id))"


@query("treat_median", f"WITH {USERS}, {_U}, {_FLAG} SELECT unique_id, ds, round(CASE WHEN o THEN m ELSE y END, 6) AS y FROM f")
def treat_median(spark, d):
    return rounded(cleaning.treat_outliers(_values(spark, d), replacement="median", threshold=2.0))


@query("treat_null", f"WITH {USERS}, {_U}, {_FLAG} SELECT unique_id, ds, round(CASE WHEN NOT o THEN y END, 6) AS y FROM f")
def treat_null(spark, d):
    return rounded(cleaning.treat_outliers(_values(spark, d), replacement="null", threshold=2.0))


@query("treat_interpolate", f"WITH {USERS}, {_U}, {_FLAG}, users2 AS (SELECT unique_id, ds, CASE WHEN NOT o THEN y END AS y FROM f), {_LINEAR.replace('FROM users', 'FROM users2')} SELECT unique_id, ds, round(CASE WHEN y IS NOT NULL THEN y ELSE v0 + (v1 - v0) * (ds - i0) / (i1 - i0) END, 6) AS y FROM n")
def treat_interpolate(spark, d):
    return rounded(cleaning.treat_outliers(_values(spark, d), replacement="interpolate", threshold=2.0))


_AGGS = {"mean": "avg(value)", "sum": "sum(value)", "min": "min(value)", "max": "max(value)", "median": "median(value)", "first": "arg_min(value, struct_pack(a := ts, b := event_id))", "last": "arg_max(value, struct_pack(a := ts, b := event_id))"}


def _resample(rule: str, agg: str):
    def run(spark, d):
        e = table(spark, d, "events").select(F.col("event_type").alias("unique_id"), F.col("ts").alias("ds"), F.col("value").alias("y"), "event_id")
        if agg in ("first", "last"):
            pick = F.min_by if agg == "first" else F.max_by
            return rounded(e.groupBy("unique_id", cleaning.bucket("ds", rule).cast("timestamp_ntz").alias("ds")).agg(pick("y", F.struct(F.col("ds"), F.col("event_id"))).alias("y")))
        return rounded(cleaning.resample(e, rule, agg))

    return run


for _rule, _unit in (("1d", "day"), ("1w", "week"), ("1mo", "month"), ("1h", "hour")):
    for _a in ("mean", "sum", "median", "last") if _rule == "1d" else ("mean", "first") if _rule == "1h" else ("sum",):
        query(f"resample_{_unit}_{_a}", f"SELECT event_type AS unique_id, date_trunc('{_unit}', ts)::TIMESTAMP AS ds, round({_AGGS[_a]}, 6) AS y FROM events GROUP BY 1, 2")(_resample(_rule, _a))


@query("resample_6h_gap_fill", "WITH b AS (SELECT event_type AS unique_id, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS ds, sum(value) AS y FROM events GROUP BY 1, 2), e AS (SELECT unique_id, min(ds) AS a, max(ds) AS z FROM b GROUP BY 1), g AS (SELECT unique_id, unnest(generate_series(a, z, INTERVAL 6 HOURS)) AS ds FROM e) SELECT g.unique_id, g.ds, round(last_value(y IGNORE NULLS) OVER (PARTITION BY g.unique_id ORDER BY g.ds ROWS UNBOUNDED PRECEDING), 6) AS y FROM g LEFT JOIN b ON b.unique_id = g.unique_id AND b.ds = g.ds")
def resample_gap(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("unique_id"), F.col("ts").alias("ds"), F.col("value").alias("y"))
    return rounded(cleaning.resample(e, "6h", "sum", fill="gap_forward"))


_DEC = """t AS (SELECT *, (row_number() OVER ({w}) - 1) % 7 AS period_idx, CASE WHEN count(y) OVER c >= 7 THEN avg(y) OVER c END AS trend FROM daily WINDOW c AS ({w} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
s AS (SELECT *, avg({bare}) OVER (PARTITION BY unique_id, period_idx) AS g FROM t),
r AS (SELECT *, g - avg(g) OVER (PARTITION BY unique_id) AS seasonal FROM s),
z AS (SELECT unique_id, ds, y, period_idx, trend, seasonal, {resid} AS resid FROM r WHERE trend IS NOT NULL)"""
_ADD = _DEC.format(w=W, bare="y - trend", resid="y - trend - seasonal")
_MUL = _DEC.format(w=W, bare="y / nullif(trend, 0)", resid="y / nullif(trend * seasonal, 0)")


@query("seasonal_decomposition_additive", f"WITH {DAILY}, {_ADD} SELECT unique_id, ds, period_idx, {rd('y', 'trend', 'seasonal', 'resid')}, coalesce(abs(resid) > 1.5 * stddev_samp(resid) OVER (PARTITION BY unique_id), false) AS is_anomaly FROM z")
def decomposition_additive(spark, d):
    return rounded(cleaning.seasonal_decomposition(daily_events(spark, d), 7, anomaly_threshold=1.5))


@query("seasonal_decomposition_multiplicative", f"WITH {DAILY}, {_MUL} SELECT unique_id, ds, period_idx, {rd('y', 'trend', 'seasonal', digits=4)}, round(1 / resid, 6) + 0.0 AS inverse_resid FROM z WHERE resid IS NOT NULL AND resid <> 0")
def decomposition_multiplicative(spark, d):
    out = cleaning.seasonal_decomposition(daily_events(spark, d), 7, "multiplicative").filter("resid <> 0")
    return out.select("unique_id", "ds", F.col("period_idx").cast("long").alias("period_idx"), *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("y", "trend", "seasonal")], (F.round(1 / F.col("resid"), 6) + F.lit(0.0)).alias("inverse_resid"))


@query("seasonal_decompose_features", f"WITH {DAILY}, {_ADD} SELECT unique_id, round(abs(var_samp(resid) / nullif(var_samp(trend + resid), 0) - 1), 6) AS trend_strength, round(abs(var_samp(resid) / nullif(var_samp(seasonal + resid), 0) - 1), 6) AS seasonal_strength, round(stddev_samp(resid) / nullif(avg(y), 0), 6) + 0.0 AS resid_var FROM z GROUP BY unique_id")
def decompose_features(spark, d):
    return rounded(cleaning.seasonal_decompose_features(daily_events(spark, d), 7))


@query("fourier_decomposition")
def fourier_decomposition(spark, d):
    return rounded(cleaning.fourier_decomposition(daily_events(spark, d), 7, ("day_of_week",), 2), 4)


@query("cusum", f"WITH {DAILY}, c AS (SELECT *, y - avg(y) OVER p AS v, stddev_samp(y) OVER p AS s FROM daily WINDOW p AS (PARTITION BY unique_id)) SELECT unique_id, ds, {rd('y')}, round(CASE WHEN coalesce(s, 0) > 0 THEN sum(v) OVER ({W} ROWS UNBOUNDED PRECEDING) / s ELSE 0 END, 6) + 0.0 AS cusum FROM c")
def cusum(spark, d):
    return rounded(cleaning.cusum(daily_events(spark, d)))


# -- metrics ---------------------------------------------------------------

_NAIVE = f"fc AS (SELECT unique_id, ds, y, lag(y, 1) OVER ({W}) AS y_hat FROM daily), f AS (SELECT * FROM fc WHERE y_hat IS NOT NULL)"


def naive_frame(spark, d):
    """Actuals beside one-step naive forecasts."""
    rows = features.lag_features(daily_events(spark, d), [1]).withColumnRenamed("y_lag_1", "y_hat")
    return rows.filter("y_hat is not null")


_METRIC = {
    "mae": "avg(abs(y - y_hat))", "rmse": "sqrt(avg((y - y_hat) ^ 2))", "mape": "avg(abs((y - y_hat) / y)) FILTER (WHERE y <> 0)",
    "smape": "avg(2 * abs(y - y_hat) / (abs(y) + abs(y_hat))) FILTER (WHERE abs(y) + abs(y_hat) <> 0)",
}
for _n, _sql in _METRIC.items():
    query(f"{_n}", f"WITH {DAILY}, {_NAIVE} SELECT unique_id, round({_sql}, 6) AS {_n} FROM f GROUP BY 1")(lambda spark, d, m=_n: rounded(getattr(metrics, m)(naive_frame(spark, d), id_col="unique_id")))


@query("mase", f"WITH {DAILY}, {_NAIVE}, g AS (SELECT *, abs(y - lag(y, 7) OVER ({W})) AS n FROM f) SELECT unique_id, round(avg(abs(y - y_hat)) / avg(n), 6) AS mase FROM g GROUP BY 1")
def mase(spark, d):
    return rounded(metrics.mase(naive_frame(spark, d), season_length=7))


_Q = f"q AS (SELECT *, y_hat * 0.8 AS a, y_hat AS b, y_hat * 1.2 AS c FROM f)"


def quantile_frame(spark, d):
    f = naive_frame(spark, d)
    return f.select("unique_id", "ds", "y", (F.col("y_hat") * 0.8).alias("q_a"), F.col("y_hat").alias("q_b"), (F.col("y_hat") * 1.2).alias("q_c"))


_QC = (["q_a", "q_b", "q_c"], [0.1, 0.5, 0.9])


@query("crps", f"WITH {DAILY}, {_NAIVE}, {_Q} SELECT unique_id, round(avg((greatest((y - a) * 0.1, (y - a) * -0.9) + greatest((y - b) * 0.5, (y - b) * -0.5) + greatest((y - c) * 0.9, (y - c) * -0.1)) / 3), 6) AS crps FROM q GROUP BY 1")
def crps(spark, d):
    return rounded(metrics.crps(quantile_frame(spark, d), "y", *_QC, id_col="unique_id"))


@query("calibration_table", f"WITH {DAILY}, {_NAIVE}, {_Q}, u AS (SELECT 0.1::DOUBLE AS quantile, avg((y <= a)::INT) AS observed FROM q UNION ALL SELECT 0.5, avg((y <= b)::INT) FROM q UNION ALL SELECT 0.9, avg((y <= c)::INT) FROM q) SELECT quantile, quantile AS expected, round(observed, 6) AS observed FROM u")
def calibration(spark, d):
    return rounded(metrics.calibration_table(quantile_frame(spark, d), "y", *_QC))


@query("reliability_diagram", f"WITH {DAILY}, {_NAIVE}, {_Q}, u AS (SELECT 0.1::DOUBLE AS quantile, avg((y <= a)::INT) AS observed FROM q UNION ALL SELECT 0.5, avg((y <= b)::INT) FROM q UNION ALL SELECT 0.9, avg((y <= c)::INT) FROM q) SELECT quantile AS expected, round(observed, 6) AS observed FROM u")
def reliability(spark, d):
    return rounded(metrics.reliability_diagram(quantile_frame(spark, d), "y", *_QC))


@query("pit_histogram", f"WITH {DAILY}, {_NAIVE}, {_Q}, p AS (SELECT least(floor(((a <= y)::INT + (b <= y)::INT + (c <= y)::INT) / 3.0 * 4), 3)::INT AS bin, count(*) AS n FROM q GROUP BY 1) SELECT b.bin, b.bin / 4.0::DOUBLE AS bin_left, (b.bin + 1) / 4.0::DOUBLE AS bin_right, coalesce(n, 0) AS count, round(coalesce(n, 0) * 4 / sum(coalesce(n, 0)) OVER (), 6) AS density FROM (SELECT unnest(range(4)) AS bin) b LEFT JOIN p ON p.bin = b.bin")
def pit(spark, d):
    return rounded(metrics.pit_histogram(quantile_frame(spark, d), "y", *_QC, n_bins=4))


@query("bias_detect", f"WITH {DAILY}, {_NAIVE} SELECT unique_id, {rd('mean_error')}, round(sign_ratio, 6) AS sign_ratio, {rd('bias_ratio')} FROM (SELECT unique_id, avg(y_hat - y) AS mean_error, avg((y_hat > y)::INT) AS sign_ratio, coalesce(avg(y_hat - y) / nullif(avg(abs(y_hat - y)), 0), 0) AS bias_ratio FROM f GROUP BY 1)")
def bias_detect(spark, d):
    return rounded(metrics.bias_detect(naive_frame(spark, d), id_col="unique_id"))


@query("bias_correct_mean", f"WITH {DAILY}, {_NAIVE} SELECT unique_id, ds, round(y, 5) AS y, round(y_hat - avg(y_hat - y) OVER (PARTITION BY unique_id), 5) AS y_hat, round(y_hat, 5) AS y_hat_original FROM f")
def bias_correct_mean(spark, d):
    return rounded(metrics.bias_correct(naive_frame(spark, d), id_col="unique_id"), 5)


@query("bias_correct_regression", f"WITH {DAILY}, {_NAIVE}, s AS (SELECT unique_id, covar_pop(y, y_hat) / (var_pop(y_hat) + 1e-10) AS k, avg(y) AS my, avg(y_hat) AS mp FROM f GROUP BY 1) SELECT unique_id, ds, round(y, 4) AS y, round(my + k * (y_hat - mp), 4) AS y_hat, round(y_hat, 4) AS y_hat_original FROM f JOIN s USING (unique_id)")
def bias_correct_regression(spark, d):
    return rounded(metrics.bias_correct(naive_frame(spark, d), method="regression", id_col="unique_id"), 4)


@query("bias_correct_quantile", f"WITH {DAILY}, {_NAIVE}, r AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY y_hat) AS i FROM f), s AS (SELECT unique_id, y AS z, row_number() OVER (PARTITION BY unique_id ORDER BY y) AS i FROM f) SELECT unique_id, ds, round(y, 5) AS y, round(z, 5) AS y_hat, round(y_hat, 5) AS y_hat_original FROM r JOIN s USING (unique_id, i)")
def bias_correct_quantile(spark, d):
    return rounded(metrics.bias_correct(naive_frame(spark, d), method="quantile", id_col="unique_id"), 5)


@query("acf", f"WITH {DAILY}, n AS (SELECT *, row_number() OVER ({W}) AS i, y - avg(y) OVER (PARTITION BY unique_id) AS v, count(*) OVER (PARTITION BY unique_id) AS n FROM daily), k AS (SELECT unnest(range(8)) AS lag), z AS (SELECT unique_id, sum(v * v) AS s, max(n) AS n FROM n GROUP BY 1) SELECT a.unique_id, lag, round(sum(a.v * b.v) / max(s), 6) + 0.0 AS acf, round(-1.96 / sqrt(max(z.n)), 6) AS lower, round(1.96 / sqrt(max(z.n)), 6) AS upper FROM k, n a JOIN n b ON a.unique_id = b.unique_id JOIN z ON z.unique_id = a.unique_id WHERE a.i = b.i + lag GROUP BY a.unique_id, lag")
def acf(spark, d):
    return rounded(metrics.acf(daily_events(spark, d), max_lags=7))


@query("ljung_box")
def ljung_box(spark, d):
    return rounded(metrics.ljung_box(daily_events(spark, d), lags=[5, 10]))


@query("trend_statistics", f"WITH {DAILY}, n AS (SELECT *, row_number() OVER ({W}) AS i FROM daily) SELECT a.unique_id, round(sum(sign(b.y - a.y)) / count(*), 6) + 0.0 AS mann_kendall, round(median((b.y - a.y) / (b.i - a.i)), 6) + 0.0 AS sens_slope FROM n a JOIN n b ON a.unique_id = b.unique_id AND a.i < b.i GROUP BY 1")
def trend_statistics(spark, d):
    return rounded(metrics.trend_statistics(daily_events(spark, d)))


# -- forecasts -------------------------------------------------------------

_H = "h AS (SELECT unnest(range(1, 15)) AS k), l AS (SELECT unique_id, max(ds) AS last, list(y ORDER BY ds) AS s FROM daily GROUP BY 1)"


def _fc(value: str, filter_: str = "") -> str:
    return f"WITH {DAILY}, {_H} SELECT unique_id, (last + k * INTERVAL 1 DAY)::TIMESTAMP AS ds, round({value}, 6) + 0.0 AS y_hat FROM l, h {filter_}"


@query("naive_forecast", _fc("s[-1]"))
def naive_forecast(spark, d):
    return rounded(forecasting.naive_forecast(daily_events(spark, d), 14))


@query("seasonal_naive_forecast", _fc("s[len(s) - 7 + (k - 1) % 7 + 1]"))
def seasonal_naive_forecast(spark, d):
    return rounded(forecasting.seasonal_naive_forecast(daily_events(spark, d), 14, 7))


@query("moving_average_forecast", _fc("list_avg(s[-5:])"))
def moving_average_forecast(spark, d):
    return rounded(forecasting.moving_average_forecast(daily_events(spark, d), 14, 5))


@query("ses_forecast", _fc("list_reduce(s, lambda a, y: 0.3 * y + 0.7 * a)"))
def ses_forecast(spark, d):
    return rounded(forecasting.ses_forecast(daily_events(spark, d), 14))


_HOLT = f"""WITH RECURSIVE {DAILY}, n AS (SELECT unique_id, ds, y, row_number() OVER ({W}) AS i FROM daily),
r AS (SELECT a.unique_id, 1::BIGINT AS i, a.y AS lev, b.y - a.y AS tr FROM n a JOIN n b ON a.unique_id = b.unique_id AND a.i = 1 AND b.i = 2
UNION ALL SELECT r.unique_id, n.i, 0.3 * n.y + 0.7 * (lev + tr), 0.1 * (0.3 * n.y + 0.7 * (lev + tr) - lev) + 0.9 * tr FROM r JOIN n ON n.unique_id = r.unique_id AND n.i = r.i + 1),
z AS (SELECT unique_id, arg_max(lev, i) AS lev, arg_max(tr, i) AS tr FROM r GROUP BY 1), l AS (SELECT unique_id, max(ds) AS last FROM daily GROUP BY 1), h AS (SELECT unnest(range(1, 15)) AS k)
SELECT unique_id, (last + k * INTERVAL 1 DAY)::TIMESTAMP AS ds, round(lev + k * tr, 6) + 0.0 AS y_hat FROM z JOIN l USING (unique_id), h"""


@query("holt_forecast", _HOLT)
def holt_forecast(spark, d):
    return rounded(forecasting.holt_forecast(daily_events(spark, d), 14))


def _hw_sql(additive: bool) -> str:
    bare = "n.y - s[(n.i - 1) % 7 + 1]" if additive else "n.y / s[(n.i - 1) % 7 + 1]"
    new = "n.y - ({L})" if additive else "n.y / ({L})"
    lev = f"(0.3 * ({bare}) + 0.7 * (lev + tr))"
    season = f"list_concat(list_concat(s[:(n.i - 1) % 7], [0.1 * ({new.format(L=lev)}) + 0.9 * s[(n.i - 1) % 7 + 1]]), s[(n.i - 1) % 7 + 2:])"
    init = "list_transform(v[1:7], lambda x: x - list_avg(v[1:7]))" if additive else "list_transform(v[1:7], lambda x: x / list_avg(v[1:7]))"
    last = "lev + k * tr + s[(i - 1 + k) % 7 + 1]" if additive else "(lev + k * tr) * s[(i - 1 + k) % 7 + 1]"
    return f"""WITH RECURSIVE {DAILY}, n AS (SELECT unique_id, ds, y, row_number() OVER ({W}) AS i FROM daily), a AS (SELECT unique_id, list(y ORDER BY ds) AS v FROM daily GROUP BY 1),
r AS (SELECT unique_id, 7::BIGINT AS i, list_avg(v[1:7]) AS lev, (list_avg(v[8:14]) - list_avg(v[1:7])) / 7 AS tr, {init} AS s FROM a
UNION ALL SELECT r.unique_id, n.i, {lev}, 0.1 * ({lev} - lev) + 0.9 * tr, {season} FROM r JOIN n ON n.unique_id = r.unique_id AND n.i = r.i + 1),
z AS (SELECT unique_id, max(i) AS i, arg_max(lev, i) AS lev, arg_max(tr, i) AS tr, arg_max(s, i) AS s FROM r GROUP BY 1), l AS (SELECT unique_id, max(ds) AS last FROM daily GROUP BY 1), h AS (SELECT unnest(range(1, 15)) AS k)
SELECT unique_id, (last + k * INTERVAL 1 DAY)::TIMESTAMP AS ds, round({last}, 5) + 0.0 AS y_hat FROM z JOIN l USING (unique_id), h"""


@query("holt_winters_additive", _hw_sql(True))
def holt_winters_additive(spark, d):
    return rounded(forecasting.holt_winters_forecast(daily_events(spark, d), 14, 7), 5)


@query("holt_winters_multiplicative", _hw_sql(False))
def holt_winters_multiplicative(spark, d):
    return rounded(forecasting.holt_winters_forecast(daily_events(spark, d), 14, 7, seasonal="multiplicative"), 5)


@query("auto_arima")
def auto_arima(spark, d):
    return rounded(forecasting.auto_arima(daily_events(spark, d), 14), 4)


@query("arima_fit_forecast")
def arima_fit_forecast(spark, d):
    return rounded(forecasting.arima_forecast(forecasting.arima_fit(daily_events(spark, d), (1, 1, 1)), 14), 4)


@query("scum_forecast")
def scum(spark, d):
    return rounded(forecasting.SCUM(7).fit(daily_events(spark, d)).predict(14), 4)


_RES = f"r AS (SELECT unique_id, y - y_hat AS residual FROM f), p AS (SELECT unique_id, ds, y AS y_hat FROM daily WHERE ds = (SELECT max(ds) FROM daily)), n AS (SELECT unique_id, count(*) AS n FROM r GROUP BY 1), s AS (SELECT unique_id, list_sort(list(residual)) AS s, list_sort(list(abs(residual))) AS a FROM r GROUP BY 1)"


def _at(list_: str, level: str) -> str:
    x = f"((len({list_}) - 1) * {level})"
    return f"({list_}[floor({x})::BIGINT + 1] + ({list_}[least(floor({x})::BIGINT + 2, len({list_}))] - {list_}[floor({x})::BIGINT + 1]) * ({x} - floor({x})))"


def _last_day(spark, d):
    daily = daily_events(spark, d)
    last = daily.agg(F.max("ds").alias("m"))
    return daily.join(F.broadcast(last), F.col("ds") == F.col("m")).select("unique_id", "ds", F.col("y").alias("y_hat"))


@query("conformal_symmetric", f"WITH {DAILY}, {_NAIVE}, {_RES} SELECT unique_id, ds, round(y_hat, 5) AS y_hat, round(y_hat - w, 5) AS y_hat_lower, round(y_hat + w, 5) AS y_hat_upper FROM (SELECT p.*, {_at('a', 'least(ceil((n + 1) * 0.9) / n, 1.0)')} AS w FROM p JOIN n USING (unique_id) JOIN s USING (unique_id))")
def conformal_symmetric(spark, d):
    res = naive_frame(spark, d).select("unique_id", (F.col("y") - F.col("y_hat")).alias("residual"))
    return rounded(validation.conformal_interval(res, _last_day(spark, d), id_col="unique_id"), 5)


@query("conformal_asymmetric", f"WITH {DAILY}, {_NAIVE}, {_RES} SELECT unique_id, ds, round(y_hat, 5) AS y_hat, round(y_hat + {_at('s', 'greatest(floor((n + 1) * 0.05) / n, 0.0)')}, 5) AS y_hat_lower, round(y_hat + {_at('s', 'least(ceil((n + 1) * 0.95) / n, 1.0)')}, 5) AS y_hat_upper FROM p JOIN n USING (unique_id) JOIN s USING (unique_id)")
def conformal_asymmetric(spark, d):
    res = naive_frame(spark, d).select("unique_id", (F.col("y") - F.col("y_hat")).alias("residual"))
    return rounded(validation.conformal_interval(res, _last_day(spark, d), id_col="unique_id", symmetric=False), 5)


@query("weighted_ensemble", f"WITH {DAILY}, {_H} SELECT unique_id, (last + k * INTERVAL 1 DAY)::TIMESTAMP AS ds, round(0.25 * s[-1] + 0.75 * list_avg(s[-5:]), 6) AS y_hat FROM l, h")
def weighted_ensemble(spark, d):
    daily = daily_events(spark, d)
    parts = [forecasting.naive_forecast(daily, 14), forecasting.moving_average_forecast(daily, 14, 5)]
    return rounded(validation.WeightedEnsemble([1.0, 3.0]).combine(parts, check=False))


_FOLDS = "t AS (SELECT ds, row_number() OVER (ORDER BY ds) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ds FROM daily)), k AS (SELECT unnest(range(3)) AS fold)"


@query("cv_expanding", f"WITH {DAILY}, {_FOLDS}, e AS (SELECT ds, fold, i, n - 2 * 2 - 1 - 3 + fold * 2 AS b FROM t, k) SELECT unique_id, ds, round(y, 6) AS y, fold, CASE WHEN i < b THEN 'train' ELSE 'test' END AS role FROM daily JOIN e USING (ds) WHERE i < b OR (i >= b + 1 AND i < b + 4)")
def cv_expanding(spark, d):
    daily = daily_events(spark, d)
    return rounded(validation.fold_frame(daily, validation.fold_table(daily, 3, 3, 2, 1)))


@query("cv_sliding", f"WITH {DAILY}, {_FOLDS}, e AS (SELECT ds, fold, i, 10 + fold * 2 AS b FROM t, k) SELECT unique_id, ds, round(y, 6) AS y, fold, CASE WHEN i < b THEN 'train' ELSE 'test' END AS role FROM daily JOIN e USING (ds) WHERE (i >= b - 10 AND i < b) OR (i >= b AND i < b + 3)")
def cv_sliding(spark, d):
    daily = daily_events(spark, d)
    return rounded(validation.fold_frame(daily, validation.fold_table(daily, 3, 3, 2, fixed_train_size=10)))


class Naive:
    """The naive forecast as a model."""

    def fit(self, df):
        return self

    def predict(self, df, h):
        return forecasting.naive_forecast(df, h)


@query("backtest_naive", f"WITH {DAILY}, {_FOLDS}, c AS (SELECT fold, n - 2 * 2 - 3 + fold * 2 AS b FROM k, (SELECT max(n) AS n FROM t)), l AS (SELECT fold, unique_id, arg_max(y, ds) AS y_hat FROM daily JOIN t USING (ds), c WHERE i < b GROUP BY 1, 2) SELECT c.fold, 'mae' AS metric, round(avg(abs(y - y_hat)), 6) AS score FROM daily JOIN t USING (ds), c JOIN l ON l.fold = c.fold WHERE l.unique_id = daily.unique_id AND i >= b AND i < b + 3 GROUP BY 1")
def backtest_naive(spark, d):
    daily = daily_events(spark, d)
    got = validation.backtest(Naive(), validation.expanding_window_cv(daily, 3, 3, 2), {"mae": metrics.mae})
    return rounded(got["fold_scores"])


# -- similarity ------------------------------------------------------------


def all_vectors(spark, d):
    """Every vector with every component, whatever its label. A dynamic program over
    all pairs of them is too slow in SQL: the queries on them have none and are held
    against brute force on a fixture."""
    return labelled_vectors(spark, d).select("unique_id", "series")


def _distance(method: str, **options):
    def run(spark, d):
        v = all_vectors(spark, d)
        m, o = similarity._kernel(method, options)
        return rounded(similarity.pair_distances(v, v, method, m, o))

    return run


_DISTANCES = {"dtw": {}, "frechet": {}, "sakoe_chiba": {"window": 3}, "wdtw": {}, "erp": {}, "edr": {}, "lcss": {"epsilon": 0.05}, "twe": {}, "sbd": {}, "msm": {}, "ddtw": {}, "itakura": {}, "fast_dtw": {"radius": 2}}
for _m, _o in _DISTANCES.items():
    query(f"dist_{_m}")(_distance(_m, **_o))


# -- reconciliation --------------------------------------------------------

_NAT = "nat AS (SELECT n_name, r_name, date_trunc('month', o_orderdate)::TIMESTAMP AS ds, sum(o_totalprice) AS y FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3)"


def _hierarchy(spark, d) -> dict[str, str]:
    """nation -> region -> Total; as many entries as nations and regions."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    rows = n.join(r, n.n_regionkey == r.r_regionkey).select("n_name", "r_name").collect()
    return {x.n_name: x.r_name for x in rows} | {x.r_name: "Total" for x in rows}


@query("reconcile_bottom_up", f"WITH {_NAT} SELECT coalesce(n_name, r_name, 'Total') AS unique_id, ds, round(sum(y), 2) AS y_hat FROM nat GROUP BY GROUPING SETS ((n_name, ds), (r_name, ds), (ds))")
def reconcile_bottom_up(spark, d):
    return rounded(reconcile.reconcile(nation_orders(spark, d), _hierarchy(spark, d)), 2)


def _incoherent(spark, d):
    """Nation totals, with inner nodes 10 % above the sums of their leaves."""
    leaves = nation_orders(spark, d)
    nodes = reconcile.bottom_up(leaves, _hierarchy(spark, d), ["y_hat"])
    inner = nodes.join(leaves.select("unique_id").distinct(), "unique_id", "left_anti").withColumn("y_hat", F.col("y_hat") * 1.1)
    return leaves.unionByName(inner)


_SHARE = "tot AS (SELECT n_name, r_name, sum(y) AS s FROM nat GROUP BY 1, 2)"


@query("reconcile_top_down", f"WITH {_NAT}, {_SHARE}, top AS (SELECT ds, 1.1 * sum(y) AS t FROM nat GROUP BY 1), leaf AS (SELECT n_name, r_name, ds, t * s / (SELECT sum(s) FROM tot) AS y FROM tot, top) SELECT coalesce(n_name, r_name, 'Total') AS unique_id, ds, round(sum(y), 0) AS y_hat FROM leaf GROUP BY GROUPING SETS ((n_name, ds), (r_name, ds), (ds))")
def reconcile_top_down(spark, d):
    return rounded(reconcile.reconcile(_incoherent(spark, d), _hierarchy(spark, d), "top_down"), 0)


@query("reconcile_middle_out", f"WITH {_NAT}, {_SHARE}, mid AS (SELECT r_name, ds, 1.1 * sum(y) AS t FROM nat GROUP BY 1, 2), leaf AS (SELECT n_name, r_name, ds, t * s / sum(s) OVER (PARTITION BY r_name, ds) AS y FROM tot JOIN mid USING (r_name)) SELECT coalesce(n_name, r_name, 'Total') AS unique_id, ds, round(sum(y), 0) AS y_hat FROM leaf GROUP BY GROUPING SETS ((n_name, ds), (r_name, ds), (ds))")
def reconcile_middle_out(spark, d):
    h = _hierarchy(spark, d)
    return rounded(reconcile.reconcile(_incoherent(spark, d), h, "middle_out", middle_level=sorted(c for c, p in h.items() if p == "Total")), 0)



# -- scores, neighbours and rules ------------------------------------------

def _score_inputs(spark, d) -> tuple[DataFrame, DataFrame]:
    """Sums over the pairs of all vectors, and a fixed grouping of them."""
    v = all_vectors(spark, d)
    labels = v.select("unique_id", (F.col("unique_id") % 3).alias("cluster"))
    return similarity.cluster_sums(v, labels, "sbd"), labels


@query("silhouette")
def silhouette(spark, d):
    return rounded(similarity.silhouette_from_sums(*_score_inputs(spark, d)))


@query("cluster_medoids")
def cluster_medoids(spark, d):
    return rounded(similarity.medoids_from_sums(*_score_inputs(spark, d)))


@query("nearest_neighbours")
def nearest_neighbours(spark, d):
    return rounded(similarity.nearest_series(all_vectors(spark, d), 3, "sbd"))


@query("promotion_lift", "SELECT l_returnflag AS unique_id, round(avg(l_quantity) FILTER (WHERE l_discount > 0.05) / avg(l_quantity) FILTER (WHERE l_discount <= 0.05) - 1, 6) + 0.0 AS lift FROM lineitem GROUP BY 1")
def promotion(spark, d):
    from tidepanel.operators.agents import promotion_lift

    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("unique_id"), F.col("l_quantity").alias("y"), (F.col("l_discount") > 0.05).alias("promo"))
    return rounded(promotion_lift(rows))


@query("inventory_reorder", "WITH s AS (SELECT l_partkey AS unique_id, avg(l_quantity) AS mean, coalesce(stddev_samp(l_quantity), 0) AS std, CAST(max(p_size) AS DOUBLE) AS stock FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) SELECT unique_id, round(mean, 6) AS mean, round(std, 6) AS std, stock, round(mean * 2, 6) AS lead_demand, round(std * 1.65 * sqrt(2), 6) AS safety_stock, round(greatest(mean * 2 + std * 1.65 * sqrt(2) - stock, 0), 6) AS order_quantity, stock < mean * 2 AS stock_out FROM s")
def inventory_reorder(spark, d):
    from tidepanel.operators.agents import reorder

    l, p = table(spark, d, "lineitem"), table(spark, d, "part")
    rows = l.join(p, l.l_partkey == p.p_partkey).groupBy(F.col("l_partkey").alias("unique_id")).agg(F.avg("l_quantity").alias("mean"), F.coalesce(F.stddev_samp("l_quantity"), F.lit(0.0)).alias("std"), F.max("p_size").cast("double").alias("stock"))
    return rounded(reorder(rows, "mean", "std", "stock", 2))


@query("health_index", f"WITH {DAILY}, n AS (SELECT *, row_number() OVER ({W}) AS i FROM daily), b AS (SELECT unique_id, avg(y) AS b FROM n WHERE i <= 5 GROUP BY 1) SELECT unique_id, ds, round(y, 6) AS y, round(greatest(0, least(1, 1 - (y / b - 1) / 2)), 6) AS health FROM n JOIN b USING (unique_id)")
def health(spark, d):
    from tidepanel.operators.agents import health_index

    return rounded(health_index(daily_events(spark, d), "y"))


@query("log_returns", f"WITH {DAILY} SELECT unique_id, ds, round(y, 6) AS y, round(ln(y) - ln(lag(y) OVER ({W})), 6) + 0.0 AS ret FROM daily")
def returns(spark, d):
    from tidepanel.operators.agents import log_returns

    return rounded(log_returns(daily_events(spark, d)))


# -- operators without a SQL form ------------------------------------------
# They run over whole tables here; tests hold some against brute force or invariants.


def _later(name: str, fn: Query) -> None:
    QUERIES[name] = fn


def _vectors(spark, d) -> DataFrame:
    return all_vectors(spark, d)


def _register() -> None:
    from tidepanel.operators import agents, bayes, changepoint, clustering, convolution, imaging, ml
    from tidepanel.streaming import state

    day = daily_events
    from datetime import datetime

    when = datetime(2024, 1, 22)
    q = {
        "rocket_features": lambda s, d: rounded(convolution.rocket_features(day(s, d), 50)),
        "minirocket_features": lambda s, d: rounded(convolution.minirocket_features(day(s, d), 84)),
        "isolation_forest": lambda s, d: rounded(changepoint.isolation_forest_detect(day(s, d), ["y"])),
        "recursive_forecast": lambda s, d: rounded(ml.RecursiveForecaster(None, [1, 2, 7]).fit(day(s, d)).predict(day(s, d), 7), 3),
        "direct_forecast": lambda s, d: rounded(ml.DirectForecaster(None, [1, 2, 7], 3).fit(day(s, d)).predict(day(s, d)), 3),
        "forecast_pipeline": lambda s, d: rounded(ml.ForecastPipeline(None, [1, 7], rolling_windows=[3], calendar=["day_of_week"], fourier=[(7.0, 1)], target_transform="log").fit(day(s, d)).predict(day(s, d), 7), 3),
        "global_forecast": lambda s, d: rounded(ml.GlobalForecaster(None, [1, 7], encode_id="onehot", target_transform="difference").fit(day(s, d)).predict(day(s, d), 7), 3),
        "quantile_forecast": lambda s, d: rounded(ml.QuantileRegressor(ml.PinballRegressor, [0.1, 0.5, 0.9], [1, 7]).fit(day(s, d)).predict(day(s, d), 3), 3),
        "enbpi_forecast": lambda s, d: rounded(ml.EnbPI(None, 10, [1, 7]).fit(day(s, d)).predict(day(s, d), 3), 3),
        "garch": lambda s, d: rounded(changepoint.garch_forecast(changepoint.garch_fit(day(s, d), max_iter=40), 5), 2),
        "granger_causality": lambda s, d: rounded(changepoint.granger_causality(_wide(s, d), "click", "view", 3) if {"click", "view"} <= set(_wide(s, d).columns) else changepoint.granger_causality(_wide(s, d), *_wide(s, d).columns[1:3], 3)),
        "var_forecast": lambda s, d: rounded(changepoint.var_forecast(changepoint.var_fit(_wide(s, d), _wide(s, d).columns[1:], 2), 5, s), 3),
        "bayesian_var": lambda s, d: rounded(bayes.bayesian_var(_wide(s, d), _wide(s, d).columns[1:], 5, n_samples=200), 2),
        "pelt": lambda s, d: changepoint.pelt(day(s, d), penalty=1e6),
        "bocpd": lambda s, d: rounded(changepoint.bocpd(day(s, d))),
        "regime_detect": lambda s, d: rounded(changepoint.regime_detect(day(s, d)), 3),
        "bayesian_anomaly": lambda s, d: rounded(changepoint.bayesian_anomaly_score(day(s, d))),
        "kmedoids": lambda s, d: clustering.kmedoids(_vectors(s, d), 3),
        "clara": lambda s, d: clustering.clara(_vectors(s, d), 3, sample_size=20),
        "clarans": lambda s, d: clustering.clarans(_vectors(s, d), 3),
        "agglomerative": lambda s, d: clustering.agglomerative_cluster(_vectors(s, d), n_clusters=3),
        "dbscan": lambda s, d: clustering.dbscan_cluster(_vectors(s, d), eps=1.0, min_samples=3),
        "hdbscan": lambda s, d: clustering.hdbscan_cluster(_vectors(s, d), min_cluster_size=3),
        "spectral_cluster": lambda s, d: clustering.spectral_cluster(_vectors(s, d), 3),
        "kshape": lambda s, d: clustering.KShape(3).fit(_vectors(s, d)).labels_,
        "kmeans_dba": lambda s, d: clustering.kmeans_dba(_vectors(s, d), 2, max_iter=3),
        "kasba": lambda s, d: clustering.kasba(_vectors(s, d), 3, max_iter=2),
        "shapelet_cluster": lambda s, d: clustering.shapelet_cluster(_vectors(s, d), 3, n_candidates=20),
        "auto_cluster": lambda s, d: rounded(clustering.auto_cluster(_vectors(s, d), distances_=["sbd"], k_range=[2, 3]).results_table),
        "to_gasf": lambda s, d: _cells(imaging.to_gasf(day(s, d)), "gasf"),
        "to_gadf": lambda s, d: _cells(imaging.to_gadf(day(s, d)), "gadf"),
        "bsts_forecast": lambda s, d: rounded(bayes.bsts_forecast(day(s, d), 7, seasonal=7), 3),
        "particle_filter": lambda s, d: rounded(bayes.particle_filter(day(s, d), n_particles=200), 3),
        "gp_forecast": lambda s, d: rounded(bayes.gp_forecast(day(s, d), 3), 3),
        "mcmc_forecast": lambda s, d: rounded(bayes.mcmc_forecast(day(s, d), 3, "ar", n_samples=200, burn_in=100), 3),
        "bayesian_ets": lambda s, d: rounded(bayes.bayesian_ets(day(s, d), 3), 3),
        "causal_impact": lambda s, d: rounded(bayes.causal_impact(day(s, d), when), 3),
        "synthetic_control": lambda s, d: rounded(bayes.synthetic_control(day(s, d), "click", when), 3),
        "streaming_ets": lambda s, d: rounded(state.StreamingETS("holt").fit(day(s, d).filter(F.col("ds") < F.lit(when))).partial_fit(day(s, d).filter(F.col("ds") >= F.lit(when))).predict(14)),
        "event_windows": lambda s, d: rounded(state.event_time_windows(table(s, d, "events").select(F.col("event_type").alias("unique_id"), F.col("ts").alias("ds"), F.col("value").alias("y")), "1 day")).select("unique_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("stop"), "sum", "n"),
        "anomaly_consensus": lambda s, d: _votes(s, d),
        "portfolio": lambda s, d: rounded(agents.MARLOrchestrator(5).run_from_dataframe(day(s, d)).weights),
        "supply_chain": lambda s, d: rounded(agents.SupplyChainOrchestrator().run(day(s, d))["reorder"]),
        "scientist": lambda s, d: rounded(agents.TimeSeriesScientist(3).run(day(s, d)).predictions, 3),
    }
    for name, fn in q.items():
        _later(name, fn)
    ORACLES["streaming_ets"] = _HOLT
    ORACLES["anomaly_consensus"] = f"""WITH {USERS}, {_U}, c AS (SELECT *, list(y) OVER f AS c, count(*) OVER f AS n, avg(y) OVER f AS m, median(y) OVER f AS q, stddev_pop(y) OVER f AS s FROM u WINDOW f AS ({W} ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING)),
z AS (SELECT unique_id, ds, y, abs(y - m) / (s + 1e-10) AS z, abs(y - q) / (s + 1e-10) AS r, 0.6745 * abs(y - q) / (list_median(list_transform(c, lambda x: abs(x - q))) + 1e-10) AS k FROM c WHERE n = 9)
SELECT unique_id, ds, round(y, 6) AS y, round(z, 4) AS zscore_score, z > 3 AS zscore_vote, round(r, 4) AS rolling_std_score, r > 3 AS rolling_std_vote, round(k, 4) AS mad_score, k > 3.5 AS mad_vote, (z > 3)::INT + (r > 3)::INT + (k > 3.5)::INT >= 2 AS is_anomaly FROM z"""
    ORACLES["event_windows"] = "SELECT event_type AS unique_id, date_trunc('day', ts)::TIMESTAMP AS start, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS stop, round(sum(value), 6) AS sum, count(value) AS n FROM events GROUP BY 1, 2, 3"


def _cells(images: DataFrame, name: str) -> DataFrame:
    """Every cell of the images of a panel."""
    rows = images.select("unique_id", F.posexplode(name).alias("i", "row"))
    return rounded(rows.select("unique_id", "i", F.posexplode("row").alias("j", name)), 5)


_ANGLES = f"WITH {DAILY}, x AS (SELECT unique_id, row_number() OVER ({W}) - 1 AS i, acos(greatest(-1, least(1, 2 * (y - min(y) OVER p) / (max(y) OVER p - min(y) OVER p) - 1))) AS phi FROM daily WINDOW p AS (PARTITION BY unique_id))"
for _n, _f in (("gasf", "cos(a.phi + b.phi)"), ("gadf", "sin(a.phi - b.phi)")):
    ORACLES[f"to_{_n}"] = f"{_ANGLES} SELECT a.unique_id, a.i, b.i AS j, round({_f}, 5) + 0.0 AS {_n} FROM x a JOIN x b ON a.unique_id = b.unique_id"


def _votes(spark, d) -> DataFrame:
    from tidepanel.operators.agents import anomaly_votes

    rows = anomaly_votes(_values(spark, d), 10)
    scores = [c for c in rows.columns if c.endswith("_score")]
    return rows.select("unique_id", "ds", F.round("y", 6).alias("y"), *[F.round(c, 4).alias(c) for c in scores], *[c for c in rows.columns if c.endswith("_vote")], "is_anomaly")


def _wide(spark, d) -> DataFrame:
    return daily_events(spark, d).groupBy("ds").pivot("unique_id").agg(F.first("y")).na.fill(0.0)


_register()

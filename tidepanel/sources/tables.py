"""Panels derived from relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sums of ``value`` per event type."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("unique_id"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ds")).agg(F.sum("value").alias("y"))


def monthly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly order totals per priority."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("unique_id"), F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("ds")).agg(F.sum("o_totalprice").alias("y"))


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per user over (time, event), every seventh event without a value."""
    e = table(spark, sf_dir, "events")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("unique_id"), rank.cast("long").alias("ds"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("y"), "value")


def labelled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as series: unique_id, series (all components), label."""
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.col("vec_id").alias("unique_id"), F.col("embedding").cast("array<double>").alias("series"), F.col("label").cast("long").alias("label"))


def nation_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly order totals per nation name (leaves of the hierarchy)."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    return rows.groupBy(F.col("n_name").alias("unique_id"), F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("ds")).agg(F.sum("o_totalprice").alias("y_hat"))

"""The driver's star tables as journal, catalogues and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, channel_id, event_time, alarm, value_numeric, value_state, props."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("channel_id"), F.col("ts").cast("timestamp_ntz").alias("event_time"), (F.col("event_type") == "error").alias("alarm"), F.col("value").alias("value_numeric"), F.col("event_type").alias("value_state"), "props")


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """channel_id, sensor_type, sensor_name, object_id."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("channel_id"), F.col("c_mktsegment").alias("sensor_type"), F.col("c_name").alias("sensor_name"), F.col("c_nationkey").alias("object_id"))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """object_id, object_name, parent_id."""
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("object_id"), F.col("n_name").alias("object_name"), F.col("n_regionkey").alias("parent_id"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_id, channel_id, status, priority, created_at."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("channel_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"))


#: The same tables as SQL, for oracles.
SQL = """
journal AS (SELECT event_id, user_id AS channel_id, CAST(ts AS TIMESTAMP) AS event_time, event_type = 'error' AS alarm, value AS value_numeric, event_type AS value_state, props FROM events),
channels AS (SELECT c_custkey AS channel_id, c_mktsegment AS sensor_type, c_name AS sensor_name, c_nationkey AS object_id FROM customer),
objects AS (SELECT n_nationkey AS object_id, n_name AS object_name, n_regionkey AS parent_id FROM nation),
requests AS (SELECT o_orderkey AS request_id, o_custkey AS channel_id, o_orderstatus AS status, o_orderpriority AS priority, CAST(o_orderdate AS TIMESTAMP) AS created_at FROM orders)
"""

"""The tables of a test-data folder seen as readings, formulas and scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/events.parquet")


def as_readings(events: DataFrame) -> DataFrame:
    """Events as readings of five nodes, one per event type."""
    return events.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("ns=2;s=Line1."), "event_type").alias("node_id"),
        "value",
        F.col("ts").alias("timestamp"),
        F.lit("Good").alias("quality"),
        F.col("ts").alias("created_on"),
    )


def readings(spark: SparkSession, folder: str) -> DataFrame:
    return as_readings(events(spark, folder))


def user_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Events as readings of one node per user and event type."""
    return events(spark, folder).select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("ns=2;s=User"), "user_id", F.lit("."), "event_type").alias("node_id"),
        "value",
        F.col("ts").alias("timestamp"),
    )


def customer_variables(spark: SparkSession, folder: str) -> DataFrame:
    """A large formula table: one variable per customer.

    The key chooses the form of the formula, the nation the window length, the
    balance whether the variable is deleted.
    """
    key = "c_custkey"
    user = f"'[ns=2;s=User' || (1 + {key} % 1500)"
    return spark.read.parquet(f"{folder}/customer.parquet").selectExpr(
        f"bigint({key}) AS variable_id",
        "c_name AS variable_name",
        f"""CASE {key} % 7
            WHEN 0 THEN NULL
            WHEN 1 THEN ''
            WHEN 2 THEN {user} || '.click] * 0.001'
            WHEN 3 THEN 'AVG(' || {user} || '.view] + ' || {user} || '.click])'
            WHEN 4 THEN {user} || '.view] / ' || {user} || '.click] + ' || {user} || '.view]'
            WHEN 5 THEN '1 + 1'
            ELSE 'IF (' || {user} || '.error] > 100) THEN 1 ELSE 0' END AS pre_save_formula""",
        "CASE c_nationkey % 4 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN 'SINGLE' ELSE 'PAIR' END"
        " AS formula_type",
        "CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE int(c_nationkey) * 60 END AS time",
        f"CASE WHEN {key} % 3 <> 0 THEN timestamp_seconds("
        f"unix_timestamp(timestamp'2023-12-31 00:00:00') + {key} % 1500 * 60) END AS time_interval",
        "c_acctbal < 0 AS is_deleted",
    )

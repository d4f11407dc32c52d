"""Latest value per node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.sources.readings import number_column


def latest_values(readings: DataFrame) -> DataFrame:
    """The value of the highest id per node, as (node_id, id, value).

    A node whose latest value is not a number is left out; it does not fall
    back to an older reading. The value is cast before the aggregation so that
    its buffer is fixed width, and partial aggregation leaves one row per node
    and task to shuffle.
    """
    return latest_state(readings).filter(F.col("value").isNotNull())


def latest_state(readings: DataFrame) -> DataFrame:
    """As :func:`latest_values`, but keeping nodes whose latest value is unusable.

    This is the form to carry between batches: a bad value must hide the older
    good one.
    """
    typed = readings.filter(F.col("node_id").isNotNull()).select(
        "node_id", "id", number_column(readings).alias("value")
    )
    return typed.groupBy("node_id").agg(
        F.max("id").alias("id"), F.max_by("value", "id").alias("value")
    )

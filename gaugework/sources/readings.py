"""Readings: numeric coercion, incremental scan and start offset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The text forms of a number that a reading may carry.
NUMBER_TEXT = (
    r"^\s*[+-]?(((\d+(_\d+)*)(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?"
    r"|(?i:nan|inf|infinity))\s*$"
)


def number_column(df: DataFrame, name: str = "value") -> Column:
    """The column as double; text that is not a number becomes NULL."""
    kind = df.schema[name].dataType
    column = F.col(name)
    if not isinstance(kind, T.StringType):
        return column.cast("double")
    digits = F.regexp_replace(column, "_", "")
    return F.when(column.rlike(NUMBER_TEXT), digits.try_cast("double"))


def input_error(df: DataFrame, number: Column, name: str = "value") -> Column:
    """Error code of a triggering value, NULL when it is a finite number."""
    checks = F.when(F.col(name).isNull(), F.lit("NULL_VALUE"))
    if isinstance(df.schema[name].dataType, T.StringType):
        checks = checks.when(number.isNull(), F.lit("INVALID_TYPE"))
    return checks.when(F.isnan(number), F.lit("NAN_VALUE")).when(
        F.abs(number) == F.lit(float("inf")), F.lit("INFINITE_VALUE")
    )


def new_readings(readings: DataFrame, after_id: int, limit: int) -> DataFrame:
    """The first ``limit`` readings with an id above ``after_id``, in id order."""
    return readings.filter(F.col("id") > after_id).orderBy("id").limit(limit)


def start_offset(
    state: DataFrame, readings: DataFrame, service_name: str = "gaugework"
) -> DataFrame:
    """One row: the stored high-water mark, or the highest id when none is stored.

    A stored 0 counts as not stored, so a new service starts from the newest
    reading instead of the whole history. The readings are only scanned without a mark.
    """
    spark = state.sparkSession
    mark = state.filter(F.col("service_name") == service_name).agg(F.max("last_processed_id")).first()[0]
    if mark:
        return spark.range(1).select(F.lit(mark).cast("long").alias("last_processed_id"))
    # Alone, so that the scan can answer it from the files' statistics where that is enabled.
    return readings.agg(F.max("id").alias("id")).select(
        F.coalesce(F.col("id").cast("long"), F.lit(0)).alias("last_processed_id")
    )

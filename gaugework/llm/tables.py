"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the white space that separates words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a few numbers up to which Spark may broadcast a table: some 10 MB.
BROADCAST_ROWS = 100_000


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def unsent(table: DataFrame) -> DataFrame:
    """``table`` for a join that shuffles and sorts, so that neither side passes through the driver.

    For tables that grow with the input, as Spark goes by the size of files and takes rows
    that an explode or an aggregation makes of them for few.
    """
    return table.hint("merge")


def unsent_if_large(table: DataFrame) -> DataFrame:
    """Stored ``table`` of a few numbers a row: left to Spark if it is counted to be small."""
    return unsent(table) if table.count() > BROADCAST_ROWS else table


def per_batch(
    function: Callable[[pa.RecordBatch], pa.RecordBatch],
) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``function`` for ``mapInArrow``."""

    def run(batches):
        for batch in batches:
            yield function(batch)

    return run


def running_base(df: DataFrame, keys: list[str], order: list[str], amount: str, name: str) -> DataFrame:
    """``df`` with the sum of ``amount`` over the rows before, within ``keys``.

    For tables of a few rows per task, never for documents.
    """
    from pyspark.sql import Window

    window = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(amount).over(before), F.lit(0)).cast("long"))

"""Positions of rows within ordered groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugework.session import stored

# A group up to this size is numbered by one task; its sort fits or spills there.
ROWS_PER_TASK = 2_000_000


def with_positions(
    rows: DataFrame, keys: list[str], order: list[str], rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """``rows`` with ``position``, counted from 0 in ``order`` within ``keys``.

    Groups are measured once, by a partial aggregation that reads the key columns
    only. A plain ``row_number`` numbers all but the large ones, which are cut into
    ranges, so that no task gets a whole hot group. There are fewer of those than
    rows / ``rows_per_task``, so their keys are broadcast.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    large = stored(sizes.filter(F.col("n") > rows_per_task).select(*keys), "large")
    ordered = Window.partitionBy(*keys).orderBy(*order)
    position = F.row_number().over(ordered).cast("long") - 1
    if large.isEmpty():
        return rows.withColumn("position", position)
    others = rows.join(F.broadcast(large), keys, "left_anti").withColumn("position", position)
    hot = rows.join(F.broadcast(large), keys, "left_semi")
    return others.select(*rows.columns, "position").unionByName(positions_by_range(hot, keys, order))


def positions_by_range(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Positions by range partitioning; ``keys`` and ``order`` together are unique.

    Rows are range partitioned and sorted, so a group lies in consecutive
    partitions. A row's position is its place among the group's rows in its own
    partition plus the number of the group's rows in earlier ones. The sorted
    rows are stored once, because both steps must see the same partitions even
    if a lost executor makes Spark recompute. What is joined is one row per
    group and partition.
    """
    numbered = (
        rows.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    numbered = stored(numbered, "positions").withColumn("_range", F.shiftright("_row", 33))
    pieces = numbered.groupBy(*keys, "_range").agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    return (
        numbered.join(pieces.drop("_rows"), [*keys, "_range"])
        .withColumn("position", F.col("_row") - F.col("_first") + F.col("_before"))
        .select(*rows.columns, "position")
    )

"""Reports over readings, executions and failures."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.sources.readings import number_column

# Page sizes.
RAW_LIMIT = 20
EXECUTIONS_LIMIT = 100
BATCH_READINGS = 200


def with_text_times(table: DataFrame, *names: str) -> DataFrame:
    """Times as text of fixed width, for the edge where a report leaves Spark."""
    return table.withColumns(
        {name: F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS") for name in names}
    )


def raw_data_latest(readings: DataFrame, limit: int = RAW_LIMIT) -> DataFrame:
    """The newest readings by id, with the last part of the node id as alias."""
    newest = readings.orderBy(F.col("id").desc()).limit(limit)
    return newest.select(
        "id",
        "node_id",
        F.coalesce(F.element_at(F.split("node_id", "[.]"), -1), F.lit("")).alias("alias"),
        number_column(newest).alias("value"),
        "timestamp",
        "quality",
    )


def raw_data_stats(readings: DataFrame, as_of: datetime | str) -> DataFrame:
    """One row: readings of the second up to ``as_of``, both ends included, and distinct nodes.

    Nodes are counted over the distinct node ids, which a partial aggregation
    reduces to one row per node and task before the shuffle.
    """
    kind = readings.schema["timestamp"].dataType
    until = F.lit(as_of).cast("timestamp")
    since = (until - F.expr("INTERVAL 1 SECOND")).cast(kind)
    return (
        readings.groupBy("node_id")
        .agg(F.count_if(F.col("timestamp").between(since, until.cast(kind))).alias("recent"))
        .agg(
            F.coalesce(F.sum("recent"), F.lit(0)).alias("tags_per_second"),
            F.count("node_id").alias("distinct_nodes"),
        )
    )


def split_outcomes(outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Successes and failures of an evaluation. Persist it first to use both."""
    return outcomes.filter("error is null"), outcomes.filter("error is not null")


def all_executions(
    continuous: DataFrame, windowed: DataFrame, processed_on: datetime | str
) -> DataFrame:
    """Continuous and windowed outcomes as one set of executions.

    A continuous outcome carries its reading's id and device time; a windowed
    one carries its window's end and counts as of the moment of processing.
    """
    now = F.lit(processed_on).cast("timestamp")
    first = continuous.select(
        "variable_id",
        "tag_id",
        "result",
        "error",
        F.col("result_on").cast("timestamp").alias("result_on"),
        F.lit(None).cast("timestamp").alias("window_end"),
    )
    second = windowed.select(
        "variable_id",
        F.lit(None).cast("long").alias("tag_id"),
        "result",
        "error",
        now.alias("result_on"),
        "window_end",
    )
    return first.unionByName(second).withColumns(
        {"processed_on": now, "created_by": F.lit("system"), "is_deleted": F.lit(False)}
    )


def executions_latest(
    executions: DataFrame,
    variables: DataFrame,
    limit: int = EXECUTIONS_LIMIT,
    alias: str | None = None,
) -> DataFrame:
    """The newest executions with the names of their variables.

    Without a name prefix the top rows are taken before the join, which then
    sees ``limit`` rows only. With one, executions of other variables are
    filtered by a semi join first. Ties on the creation time are broken by
    variable, reading and window, so the result is the same on every run.
    """
    kept = executions.filter(~F.col("is_deleted"))
    names = variables.select(
        "variable_id", "variable_name", F.col("pre_save_formula").alias("formula")
    )
    if alias:
        names = names.filter(F.col("variable_name").startswith(alias))
        kept = kept.join(names.select("variable_id"), "variable_id", "left_semi")
    order = [F.col("created_on").desc(), "variable_id", "tag_id", "window_end"]
    return (
        kept.orderBy(*order)
        .limit(limit)
        .join(names, "variable_id", "left")
        .select(
            "variable_id",
            "variable_name",
            "formula",
            "tag_id",
            "result",
            "result_on",
            "processed_on",
            "window_end",
            "created_on",
        )
        .orderBy(*order)
    )


def executions_summary(variables: DataFrame, executions: DataFrame) -> DataFrame:
    """Executions per SINGLE variable, variables that never ran included.

    Executions are reduced to one row per variable before the join, so neither a
    hot variable nor the number of executions matters to it. ``max_result`` is
    the highest result, not the newest one.
    """
    totals = (
        executions.filter(~F.col("is_deleted"))
        .groupBy("variable_id")
        .agg(
            F.count(F.lit(1)).alias("_runs"),
            F.max("processed_on").alias("_processed"),
            F.max("result").alias("_result"),
        )
    )
    return (
        variables.filter(~F.col("is_deleted") & (F.col("formula_type") == "SINGLE"))
        .join(totals, "variable_id", "left")
        .groupBy(
            "variable_name",
            F.col("pre_save_formula").alias("formula"),
            F.col("time").alias("current_interval"),
        )
        .agg(
            F.coalesce(F.sum("_runs"), F.lit(0)).alias("total_executions"),
            F.max("_processed").alias("last_processed_on"),
            F.max("_result").alias("max_result"),
        )
        .orderBy("variable_name")
    )


def batch_stats(executions: DataFrame, failures: DataFrame, readings: DataFrame) -> DataFrame:
    """Readings, successes and failures per ``batch_id``.

    Each table is counted on its own; only counts meet.
    """

    def counted(table: DataFrame, name: str) -> DataFrame:
        zeros = [F.lit(0).cast("long").alias(other) for other in names if other != name]
        return table.groupBy("batch_id").agg(F.count(F.lit(1)).alias(name)).select(
            "batch_id", name, *zeros
        )

    names = ("readings", "successes", "failures")
    union = (
        counted(readings, "readings")
        .unionByName(counted(executions, "successes"))
        .unionByName(counted(failures, "failures"))
    )
    return union.groupBy("batch_id").agg(*(F.sum(name).alias(name) for name in names))

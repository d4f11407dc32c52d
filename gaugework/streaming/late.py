"""Readings that came after their window had fired.

Each batch's line in the log has the last id that the stream had processed, and a window's outcome
has its batch. A reading inside a window, both ends included, whose id is larger than
that of the batch in which the window fired is late: the outcome stands without it. What
is late is a question to tables that are there anyway, so it can be asked at any time, and
windows with late readings can be evaluated anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.operators.formulas import FormulaSet, as_formula_set
from gaugework.operators.windows import evaluate_windows, window_readings
from gaugework.sources.results import batches, fired_outcomes


def fired_windows(spark: SparkSession, out_path: str) -> DataFrame:
    """(variable_id, window_end, batch_id, high_id, result, error) of every window that has fired."""
    marks = batches(spark, out_path).select("batch_id", F.col("last_processed_id").alias("high_id"))
    return fired_outcomes(spark, out_path).join(marks, "batch_id")


def _fired_schedule(formulas: FormulaSet, fired: DataFrame) -> DataFrame:
    """One row per formula and grid of windows, from its first fired window to its last."""
    table = formulas.table.select("variable_id", "minutes").filter("minutes > 0")
    ends = fired.join(formulas.hint(table), "variable_id")
    grid = F.pmod(F.unix_micros("window_end"), F.col("minutes").cast("long") * 60_000_000)
    return ends.groupBy("variable_id", "minutes", grid.alias("_on")).agg(
        F.min("window_end").alias("first_end"), F.max("window_end").alias("last_end")
    ).drop("_on")


def late_readings(
    spark: SparkSession, out_path: str, readings: DataFrame, formulas: FormulaSet | DataFrame
) -> DataFrame:
    """(variable_id, node_id, window_start, window_end, id, value, high_id) of each late reading and window.

    ``high_id`` is the last id processed when the window fired. A reading on the edge of two
    windows may be late for either. Readings that are no numbers are in no window, so they are not late.
    """
    formulas = as_formula_set(formulas)
    fired = fired_windows(spark, out_path).select("variable_id", "window_end", "high_id")
    # No reading up to the lowest of the marks can be late.
    least = fired.agg(F.min("high_id")).first()[0]
    rows = readings.filter(F.col("id") > F.lit(least).cast("long"))
    inside = window_readings(rows, formulas, _fired_schedule(formulas, fired))
    return inside.join(fired, ["variable_id", "window_end"]).filter("id > high_id").select(
        "variable_id", "node_id", "window_start", "window_end", "id", "value", "high_id"
    )


def late_counts(late: DataFrame) -> DataFrame:
    """(variable_id, window_end, late, first_late_id) of each window with late readings."""
    return late.groupBy("variable_id", "window_end").agg(
        F.count(F.lit(1)).alias("late"), F.min("id").alias("first_late_id")
    )


def corrected_windows(
    spark: SparkSession, out_path: str, readings: DataFrame, formulas: FormulaSet | DataFrame
) -> DataFrame:
    """(variable_id, window_start, window_end, result, error, fired_result, fired_error, late).

    Windows with late readings, evaluated over all of their readings as they are now, beside what
    they fired with.
    """
    formulas = as_formula_set(formulas)
    counts = late_counts(late_readings(spark, out_path, readings, formulas))
    fired = fired_windows(spark, out_path).select(
        "variable_id", "window_end", F.col("result").alias("fired_result"), F.col("error").alias("fired_error")
    )
    minutes = formulas.table.select("variable_id", "minutes")
    end = F.col("window_end")
    schedule = counts.join(formulas.hint(minutes), "variable_id").select(
        "variable_id", "minutes", end.alias("first_end"), end.alias("last_end")
    )
    made = evaluate_windows(readings, formulas, schedule)
    keys = ["variable_id", "window_end"]
    return made.join(fired, keys).join(counts.select(*keys, "late"), keys).select(
        "variable_id", "window_start", "window_end", "result", "error", "fired_result", "fired_error", "late"
    )

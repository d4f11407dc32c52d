"""The formula table: active formulas, their nodes, lists and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: a node reference is any text between square brackets.
NODE_REFERENCE = r"\[([^\]]+)\]"


def _kept(variables: DataFrame) -> DataFrame:
    formula = F.col("pre_save_formula")
    return variables.filter(~F.col("is_deleted") & formula.isNotNull() & (F.rtrim(formula) != ""))


def active_formulas(variables: DataFrame) -> DataFrame:
    """Formulas that are neither deleted nor empty, with defaults filled in."""
    minutes = F.coalesce(F.col("time"), F.lit(0))
    blank_type = F.col("formula_type").isNull() | (F.col("formula_type") == "")
    return _kept(variables).select(
        "variable_id",
        F.col("pre_save_formula").alias("formula"),
        F.when(blank_type, "SINGLE").otherwise(F.col("formula_type")).alias("formula_type"),
        minutes.alias("minutes"),
        "time_interval",
        (minutes > 0).alias("is_windowed"),
    )


def formula_nodes(variables: DataFrame) -> DataFrame:
    """One row per active formula and distinct node, ``pos`` by first mention."""
    mentions = F.regexp_extract_all("formula", F.lit(NODE_REFERENCE), F.lit(1))
    return active_formulas(variables).select(
        "variable_id", F.posexplode(F.array_distinct(mentions)).alias("pos", "node_id")
    )


def formula_list(variables: DataFrame) -> DataFrame:
    """Active formulas by name, with the type as stored."""
    return (
        _kept(variables)
        .select(
            "variable_id",
            "variable_name",
            F.col("pre_save_formula").alias("formula"),
            "formula_type",
            F.col("time").alias("interval"),
        )
        .orderBy("variable_name")
    )


def formula_counts(variables: DataFrame) -> DataFrame:
    """One row: loaded formulas by evaluation list.

    Every active formula is on the single list, whatever its stored type; the
    pair list exists in the result but is always empty.
    """
    return active_formulas(variables).agg(
        F.count(F.lit(1)).alias("single"),
        F.lit(0).cast("long").alias("pair"),
        F.count(F.lit(1)).alias("total"),
    )

"""Continuous formulas: one outcome per reading and formula that mentions its node."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions.formula_columns import (
    RESULT_INFINITE,
    RESULT_NAN,
    operand_count,
    outcome_by_shape,
)
from gaugework.operators.formulas import FormulaSet, as_formula_set
from gaugework.operators.latest import latest_values
from gaugework.session import stored
from gaugework.sources.readings import input_error, number_column

# Shapes evaluated by one projection. With more, the joined rows are written once,
# apart by groups of so many shapes, and each group is read by itself, so the
# readings are scanned once however many shapes there are.
SHAPES_PER_PASS = 512

# The first operands of a formula are columns of their own. Further ones, which
# only wide formulas have, are looked up where they are used.
NAMED_OPERANDS = 16

# With a formula of a longer shape, evaluating a reading costs far more than moving it. Readings are
# then dealt evenly over so many tasks a core, as a scan gives one task what fills a file's split.
LONG_SHAPE = 2_000
TASKS_PER_CORE = 4

OUTCOME = "struct<result:double,error:string>"


def outcomes(
    rows: DataFrame,
    formulas: FormulaSet,
    before: list[Column],
    operand: Callable[[int], str],
    keep: list[str],
) -> DataFrame:
    """``keep`` columns with result and error, evaluating each row's own shape.

    ``before`` lists the errors that stand in the way of evaluation; the first
    that is not NULL counts. Rows carry ``shape_id`` and ``constants``;
    ``operand`` gives the expression of the i-th operand.
    """
    shapes = formulas.shapes
    named = min(operand_count(shapes), NAMED_OPERANDS)
    rows = rows.selectExpr("*", *(f"{operand(i)} AS x{i}" for i in range(named)))
    passes = [
        shapes[at : at + SHAPES_PER_PASS] for at in range(0, len(shapes), SHAPES_PER_PASS)
    ]
    # The filter is a higher-order function, which Spark leaves out of whole-stage
    # code. Only there does it split the CASE into methods small enough for the
    # JVM to compile; in one of more than 8000 bytes it would be interpreted.
    present = F.filter(F.array(*before), lambda error: error.isNotNull())
    stopped = F.struct(
        F.lit(None).cast("double").alias("result"), F.get(present, F.lit(0)).alias("error")
    )
    parts = []
    if len(passes) > 1:
        # The number of the pass by the first shape of each; rows without a shape are in the first.
        firsts = F.array(*(F.lit(chunk[0].id) for chunk in passes[1:]))
        turn = F.size(F.filter(firsts, lambda first: first <= F.col("shape_id")))
        rows = stored(rows.withColumn("_pass", F.greatest(turn, F.lit(0))), "joined", "_pass")
    for at, chunk in enumerate(passes or [()]):
        part = rows.filter(F.col("_pass") == at) if len(passes) > 1 else rows
        made = F.when(F.coalesce(*before).isNotNull(), stopped)
        if chunk:
            made = made.otherwise(
                outcome_by_shape(chunk, lambda i: f"x{i}" if i < named else operand(i))
            )
        parts.append(part.select(*keep, made.cast(OUTCOME).alias("_outcome")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    result, error = F.col("_outcome.result"), F.col("_outcome.error")
    checked = F.coalesce(
        error,
        F.when(F.isnan(result), RESULT_NAN).when(
            F.abs(result) == float("inf"), RESULT_INFINITE
        ),
    )
    return whole.select(*keep, result.alias("_result"), checked.alias("error")).select(
        *keep, F.when(F.col("error").isNull(), F.col("_result")).alias("result"), "error"
    )


def formula_operands(formulas: FormulaSet, latest: DataFrame) -> DataFrame:
    """One row per formula with its operands taken from the snapshot.

    ``ops`` follows the order of ``nodes`` with NULL for a node the snapshot
    lacks; ``missing`` lists those mentions in formula order, repeats kept. The
    snapshot has one row per node, and only nodes of a formula are joined, so
    both sides are as small as the formulas.
    """
    edges = formulas.edges()
    snapshot = latest.select("node_id", F.col("value").alias("_latest"))
    wanted = snapshot.join(formulas.hint(edges.select("node_id")), "node_id", "left_semi")
    found = edges.join(formulas.hint(wanted), "node_id", "left").groupBy("variable_id").agg(
        F.sort_array(F.collect_list(F.struct("idx", "_latest"))).alias("_found"),
        F.collect_set(F.when(F.col("_latest").isNull(), F.col("node_id"))).alias("_missing"),
    )
    return formulas.table.join(formulas.hint(found), "variable_id").select(
        "variable_id",
        "shape_id",
        "constants",
        "compile_error",
        F.transform("_found", lambda pair: pair["_latest"]).alias("ops"),
        F.filter("mentions", lambda node: F.array_contains("_missing", node)).alias("missing"),
    )


def unresolved(missing: Column) -> Column:
    """``UNRESOLVED_NODE: a, b`` or NULL when nothing is missing."""
    return F.when(
        F.size(missing) > 0, F.concat(F.lit("UNRESOLVED_NODE: "), F.array_join(missing, ", "))
    )


def evaluate(
    readings: DataFrame, formulas: FormulaSet | DataFrame, latest: DataFrame | None = None
) -> DataFrame:
    """Every continuous formula for every reading of a node it mentions.

    Returns (tag_id, variable_id, result, error, result_on). The other operands
    come from ``latest`` (by default the latest values of these readings); the
    reading's own value stands for its own node.
    """
    formulas = as_formula_set(formulas).of("continuous")
    readings = formulas.mentioned(readings)
    if latest is None:
        latest = latest_values(readings)
    number = number_column(readings)
    keyed = readings.select(
        F.col("id").alias("tag_id"),
        "node_id",
        F.col("timestamp").alias("result_on"),
        number.alias("_value"),
        input_error(readings, number).alias("_input_error"),
    )
    if any(len(shape.text) > LONG_SHAPE for shape in formulas.shapes):
        keyed = keyed.repartition(TASKS_PER_CORE * keyed.sparkSession.sparkContext.defaultParallelism)
    matched = formulas.attach(keyed, formulas.edges(), "node_id")
    rows = formulas.attach(matched, formula_operands(formulas, latest), "variable_id")
    before = [
        unresolved(F.array_remove("missing", F.col("node_id"))),
        F.col("_input_error"),
        F.col("compile_error"),
    ]
    return outcomes(
        rows,
        formulas,
        before,
        lambda i: f"CASE WHEN idx = {i} THEN _value ELSE get(ops, {i}) END",
        ["tag_id", "variable_id", "result_on"],
    ).select("tag_id", "variable_id", "result", "error", "result_on")


EMPTY_FORMULA = "COMPILE_ERROR: Empty formula"
UNKNOWN_VARIABLE = "UNKNOWN_VARIABLE"


def evaluate_scenarios(scenarios: DataFrame, formulas: FormulaSet | DataFrame) -> DataFrame:
    """Formulas evaluated against supplied values instead of readings.

    ``scenarios`` has (scenario_id, variable_id, tags map<string,double>). The
    first entry of ``tags`` is validated like a triggering value. Returns
    (scenario_id, variable_id, result, error), one row per scenario: one of an empty
    formula, or of a variable that is deleted or not in the table, has an error. Only
    the formula table itself tells empty formulas from unknown ones; a ``FormulaSet`` has neither.
    """
    variables = None if isinstance(formulas, FormulaSet) else formulas
    formulas = as_formula_set(formulas)
    detail = formulas.table.select(
        "variable_id", "shape_id", "constants", "compile_error", "nodes", "mentions"
    )
    if variables is not None:
        blank = F.col("pre_save_formula").isNull() | (F.rtrim("pre_save_formula") == "")
        empty = variables.where(~F.col("is_deleted") & blank).select(
            F.col("variable_id").cast("long"), F.lit(EMPTY_FORMULA).alias("compile_error")
        )
        detail = detail.unionByName(empty, allowMissingColumns=True)
    detail = detail.withColumn("known", F.lit(True))
    asked = scenarios.select("scenario_id", "variable_id", "tags")
    rows = formulas.attach(asked, detail, "variable_id", how="left")
    rows = rows.withColumn(
        "compile_error", F.when(F.col("known").isNull(), UNKNOWN_VARIABLE).otherwise(F.col("compile_error"))
    )
    rows = rows.select(
        "*",
        F.transform("nodes", lambda node: F.try_element_at("tags", node)).alias("ops"),
        F.filter("mentions", lambda node: F.try_element_at("tags", node).isNull()).alias("missing"),
        F.get(F.map_values("tags"), F.lit(0)).alias("value"),
    )
    before = [
        F.when(F.col("nodes").isNull(), F.col("compile_error")),
        unresolved(F.col("missing")),
        input_error(rows, F.col("value")),
        F.col("compile_error"),
    ]
    return outcomes(
        rows,
        formulas,
        before,
        lambda i: f"get(ops, {i})",
        ["scenario_id", "variable_id"],
    )

"""Windowed formulas: anchored tumbling windows, closed at both ends.

A schedule is a small table with one row per formula: ``variable_id``,
``minutes``, and ``first_end`` and ``last_end``, the first and last window to
evaluate. Windows are told apart by their end in microseconds, so all arithmetic
is on integers.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.operators.continuous import outcomes, unresolved
from gaugework.operators.formulas import FormulaSet, as_formula_set
from gaugework.operators.positions import ROWS_PER_TASK, with_positions
from gaugework.sources.readings import number_column
from gaugework.sources.variables import NODE_REFERENCE, active_formulas

NO_ROWS = "NO_COMPUTABLE_ROWS_IN_WINDOW"

# Windows of one formula made from one row of the schedule at a time.
WINDOWS_PER_ROW = 10_000
WINDOWS_PER_TASK = 1_000_000

EVALUATED = "variable_id bigint, window_start timestamp, window_end timestamp, result double, error string"


def _micros(column: Column | str) -> Column:
    return F.unix_micros(F.col(column) if isinstance(column, str) else column)


def _length(minutes: str = "minutes") -> Column:
    return F.col(minutes).cast("long") * 60_000_000


def _at(as_of: datetime | str | Column) -> Column:
    return F.lit(as_of).cast("timestamp")  # lit leaves a Column as it is


def _timed(formulas: FormulaSet | DataFrame) -> DataFrame:
    """Windowed formulas with ``mentioned``, whether they mention a node at all."""
    if isinstance(formulas, FormulaSet):
        table = formulas.table.withColumn("mentioned", F.size("nodes") > 0)
    else:
        mentioned = F.col("formula").rlike(NODE_REFERENCE)
        table = active_formulas(formulas).withColumn("mentioned", mentioned)
    return table.filter("minutes > 0").select(
        "variable_id", "minutes", F.col("time_interval").cast("timestamp"), "mentioned"
    )


def due_windows(formulas: FormulaSet | DataFrame, as_of: datetime | str) -> DataFrame:
    """What one tick at ``as_of`` does with each windowed formula.

    Returns (variable_id, minutes, action, window_start, window_end,
    next_deadline). ``action`` is "init" at first sight, "wait" before the
    deadline, "stale" when the deadline lies more than one window back (windows
    missed are dropped), "advance" for a formula without nodes, else "run".
    """
    now, deadline, length = _micros(_at(as_of)), _micros("time_interval"), _length()
    action = (
        F.when(deadline.isNull(), "init")
        .when(now < deadline, "wait")
        .when(now - deadline > length, "stale")
        .when(~F.col("mentioned"), "advance")
        .otherwise("run")
    )
    runs = F.col("action") == "run"
    following = (
        F.when(F.col("action").isin("init", "stale"), now + length)
        .when(F.col("action") == "wait", deadline)
        .otherwise(deadline + length)
    )
    return (
        _timed(formulas)
        .withColumn("action", action)
        .select(
            "variable_id",
            "minutes",
            "action",
            F.when(runs, F.timestamp_micros(deadline - length)).alias("window_start"),
            F.when(runs, F.timestamp_micros(deadline)).alias("window_end"),
            F.timestamp_micros(following).alias("next_deadline"),
        )
    )


def tick_schedule(due: DataFrame) -> DataFrame:
    """The schedule of the windows that :func:`due_windows` says to run."""
    end = F.col("window_end")
    return due.filter("action = 'run'").select(
        "variable_id", "minutes", end.alias("first_end"), end.alias("last_end")
    )


def replay_schedule(formulas: FormulaSet | DataFrame, as_of: datetime | str) -> DataFrame:
    """Every window with a deadline up to ``as_of``, as if always up."""
    deadline, length = _micros("time_interval"), _length()
    behind = _micros(_at(as_of)) - deadline
    last = deadline + (behind - F.pmod(behind, length))
    return (
        _timed(formulas)
        .filter(F.col("mentioned") & (behind >= 0))
        .select(
            "variable_id",
            "minutes",
            F.col("time_interval").alias("first_end"),
            F.timestamp_micros(last).alias("last_end"),
        )
    )


def _spans(schedule: DataFrame) -> DataFrame:
    """The schedule in microseconds."""
    return schedule.select(
        "variable_id",
        _micros("first_end").alias("_first"),
        _micros("last_end").alias("_last"),
        _length().alias("_length"),
    )


def _scheduled(formulas: FormulaSet, schedule: DataFrame) -> DataFrame:
    """Formulas with their schedule."""
    return formulas.table.join(formulas.hint(_spans(schedule)), "variable_id")


def window_schedule(schedule: DataFrame) -> DataFrame:
    """The windows of a schedule: (variable_id, window_start, window_end)."""
    spans = _spans(schedule)
    return _windows(spans, _extent(spans)[2]).select(
        "variable_id",
        F.timestamp_micros(F.col("window_end") - F.col("_length")).alias("window_start"),
        F.timestamp_micros("window_end").alias("window_end"),
    )


def _extent(spans: DataFrame) -> tuple[int | None, int | None, int]:
    """Start and end of the time that a schedule covers, and its windows.

    The schedule has one row per formula, so this is cheap to ask ahead.
    """
    count = F.expr("(_last - _first) div _length + 1")
    low, high, windows = spans.agg(
        F.min(F.col("_first") - F.col("_length")), F.max("_last"), F.sum(count)
    ).first()
    return low, high, windows or 0


def _windows(table: DataFrame, count: int) -> DataFrame:
    """One row per window of the schedule joined to its formulas.

    Schedules are unfolded in two steps, so that no array of windows grows with
    the length of the history, and many windows are made by many tasks.
    """
    block = F.col("_length") * WINDOWS_PER_ROW
    blocks = F.explode(F.sequence("_first", "_last", block)).alias("_from")
    until = F.least(F.col("_last"), F.col("_from") + block - F.col("_length"))
    ends = F.explode(F.sequence("_from", until, "_length")).alias("window_end")
    unfolded = table.select("*", blocks)
    if count > WINDOWS_PER_TASK:
        tasks = -(-count // WINDOWS_PER_TASK)
        unfolded = unfolded.repartition(tasks, "variable_id", "_from")
    return unfolded.select(*table.columns, ends)


def _numbers(
    readings: DataFrame, formulas: FormulaSet, low: int | None, high: int | None
) -> DataFrame:
    """Usable readings of the formulas' nodes between two times.

    The bounds become literals of the clock's own type, so that the scan can
    skip files and row groups.
    """
    if low is None:
        readings = readings.limit(0)
    else:
        kind = readings.schema["created_on"].dataType
        start, end = (F.timestamp_micros(F.lit(bound)).cast(kind) for bound in (low, high))
        readings = readings.filter(F.col("created_on").between(start, end))
    return formulas.mentioned(readings).select(
        "id",
        "node_id",
        _micros(F.col("created_on").cast("timestamp")).alias("_at"),
        number_column(readings).alias("value"),
    ).filter(F.col("value").isNotNull())


def usable_numbers(readings: DataFrame, formulas: FormulaSet, schedule: DataFrame) -> DataFrame:
    """Usable readings of the formulas' nodes in the time that a schedule covers."""
    low, high, _ = _extent(_spans(schedule))
    return _numbers(readings, formulas, low, high)


def _in_windows(formulas: FormulaSet, numbers: DataFrame, demand: DataFrame) -> DataFrame:
    """Readings with the end of each window they fall in.

    ``demand`` says per node which windows are wanted: ``_length``, ``_first``,
    ``_last``. A reading on a window's edge belongs to both neighbours. The join
    is on the node alone; the window is computed, not searched for.
    """
    rows = formulas.attach(numbers, demand, "node_id")
    into = F.pmod(F.col("_at") - F.col("_first"), F.col("_length"))
    end = F.col("_at") - into + F.col("_length")
    ends = F.when(into == 0, F.array(F.col("_at"), end)).otherwise(F.array(end))
    near = F.col("_at").between(F.col("_first") - F.col("_length"), F.col("_last"))
    return (
        rows.filter(near)
        .withColumn("window_end", F.explode(ends))
        .filter(F.col("window_end").between(F.col("_first"), F.col("_last")))
    )


def _nodes(table: DataFrame) -> DataFrame:
    return table.select(
        "variable_id", "_length", "_first", "_last", F.posexplode("nodes").alias("idx", "node_id")
    )


def _shared(nodes: DataFrame) -> DataFrame:
    """Windows wanted per node, shared by formulas on the same grid of windows."""
    grid = F.pmod(F.col("_first"), F.col("_length"))
    return nodes.groupBy("node_id", "_length", grid.alias("_grid")).agg(
        F.min("_first").alias("_first"), F.max("_last").alias("_last")
    )


def _to_formulas(formulas: FormulaSet, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of shared windows handed to each formula that wants them."""
    wanted = nodes.withColumn("_grid", F.pmod(F.col("_first"), F.col("_length")))
    inside = F.col("window_end").between(F.col("_first"), F.col("_last"))
    return formulas.attach(rows, wanted, "node_id", "_length", "_grid").filter(inside)


def window_readings(
    readings: DataFrame, formulas: FormulaSet | DataFrame, schedule: DataFrame
) -> DataFrame:
    """The usable readings of every window and node of its formula.

    Returns (variable_id, node_id, window_start, window_end, id, value).
    """
    formulas = as_formula_set(formulas)
    low, high, _ = _extent(_spans(schedule))
    rows = _in_windows(
        formulas,
        _numbers(readings, formulas, low, high),
        _nodes(_scheduled(formulas, schedule)),
    )
    return rows.select(
        "variable_id",
        "node_id",
        F.timestamp_micros(F.col("window_end") - F.col("_length")).alias("window_start"),
        F.timestamp_micros("window_end").alias("window_end"),
        "id",
        "value",
    )


def _aligned(
    numbers: DataFrame, formulas: FormulaSet, table: DataFrame, rows_per_task: int
) -> DataFrame:
    """i-th readings of all nodes of a formula side by side.

    One row per (variable_id, window_end, position) with the operands ``x0, …``
    and ``_present``, how many nodes have a reading at that position. Positions
    are counted once per node and window, however many formulas share it.
    """
    nodes = _nodes(table)
    rows = _in_windows(formulas, numbers, _shared(nodes)).select(
        "node_id", "_length", "_grid", "window_end", "_at", "id", "value"
    )
    placed = with_positions(
        rows, ["node_id", "_length", "window_end"], ["_at", "id"], rows_per_task
    )
    operands = [
        F.max(F.when(F.col("idx") == i, F.col("value"))).alias(f"x{i}")
        for i in range(formulas.widest)
    ]
    return (
        _to_formulas(formulas, placed, nodes)
        .groupBy("variable_id", "window_end", "position")
        .agg(F.count(F.lit(1)).alias("_present"), *operands)
    )


def aligned_readings(
    readings: DataFrame,
    formulas: FormulaSet | DataFrame,
    schedule: DataFrame,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """The aligned rows of each window, cut at the shortest node.

    Returns (variable_id, window_end, position, x0, x1, …).
    """
    formulas = as_formula_set(formulas).of("many")
    table = _scheduled(formulas, schedule)
    low, high, _ = _extent(_spans(schedule))
    numbers = _numbers(readings, formulas, low, high)
    rows = _aligned(numbers, formulas, table, rows_per_task)
    sizes = formulas.table.select("variable_id", F.size("nodes").alias("_nodes"))
    whole = formulas.attach(rows, sizes, "variable_id").filter("_present = _nodes")
    return whole.select(
        "variable_id",
        F.timestamp_micros("window_end").alias("window_end"),
        "position",
        *(f"x{i}" for i in range(formulas.widest)),
    )


def _aggregate_one_node(
    numbers: DataFrame, formulas: FormulaSet, schedule: DataFrame
) -> DataFrame:
    """Outcomes for SUM and AVG over one node: no positions are needed."""
    formulas = formulas.of("one")
    detail = _scheduled(formulas, schedule).select(
        "variable_id",
        "_length",
        "_first",
        "_last",
        "shape_id",
        "constants",
        "compile_error",
        F.get("nodes", F.lit(0)).alias("node_id"),
    )
    rows = _in_windows(formulas, numbers, detail)
    return outcomes(
        rows,
        formulas,
        [F.col("compile_error")],
        lambda i: "value",
        ["variable_id", "window_end"],
    )


def _aggregate_aligned(
    numbers: DataFrame, formulas: FormulaSet, schedule: DataFrame, rows_per_task: int
) -> DataFrame:
    """Outcomes for SUM and AVG over several nodes, row by aligned row."""
    formulas = formulas.of("many")
    many = _scheduled(formulas, schedule)
    rows = _aligned(numbers, formulas, many, rows_per_task)
    detail = formulas.table.select(
        "variable_id", "shape_id", "constants", "compile_error", F.size("nodes").alias("_nodes")
    )
    rows = formulas.attach(rows, detail, "variable_id")
    operands = [f"x{i}" for i in range(formulas.widest)]
    rows = rows.withColumnsRenamed({name: f"_{name}" for name in operands})
    return outcomes(
        rows,
        formulas,
        [F.when(F.col("_present") < F.col("_nodes"), NO_ROWS), F.col("compile_error")],
        lambda i: f"_x{i}",
        ["variable_id", "window_end"],
    )


# Time and id as one number, which keeps the aggregation buffer fixed width.
_BY_TIME = "cast(_at AS decimal(17)) * 20000000000000000000BD + cast(id AS decimal(19))"


def newest_of_windows(rows: DataFrame) -> DataFrame:
    """The last of ``rows`` (_at, id, value) of each node and window."""
    order = F.expr(_BY_TIME)
    return rows.groupBy("node_id", "_length", "_grid", "window_end").agg(
        F.max_by("_at", order).alias("_at"), F.max_by("id", order).alias("id"), F.max_by("value", order).alias("value")
    )


def last_values(numbers: DataFrame, formulas: FormulaSet, schedule: DataFrame) -> DataFrame:
    """The last usable reading of each node and window that a "last" formula asks for."""
    formulas = formulas.of("last")
    return newest_of_windows(_in_windows(formulas, numbers, _shared(_nodes(_scheduled(formulas, schedule)))))


def window_totals(numbers: DataFrame, formulas: FormulaSet, schedule: DataFrame) -> DataFrame:
    """Sum and count of each SUM or AVG over one node and each of its windows."""
    return _totals(_aggregate_one_node(numbers, formulas, schedule))


@dataclass(frozen=True)
class Held:
    """What windows hold so far: of aggregates over one node (variable_id, window_end, _sum, _count), of
    nodes their last readings (node_id, _length, _grid, window_end, _at, id, value)."""

    totals: DataFrame
    lasts: DataFrame


def _on_last_values(last: DataFrame, formulas: FormulaSet, schedule: DataFrame) -> DataFrame:
    """Outcomes of formulas without an outer aggregate, on each node's last value."""
    formulas = formulas.of("last")
    nodes = _nodes(_scheduled(formulas, schedule))
    each = _to_formulas(formulas, last, nodes)
    found = each.groupBy("variable_id", "window_end").agg(
        F.map_from_entries(F.collect_list(F.struct("idx", "value"))).alias("_ops"),
        F.collect_list("node_id").alias("_present"),
    )
    detail = formulas.table.select("variable_id", "shape_id", "constants", "compile_error", "mentions")
    rows = formulas.attach(found, detail, "variable_id")
    missing = F.filter("mentions", lambda node: ~F.array_contains("_present", node))
    first = F.try_element_at("_ops", F.lit(0))
    unusable = F.when(F.isnan(first), "NAN_VALUE").when(
        F.abs(first) == float("inf"), "INFINITE_VALUE"
    )
    return outcomes(
        rows,
        formulas,
        [unresolved(missing), unusable, F.col("compile_error")],
        lambda i: f"try_element_at(_ops, {i})",
        ["variable_id", "window_end"],
    )


def evaluate_windows(
    readings: DataFrame,
    formulas: FormulaSet | DataFrame,
    schedule: DataFrame,
    rows_per_task: int = ROWS_PER_TASK,
    held: Held | None = None,
) -> DataFrame:
    """One outcome per windowed formula and window of its schedule.

    Returns (variable_id, window_start, window_end, result, error). A formula
    that is one SUM or AVG call aggregates its argument over the window's
    readings, skipping rows that fail; any other formula is evaluated once on
    the last value of each node. Windows without data keep an error row. With ``held``,
    readings are scanned for aggregates over several nodes only.
    """
    formulas = as_formula_set(formulas).of("one", "many", "last")
    if not formulas.kinds:
        return schedule.sparkSession.createDataFrame([], EVALUATED)
    low, high, count = _extent(_spans(schedule))
    numbers = _numbers(readings, formulas, low, high)
    parts = []
    if "one" in formulas.kinds:
        parts.append(held.totals if held else window_totals(numbers, formulas, schedule))
    if "many" in formulas.kinds:
        parts.append(_totals(_aggregate_aligned(numbers, formulas, schedule, rows_per_task)))
    if "last" in formulas.kinds:
        last = held.lasts if held else last_values(numbers, formulas, schedule)
        parts.append(_on_last_values(last, formulas, schedule))
    windows = _windows(
        _scheduled(formulas, schedule).select(
            "variable_id", "aggregate", "nodes", "_first", "_last", "_length"
        ),
        count,
    )
    if not parts:
        return _as_windows(windows, F.lit(None).cast("double"), F.lit(None).cast("string"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part, allowMissingColumns=True)
    for name, kind in (("_sum", "double"), ("_count", "long"), ("result", "double"), ("error", "string")):
        if name not in found.columns:
            found = found.withColumn(name, F.lit(None).cast(kind))
    found = found.withColumn("_found", F.lit(True))
    joined = windows.join(found, ["variable_id", "window_end"], "left")
    no_data = F.concat(F.lit("NO_DATA_IN_WINDOW: "), F.array_join(F.array_sort("nodes"), ", "))
    error = (
        F.when(F.col("_found").isNull(), no_data)
        .when(F.col("aggregate").isNotNull() & (F.col("_count") == 0), F.lit(NO_ROWS))
        .otherwise(F.col("error"))
    )
    result = (
        F.when(F.col("aggregate") == "sum", F.col("_sum"))
        .when(F.col("aggregate") == "avg", F.try_divide("_sum", "_count"))
        .otherwise(F.col("result"))
    )
    return _as_windows(joined, F.when(error.isNull(), result), error)


def _totals(rows: DataFrame) -> DataFrame:
    """Sum and count of the rows that could be computed, per formula and window.

    Tasks sum what they hold before the shuffle, so a hot window is shuffled as
    one row per task.
    """
    return rows.groupBy("variable_id", "window_end").agg(
        F.sum("result").alias("_sum"), F.count("result").alias("_count")
    )


def _as_windows(windows: DataFrame, result: Column, error: Column) -> DataFrame:
    return windows.select(
        "variable_id",
        F.timestamp_micros(F.col("window_end") - F.col("_length")).alias("window_start"),
        F.timestamp_micros("window_end").alias("window_end"),
        result.alias("result"),
        error.alias("error"),
    )

"""State of the windows that have not fired yet, carried from batch to batch.

Two tables and a list of the formulas they were made for:

* ``open_totals``: per aggregate over one node and window, the sum and count of its rows so far;
* ``open_lasts``: per node, length, grid and window, the last reading so far, shared by
  formulas on the same grid;
* ``open_marks``: per formula, a hash of what it computes and the first window it still waits for.

A batch adds its own readings to those of the batch before, and windows fire from the result, so a
tick scans what is open and not the history. What lies before the first window that a formula waits for is
dropped when the state is next read. Readings for a window that has fired already are late: see
:mod:`gaugework.streaming.late`.

A formula that is new, changed, or anchored anew has no state. That of its windows
is then made once from the history, up to the last id that the stream has processed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.operators.formulas import FormulaSet
from gaugework.operators.windows import (
    Held,
    last_values,
    newest_of_windows,
    usable_numbers,
    window_totals,
)

MARKS = "variable_id bigint, mark bigint, open_from bigint"
TOTALS = "variable_id bigint, window_end bigint, _sum double, _count bigint"
LASTS = "node_id string, _length bigint, _grid bigint, window_end bigint, _at bigint, id bigint, value double"

#: Kinds of formulas whose windows are held; others need all rows of a window.
KINDS = ("one", "last")


def _length() -> Column:
    return F.col("minutes").cast("long") * 60_000_000


def marks(formulas: FormulaSet, opened: DataFrame) -> DataFrame:
    """variable_id, mark, open_from and minutes of each formula held; ``opened`` has (variable_id, open_from)."""
    meaning = ("minutes", "kind", "aggregate", "shape", "constants", "nodes", "compile_error")
    table = formulas.of(*KINDS).table.select("variable_id", "minutes", F.xxhash64(*meaning).alias("mark"))
    return table.join(opened, "variable_id").select("variable_id", "mark", "open_from", "minutes")


def _schedule(known: DataFrame, newest: int) -> DataFrame:
    """Every window from the first open one to those that a reading at ``newest`` falls in."""
    length = _length()
    ahead = F.greatest(F.lit(0), F.lit(newest) - F.col("open_from"))
    last = F.col("open_from") + (F.floor(ahead / length) + 1).cast("long") * length
    return known.select(
        "variable_id",
        "minutes",
        F.timestamp_micros("open_from").alias("first_end"),
        F.timestamp_micros(last).alias("last_end"),
    )


def _newest(readings: DataFrame) -> int | None:
    return readings.agg(F.unix_micros(F.max(F.col("created_on").cast("timestamp")))).first()[0]


def _made(readings: DataFrame, formulas: FormulaSet, known: DataFrame, newest: int | None) -> list[Held]:
    """What ``readings`` add to the open windows of the formulas ``known``."""
    if newest is None:
        return []
    schedule = _schedule(known, newest)
    numbers = usable_numbers(readings, formulas.of(*KINDS), schedule)
    return [Held(window_totals(numbers, formulas, schedule), last_values(numbers, formulas, schedule))]


def merged(
    before: Held,
    marks_before: DataFrame,
    now: DataFrame,
    formulas: FormulaSet,
    batch: DataFrame,
    history: Callable[[], DataFrame],
    high: int,
) -> Held:
    """The state after ``batch``; ``now`` are the marks of this batch, ``high`` the last id processed.

    ``history`` is called only if a formula has no state yet.
    """
    keys = ["variable_id", "mark", "open_from"]
    known = now.join(marks_before.select(*keys, F.lit(True).alias("_known")).distinct(), keys, "left")
    known = formulas.at_hand(known.withColumn("_known", F.col("_known").isNotNull()))
    live = known.filter("_known").drop("_known")
    fresh = known.filter("not _known").drop("_known")
    parts = _made(batch, formulas, live, _newest(batch))
    if not fresh.isEmpty():
        low = fresh.agg(F.min(F.col("open_from") - _length())).first()[0]
        rows = history()
        start = F.timestamp_micros(F.lit(low)).cast(rows.schema["created_on"].dataType)
        rows = rows.filter((F.col("id") <= high) & (F.col("created_on") >= start))
        parts += _made(rows, formulas, fresh, _newest(rows))

    waiting = live.select("variable_id", "open_from")
    totals = before.totals.join(waiting, "variable_id").filter("window_end >= open_from").drop("open_from")
    nodes = formulas.of("last").edges().join(now, "variable_id")
    demand = nodes.groupBy("node_id", _length().alias("_length"), F.pmod("open_from", _length()).alias("_grid"))
    demand = demand.agg(F.min("open_from").alias("open_from"))
    lasts = before.lasts.join(demand, ["node_id", "_length", "_grid"]).filter("window_end >= open_from")
    lasts = lasts.drop("open_from")
    for part in parts:
        totals = totals.unionByName(part.totals)
        lasts = lasts.unionByName(part.lasts)
    summed = totals.groupBy("variable_id", "window_end").agg(
        F.sum("_sum").alias("_sum"), F.sum("_count").alias("_count")
    )
    return Held(summed, newest_of_windows(lasts))

"""Sensor readings and user-written formulas, evaluated as Spark DataFrame plans."""

from gaugework.operators.continuous import evaluate, evaluate_scenarios
from gaugework.operators.formulas import FormulaSet, read_formulas
from gaugework.operators.latest import latest_values
from gaugework.operators.windows import (
    aligned_readings,
    due_windows,
    evaluate_windows,
    replay_schedule,
    tick_schedule,
    window_readings,
    window_schedule,
)
from gaugework.plans.reports import (
    all_executions,
    batch_stats,
    executions_latest,
    executions_summary,
    raw_data_latest,
    raw_data_stats,
    split_outcomes,
    with_text_times,
)
from gaugework.sources.id_stream import stream_by_id
from gaugework.sources.readings import new_readings, start_offset
from gaugework.sources.results import executions, failures, newest_executions, service_stats
from gaugework.sources.variables import (
    active_formulas,
    formula_counts,
    formula_list,
    formula_nodes,
)
from gaugework.streaming.late import corrected_windows, fired_windows, late_counts, late_readings
from gaugework.streaming.service import (
    batch_readings,
    deadlines,
    latest_state_table,
    rerun_batch,
    start_stream,
)

__all__ = [
    "FormulaSet",
    "active_formulas",
    "aligned_readings",
    "all_executions",
    "batch_readings",
    "batch_stats",
    "corrected_windows",
    "deadlines",
    "due_windows",
    "evaluate",
    "evaluate_scenarios",
    "evaluate_windows",
    "executions",
    "executions_latest",
    "executions_summary",
    "failures",
    "fired_windows",
    "formula_counts",
    "formula_list",
    "formula_nodes",
    "late_counts",
    "late_readings",
    "latest_state_table",
    "latest_values",
    "new_readings",
    "newest_executions",
    "raw_data_latest",
    "raw_data_stats",
    "read_formulas",
    "replay_schedule",
    "rerun_batch",
    "service_stats",
    "split_outcomes",
    "start_offset",
    "start_stream",
    "stream_by_id",
    "tick_schedule",
    "window_readings",
    "window_schedule",
    "with_text_times",
]

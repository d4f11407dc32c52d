"""The registered queries: each public function over the test data."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import gaugework as gw
from checks import fixtures
from checks.testdata import as_readings, customer_variables, events, readings, user_readings
from gaugework.plans.reports import with_text_times
from gaugework.session import fresh_dir
from gaugework.sources import results
from gaugework.sources.readings import number_column
from gaugework.streaming.service import rerun_batch

Query = Callable[[SparkSession, str], DataFrame]

END = "2024-01-31 00:00:00"
MIDDLE = "2024-01-15 12:00:00"


def rounded(table: DataFrame, name: str = "result", digits: int = 8) -> DataFrame:
    """Rounded as SQL's doubles are: scaled, rounded and scaled back, each in doubles."""
    scaled = F.col(name) * float(10**digits)
    near = F.round(scaled, 0) / float(10**digits)
    return table.withColumn(name, F.when(F.abs(scaled) < float("inf"), near).otherwise(F.col(name)))


# Readings


def incremental_scan(spark: SparkSession, folder: str) -> DataFrame:
    rows = gw.new_readings(readings(spark, folder), after_id=400, limit=200)
    return with_text_times(rows.drop("created_on"), "timestamp")


def start_offset(spark: SparkSession, folder: str) -> DataFrame:
    table = readings(spark, folder)
    cases = {"first run": None, "stored zero": 0, "stored": 4711}
    parts = []
    for name, mark in cases.items():
        state = spark.range(1).select(
            F.lit("gaugework" if mark is not None else "other").alias("service_name"),
            F.lit(mark).cast("long").alias("last_processed_id"),
        )
        parts.append(gw.start_offset(state, table).withColumn("case", F.lit(name)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def latest_values(spark: SparkSession, folder: str) -> DataFrame:
    return gw.latest_values(user_readings(spark, folder))


def raw_data_latest(spark: SparkSession, folder: str) -> DataFrame:
    return with_text_times(gw.raw_data_latest(readings(spark, folder), limit=20), "timestamp")


def raw_data_stats(spark: SparkSession, folder: str) -> DataFrame:
    return gw.raw_data_stats(readings(spark, folder), MIDDLE)


# Formulas


def active_formulas(spark: SparkSession, folder: str) -> DataFrame:
    return with_text_times(gw.active_formulas(customer_variables(spark, folder)), "time_interval")


def formula_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return gw.formula_nodes(customer_variables(spark, folder))


def formula_list(spark: SparkSession, folder: str) -> DataFrame:
    return gw.formula_list(customer_variables(spark, folder))


def formula_counts(spark: SparkSession, folder: str) -> DataFrame:
    return gw.formula_counts(customer_variables(spark, folder))


# Continuous formulas


def outcomes_of(variables: list[fixtures.Variable]) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        made = gw.evaluate(readings(spark, folder), fixtures.table(spark, variables))
        return made.drop("result_on")

    return query


def rounded_outcomes_of(variables: list[fixtures.Variable]) -> Query:
    plain = outcomes_of(variables)
    return lambda spark, folder: rounded(plain(spark, folder))


def failed_executions(spark: SparkSession, folder: str) -> DataFrame:
    _, failed = gw.split_outcomes(
        gw.evaluate(readings(spark, folder), fixtures.table(spark, fixtures.CONTINUOUS))
    )
    dead = results.as_failures(failed.withColumn("processed_on", F.lit(END).cast("timestamp")))
    return with_text_times(dead, "failed_at")


def scalar_validate(spark: SparkSession, folder: str) -> DataFrame:
    """Readings as text, some of them no numbers."""
    table = readings(spark, folder).withColumn(
        "value",
        F.expr(
            "CASE id % 11 WHEN 0 THEN NULL WHEN 1 THEN 'abc' WHEN 2 THEN 'NaN' WHEN 3 THEN 'inf' "
            "WHEN 4 THEN '-Infinity' WHEN 5 THEN '1_000.5' WHEN 6 THEN '1.5d' WHEN 7 THEN ' 12 ' "
            "ELSE string(value) END"
        ),
    )
    return gw.evaluate(table, fixtures.table(spark, fixtures.VALIDATED)).drop("result_on")


def whatif_scenarios(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's highest values as one scenario per formula."""
    asked = [*fixtures.SCENARIOS, fixtures.EMPTY, fixtures.DELETED, fixtures.UNKNOWN]
    ids = F.array(*(F.lit(variable.id).cast("long") for variable in asked))
    nodes = F.concat(F.lit("ns=2;s=Line1."), "event_type")
    scenarios = (
        events(spark, folder)
        .groupBy("user_id", nodes.alias("node_id"))
        .agg(F.max("value").alias("value"))
        .groupBy("user_id")
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("node_id", "value")))).alias("tags"))
        .select(F.col("user_id").alias("scenario_id"), F.explode(ids).alias("variable_id"), "tags")
    )
    return gw.evaluate_scenarios(scenarios, fixtures.table(spark, asked[:-1]))


# Windows


def replayed(spark: SparkSession, *names: str) -> tuple[gw.FormulaSet, DataFrame]:
    formulas = gw.read_formulas(fixtures.table(spark, fixtures.windowed(*names)))
    return formulas, gw.replay_schedule(formulas, END)


def windows_of(*names: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        formulas, schedule = replayed(spark, *names)
        made = gw.evaluate_windows(readings(spark, folder), formulas, schedule)
        return rounded(with_text_times(made, "window_start", "window_end"))

    return query


def window_schedule(spark: SparkSession, folder: str) -> DataFrame:
    schedule = gw.replay_schedule(customer_variables(spark, folder), END)
    return with_text_times(gw.window_schedule(schedule), "window_start", "window_end")


def due_windows(spark: SparkSession, folder: str) -> DataFrame:
    due = gw.due_windows(customer_variables(spark, folder), "2024-01-01 00:20:00")
    return with_text_times(due, "window_start", "window_end", "next_deadline")


def window_readings(spark: SparkSession, folder: str) -> DataFrame:
    formulas, schedule = replayed(spark, "W2", "W3", "W4")
    rows = gw.window_readings(readings(spark, folder), formulas, schedule)
    return with_text_times(rows, "window_start", "window_end")


def window_boundary(spark: SparkSession, folder: str) -> DataFrame:
    """Readings moved to full hours, so that many lie on an edge."""
    formulas, schedule = replayed(spark, "W1", "W2")
    hourly = readings(spark, folder).withColumn("created_on", F.date_trunc("hour", "created_on"))
    rows = gw.window_readings(hourly, formulas, schedule)
    return with_text_times(rows, "window_start", "window_end")


def windowed_zip(spark: SparkSession, folder: str) -> DataFrame:
    formulas, schedule = replayed(spark, "W2")
    return with_text_times(gw.aligned_readings(readings(spark, folder), formulas, schedule), "window_end")


# Results


def executed(spark: SparkSession, folder: str) -> DataFrame:
    table = fixtures.table(spark, fixtures.VARIABLES)
    formulas = gw.read_formulas(table)
    rows = readings(spark, folder)
    windows = gw.evaluate_windows(rows, formulas, gw.replay_schedule(formulas, END))
    return gw.all_executions(gw.evaluate(rows, formulas), windows, END)


def saved(spark: SparkSession, outcomes: DataFrame) -> str:
    """Outcomes written to result tables, as a service does; reports read those."""
    out = fresh_dir(spark, "results")
    attempt = results.write_outcomes(outcomes, out, 0)
    results.write_batch(spark, out, 0, attempt, last_processed_id=0, readings=0, as_of=None)
    return out


def saved_executions(spark: SparkSession, folder: str) -> DataFrame:
    table = results.executions(spark, saved(spark, executed(spark, folder)))
    # As if each had been saved at the time it speaks of.
    return table.withColumn("created_on", F.coalesce("window_end", "result_on"))


def all_executions(spark: SparkSession, folder: str) -> DataFrame:
    made = executed(spark, folder)
    return rounded(with_text_times(made, "result_on", "processed_on", "window_end"))


def _report(table: DataFrame) -> DataFrame:
    return rounded(with_text_times(table, "result_on", "processed_on", "window_end", "created_on"))


def executions_latest(spark: SparkSession, folder: str) -> DataFrame:
    made = saved_executions(spark, folder)
    return _report(gw.executions_latest(made, fixtures.table(spark, fixtures.VARIABLES)))


def executions_by_alias(spark: SparkSession, folder: str) -> DataFrame:
    made = saved_executions(spark, folder)
    variables = fixtures.table(spark, fixtures.VARIABLES)
    return _report(gw.executions_latest(made, variables, limit=50, alias="W"))


def executions_summary(spark: SparkSession, folder: str) -> DataFrame:
    made = saved_executions(spark, folder)
    made = gw.executions_summary(fixtures.table(spark, fixtures.VARIABLES), made)
    return rounded(with_text_times(made, "last_processed_on"), "max_result")


def batch_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Counters per batch of 200 readings; all windows are counted with the first batch."""
    rows = readings(spark, folder)
    formulas, schedule = replayed(spark, "W1", "W3", "W5")
    made = gw.evaluate(rows, fixtures.table(spark, fixtures.CONTINUOUS))
    windows = gw.evaluate_windows(rows, formulas, schedule)
    out = saved(spark, gw.all_executions(made, windows, END))
    batch = F.expr("coalesce(tag_id, 0) div 200")
    dead = results.failures(spark, out).withColumn("batch_id", batch)
    return gw.batch_stats(
        results.executions(spark, out).withColumn("batch_id", batch),
        dead,
        rows.withColumn("batch_id", F.expr("id div 200")),
    )


# Streams

BATCHES = 4


#: Rows of a batch's file. A batch of more is several files, which tasks write and read side by side.
ROWS_PER_FILE = 100_000


def in_batches(rows: DataFrame, part: Column, name: str) -> DataFrame:
    """``rows`` as a stream of ``BATCHES`` micro-batches, by the number ``part`` of each row's batch."""
    spark, path = rows.sparkSession, fresh_dir(rows.sparkSession, name)
    first = F.col(rows.columns[0])
    found = rows.groupBy(part.alias("part")).agg(F.count("*").alias("rows"), F.min(first), F.max(first)).collect()
    sizes, spans = [row.rows for row in found] or [0], {row.part: row[2:] for row in found}
    files = max(1, min(max(sizes) // ROWS_PER_FILE, min(sizes) // 16))
    for at in range(BATCHES):
        # As many files each as the source takes a batch, the oldest first. Rows are dealt
        # evenly, so that no file is missing.
        batch = rows.where(part == at)
        if at in spans:  # said in the rows' own numbers, which reach the scan
            batch = batch.where(first.between(*spans[at]))
        batch = batch.coalesce(1) if files == 1 else batch.repartition(files)
        batch.write.mode("append").parquet(path)
        time.sleep(0.02)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """All events as a stream of ``BATCHES`` micro-batches, in order of their ids."""
    rows = events(spark, folder)
    part = F.expr(f"event_id * {BATCHES} div {rows.agg(F.max('event_id')).first()[0] + 1}")
    return as_readings(in_batches(rows, part, "events"))


def drained(spark: SparkSession, folder: str, variables: Callable[[str], list[fixtures.Variable]], **how) -> str:
    """Run a stream over all events to its end; the path of its tables.

    ``variables`` gives the formulas, whenever they are read, from that path.
    """
    out = fresh_dir(spark, "stream")
    query = gw.start_stream(
        event_stream(spark, folder),
        lambda: fixtures.table(spark, variables(out)),
        out,
        f"{out}/checkpoint",
        **{"start": "earliest", "clock": "event", **how},
    )
    query.awaitTermination()
    return out


def _streamed(spark: SparkSession, out: str) -> DataFrame:
    done = results.executions(spark, out).select(
        "tag_id", "variable_id", "result", F.lit(None).cast("string").alias("error")
    )
    dead = results.failures(spark, out).select(
        "tag_id", "variable_id", F.lit(None).cast("double").alias("result"),
        F.col("error_message").alias("error"),
    )
    return done.unionByName(dead)


def stream_continuous(spark: SparkSession, folder: str) -> DataFrame:
    """Each batch under the latest values as they were after it."""
    return _streamed(spark, drained(spark, folder, lambda out: fixtures.CONTINUOUS))


def stream_replayed(spark: SparkSession, folder: str) -> DataFrame:
    """The last batch is run twice, as after a crash before its commit."""
    out = drained(spark, folder, lambda out: fixtures.CONTINUOUS)
    rows = readings(spark, folder)
    last = rows.where(f"id * {BATCHES} div {rows.agg(F.max('id')).first()[0] + 1} = {BATCHES - 1}")
    rerun_batch(last, lambda: fixtures.table(spark, fixtures.CONTINUOUS), out, BATCHES - 1, clock="event")
    return _streamed(spark, out)


def stream_latest_state(spark: SparkSession, folder: str) -> DataFrame:
    return gw.latest_state_table(spark, drained(spark, folder, lambda out: fixtures.CONTINUOUS))


def stream_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of the service, without the times."""
    out = drained(spark, folder, lambda out: fixtures.CONTINUOUS)
    return gw.service_stats(spark, out).drop("first_batch_at", "last_batch_at")


def stream_executions_newest(spark: SparkSession, folder: str) -> DataFrame:
    """The newest 100 executions by the time that they were saved at; only the last batch is read."""
    out = drained(spark, folder, lambda out: fixtures.CONTINUOUS)
    variables = fixtures.table(spark, fixtures.CONTINUOUS)
    made = gw.executions_latest(gw.newest_executions(spark, out, 100), variables)
    return rounded(made.select("variable_id", "variable_name", "tag_id", "result"))


def _windows_of(spark: SparkSession, out: str) -> DataFrame:
    done = results.executions(spark, out).select(
        "variable_id", "window_end", "result", F.lit(None).cast("string").alias("error")
    )
    dead = results.failures(spark, out)
    # A failed window is known by its variable only, as in the dead-letter table.
    dead = dead.select(
        "variable_id", F.lit(None).cast("timestamp").alias("window_end"),
        F.lit(None).cast("double").alias("result"), F.col("error_message").alias("error"),
    )
    return rounded(with_text_times(done.unionByName(dead), "window_end"))


def stream_windowed(spark: SparkSession, folder: str) -> DataFrame:
    out = drained(
        spark,
        folder,
        lambda out: fixtures.windowed("W1", "W2", "W3", "W5", "W6"),
        windows="replay",
        read_history=lambda: readings(spark, folder),
    )
    return _windows_of(spark, out)


def ticked(spark: SparkSession, folder: str) -> str:
    return drained(
        spark, folder, lambda out: fixtures.TICKED, windows="tick", read_history=lambda: readings(spark, folder)
    )


def stream_ticks(spark: SparkSession, folder: str) -> DataFrame:
    """At most one window per formula and batch: due, evaluated, and its deadline moved on."""
    return _windows_of(spark, ticked(spark, folder))


def stream_deadlines(spark: SparkSession, folder: str) -> DataFrame:
    """The deadlines after the last batch."""
    return with_text_times(gw.deadlines(spark, ticked(spark, folder)), "time_interval")


def stream_formula_refresh(spark: SparkSession, folder: str) -> DataFrame:
    """One service whose formula table is replaced after half of its batches."""

    def variables(out: str) -> list[fixtures.Variable]:
        first = results.batches(spark, out).count() < BATCHES // 2
        return fixtures.CONTINUOUS if first else fixtures.REPLACED

    return _streamed(spark, drained(spark, folder, variables, refresh_seconds=0))


def stream_window_state(spark: SparkSession, folder: str) -> DataFrame:
    """As ``stream_ticks``, windows firing from what the stream has kept of them."""
    out = drained(
        spark,
        folder,
        lambda out: fixtures.TICKED,
        windows="tick",
        read_history=lambda: readings(spark, folder),
        open_windows="state",
    )
    return _windows_of(spark, out)


def stream_window_replay(spark: SparkSession, folder: str) -> DataFrame:
    """As ``stream_windowed``, with the state of open windows."""
    out = drained(
        spark,
        folder,
        lambda out: fixtures.windowed("W1", "W2", "W3", "W5", "W6"),
        windows="replay",
        read_history=lambda: readings(spark, folder),
        open_windows="state",
    )
    return _windows_of(spark, out)


def bounded_log(spark: SparkSession, folder: str, parts: int, **how) -> DataFrame:
    """The log of a stream in order of ids, of just over 1 in ``parts`` of all rows a batch."""
    table = events(spark, folder)
    out, size = fresh_dir(spark, "stream"), table.count() // parts + 7
    source = gw.stream_by_id(spark, f"{folder}/events.parquet", table.schema, size, id_column="event_id")
    query = gw.start_stream(
        as_readings(source),
        lambda: fixtures.table(spark, fixtures.CONTINUOUS),
        out,
        f"{out}/checkpoint",
        start="earliest",
        clock="event",
        poll="0 seconds",
        **how,
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    made = results.executions(spark, out).groupBy("batch_id").agg(F.count("*").alias("successes"))
    log = results.batches(spark, out).select("batch_id", "readings", "last_processed_id")
    return log.join(made, "batch_id", "left")


def stream_bounded(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of a stream in order of ids, of just over a quarter of all rows at most."""
    return bounded_log(spark, folder, BATCHES)


def stream_folded_log(spark: SparkSession, folder: str) -> DataFrame:
    """The same with twice as many batches, of whose log three at a time are folded."""
    return bounded_log(spark, folder, 2 * BATCHES, fold_log=3)


def delayed(spark: SparkSession, folder: str) -> DataFrame:
    """Readings of which every seventh comes after all others, with an id to match."""
    rows = readings(spark, folder)
    size = rows.agg(F.max("id")).first()[0] + 1
    return rows.withColumn("id", F.when(F.col("id") % 7 == 0, F.col("id") + size).otherwise(F.col("id")))


def delayed_stream(spark: SparkSession, folder: str) -> str:
    """A stream over them in two batches of readings in time and two of late ones."""
    rows = delayed(spark, folder)
    size = readings(spark, folder).agg(F.max("id")).first()[0] + 1
    out = fresh_dir(spark, "stream")
    stream = in_batches(rows, F.expr(f"id * {BATCHES} div {2 * size}"), "delayed")
    query = gw.start_stream(
        stream,
        lambda: fixtures.table(spark, fixtures.LATE),
        out,
        f"{out}/checkpoint",
        start="earliest",
        clock="event",
        windows="replay",
        read_history=lambda: rows,
        open_windows="state",
    )
    query.awaitTermination()
    return out


def late_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Readings that no fired window has counted."""
    formulas = fixtures.table(spark, fixtures.LATE)
    late = gw.late_readings(spark, delayed_stream(spark, folder), delayed(spark, folder), formulas)
    return with_text_times(late, "window_start", "window_end")


def late_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows with late readings as they fired and as they are with them."""
    formulas = fixtures.table(spark, fixtures.LATE)
    made = gw.corrected_windows(spark, delayed_stream(spark, folder), delayed(spark, folder), formulas)
    made = rounded(rounded(made), "fired_result")
    return with_text_times(made, "window_start", "window_end")


QUERIES: dict[str, Query] = {
    "incremental_scan": incremental_scan,
    "start_offset": start_offset,
    "latest_values": latest_values,
    "window_readings": window_readings,
    "raw_data_latest": raw_data_latest,
    "raw_data_stats": raw_data_stats,
    "active_formulas": active_formulas,
    "formula_nodes": formula_nodes,
    "formula_list": formula_list,
    "formula_counts": formula_counts,
    "continuous_eval": outcomes_of(fixtures.CONTINUOUS),
    "unresolved_nodes": outcomes_of(fixtures.MISSING),
    "failed_executions": failed_executions,
    "invalid_formulas": outcomes_of(fixtures.INVALID),
    "fault_isolation": rounded_outcomes_of(fixtures.FAULTS),
    "whatif_scenarios": whatif_scenarios,
    **{name: rounded_outcomes_of(rows) for name, rows in fixtures.SCALARS.items()},
    "scalar_validate": scalar_validate,
    "window_schedule": window_schedule,
    "window_boundary": window_boundary,
    "due_windows": due_windows,
    "windowed_zip": windowed_zip,
    "windowed_sum": windows_of("W1", "W4"),
    "windowed_avg": windows_of("W2", "W6"),
    "windowed_last": windows_of("W3", "W7"),
    "windowed_errors": windows_of("W4", "W5", "W8"),
    "all_executions": all_executions,
    "executions_latest": executions_latest,
    "executions_by_alias": executions_by_alias,
    "executions_summary": executions_summary,
    "batch_stats": batch_stats,
    "stream_continuous": stream_continuous,
    "stream_latest_state": stream_latest_state,
    "stream_windowed": stream_windowed,
    "stream_formula_refresh": stream_formula_refresh,
    "stream_replayed": stream_replayed,
    "stream_totals": stream_totals,
    "stream_executions_newest": stream_executions_newest,
    "stream_ticks": stream_ticks,
    "stream_deadlines": stream_deadlines,
    "stream_window_state": stream_window_state,
    "stream_window_replay": stream_window_replay,
    "stream_bounded": stream_bounded,
    "stream_folded_log": stream_folded_log,
    "late_readings": late_readings,
    "late_windows": late_windows,
}

"""Formulas over a stream of readings.

All state is in tables below ``out_path``, keyed by batch:

* ``start``: the id after which this service started, written once;
* ``run``: the checkpoint that numbers its batches. With another one they would be
  numbered anew and hide or repeat those that are there, so it is refused;
* ``latest``: the latest value of each node, see :mod:`gaugework.streaming.latest_runs`;
* ``deadlines/slot=N``: the window deadlines after a batch, in three slots used in turn. A
  batch reads the slot of the batch before and writes its own, so running it again
  gives the same state;
* ``open``: what the windows that have not fired hold so far, see
  :mod:`gaugework.streaming.open_windows`;
* ``outcomes`` and ``batches``: see :mod:`gaugework.sources.results`.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugework import schemas
from gaugework.operators.continuous import evaluate
from gaugework.operators.formulas import FormulaSet, read_formulas
from gaugework.operators.latest import latest_state
from gaugework.operators.windows import (
    Held,
    due_windows,
    evaluate_windows,
    replay_schedule,
    tick_schedule,
)
from gaugework.plans.reports import all_executions
from gaugework.session import side_by_side
from gaugework.sources.readings import start_offset
from gaugework.sources.results import (
    FOLD,
    batches,
    read_if_present,
    write_batch,
    write_outcomes,
)
from gaugework.streaming import open_windows
from gaugework.streaming.latest_runs import LatestRuns

SLOTS = 3

#: The most readings of a batch that one task holds and evaluates.
ROWS_PER_TASK = 200_000
#: Shuffles to up to so many tasks are written as they come, without buffering rows.
MAX_TASKS = 200

# ``monotonically_increasing_id`` has a row's place in its partition in these bits.
PLACE = 2**33 - 1


@dataclass
class _Service:
    spark: SparkSession
    out_path: str
    read_variables: Callable[[], DataFrame]
    read_history: Callable[[], DataFrame] | None
    refresh_seconds: float
    clock: str
    delay: timedelta
    windows: str
    service_name: str
    open_windows: str = "history"
    fold_log: int = FOLD
    _formulas: FormulaSet | None = field(default=None, repr=False)
    _read_at: float = 0.0

    def formulas(self) -> FormulaSet:
        """The formulas, read again once they are ``refresh_seconds`` old."""
        now = time.monotonic()
        if self._formulas is None or now - self._read_at >= self.refresh_seconds:
            self._formulas, self._read_at = read_formulas(self.read_variables()), now
        return self._formulas

    def slot(self, name: str, batch_id: int, schema: str) -> DataFrame:
        which = f"slot={batch_id % SLOTS}" if batch_id >= 0 else "slot=start"
        return read_if_present(self.spark, f"{self.out_path}/{name}/{which}", schema)

    def keep(self, name: str, batch_id: int, table: DataFrame, schema: str) -> DataFrame:
        which = f"slot={batch_id % SLOTS}" if batch_id >= 0 else "slot=start"
        path = f"{self.out_path}/{name}/{which}"
        table.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def run(self, readings: DataFrame, batch_id: int) -> None:
        readings = readings.filter(F.col("id").isNotNull())
        seen = _seen(readings)
        readings = spread(readings, seen.readings, seen.largest).persist()
        try:
            self._run(readings, seen, batch_id)
        finally:
            readings.unpersist()

    def _run(self, readings: DataFrame, seen: Row, batch_id: int) -> None:
        before = self._before(batch_id)
        now = datetime.now(timezone.utc)
        as_of = self._as_of(now, seen.clock, before[1])
        formulas = self.formulas()

        runs = LatestRuns(self.spark, f"{self.out_path}/latest")
        high = max(value for value in (seen.last_id, before[0], 0) if value is not None)
        _, windowed = side_by_side(
            self.spark,
            lambda: runs.add(batch_id, latest_state(readings)),
            lambda: self._windows(formulas, batch_id, as_of, readings, high),
        )
        made = evaluate(readings, formulas, runs.after(batch_id).filter("value is not null"))
        outcomes = all_executions(made, windowed, now)
        attempt = write_outcomes(outcomes, self.out_path, batch_id)

        write_batch(
            self.spark,
            self.out_path,
            batch_id,
            attempt,
            last_processed_id=high,
            readings=seen.readings,
            as_of=as_of,
            updated_at=now,
            service_name=self.service_name,
            fold=self.fold_log,
        )

    def _before(self, batch_id: int) -> tuple[int | None, int | None]:
        """High-water mark and clock (in microseconds) of the batch before."""
        path = f"{self.out_path}/batches/batch_id={batch_id - 1}"
        if batch_id == 0:
            path = f"{self.out_path}/start"
        row = (
            read_if_present(self.spark, path, schemas.STATE)
            .select("last_processed_id", F.unix_micros("as_of"))
            .first()
        )
        return (row[0], row[1]) if row else (None, None)

    def _as_of(self, now: datetime, newest: int | None, before: int | None) -> int | None:
        if self.clock == "wall":
            return int(now.timestamp() * 1_000_000)
        if newest is not None:
            newest -= int(self.delay.total_seconds() * 1_000_000)
        return max((value for value in (newest, before) if value is not None), default=None)

    def _windows(
        self, formulas: FormulaSet, batch_id: int, as_of: int | None, readings: DataFrame, high: int
    ) -> DataFrame:
        """Outcomes of the windows that are due, and the next deadlines."""
        deadlines = self.slot("deadlines", batch_id - 1, schemas.DEADLINES)
        kept = deadlines.select("variable_id", F.col("time_interval").alias("_deadline"))
        table = formulas.table.join(kept, "variable_id", "left").withColumn(
            "time_interval", F.coalesce("_deadline", "time_interval")
        )
        formulas = replace(formulas, table=formulas.at_hand(table.drop("_deadline")))
        moment = F.timestamp_micros(F.lit(as_of).cast("long"))
        due = due_windows(formulas, moment)
        following = due.select("variable_id", F.col("next_deadline").alias("time_interval"))
        schedule = tick_schedule(due)
        if self.windows == "replay":
            schedule = replay_schedule(formulas, moment)
            length = F.make_interval(mins=F.col("minutes"))
            caught_up = schedule.select(
                "variable_id", (F.col("last_end") + length).alias("_caught_up")
            )
            following = following.join(caught_up, "variable_id", "left").select(
                "variable_id", F.coalesce("_caught_up", "time_interval").alias("time_interval")
            )
        if as_of is None:
            following = deadlines
            schedule = schedule.filter("false")
        self.require_history(formulas)
        following = formulas.at_hand(following)
        kept = self.keep("deadlines", batch_id, following, schemas.DEADLINES)
        following = following if formulas.bounded else kept
        held = None
        if self.open_windows == "state":
            held = self._held(formulas, batch_id, as_of, due, following, readings, high)
        # With the state of open windows at hand, only aggregates over several nodes read the history.
        if self.read_history and (held is None or "many" in formulas.kinds):
            history = self.read_history()
        else:
            history = self.spark.createDataFrame([], schemas.READINGS)
        return evaluate_windows(history, formulas, schedule, held=held)

    def _held(
        self,
        formulas: FormulaSet,
        batch_id: int,
        as_of: int | None,
        due: DataFrame,
        following: DataFrame,
        readings: DataFrame,
        high: int,
    ) -> Held:
        """What open windows hold after this batch, kept for the next."""
        before = Held(
            self.slot("open_totals", batch_id - 1, open_windows.TOTALS),
            self.slot("open_lasts", batch_id - 1, open_windows.LASTS),
        )
        marks_before = self.slot("open_marks", batch_id - 1, open_windows.MARKS)
        if as_of is None:
            after, marks_after = before, marks_before
        else:
            # A deadline that is passed over, and one never set, start anew from the next one.
            anew = F.col("action").isin("init", "stale" if self.windows == "tick" else "init")
            opened = due.join(formulas.table.select("variable_id", "time_interval"), "variable_id").select(
                "variable_id",
                F.unix_micros(F.when(anew, F.col("next_deadline")).otherwise(F.col("time_interval"))).alias("open_from"),
            )
            now = formulas.at_hand(open_windows.marks(formulas, opened))
            after = open_windows.merged(before, marks_before, now, formulas, readings, self.read_history, high)
            upcoming = following.select("variable_id", F.unix_micros("time_interval").alias("open_from"))
            marks_after = open_windows.marks(formulas, upcoming).drop("minutes")
        totals, lasts, _ = side_by_side(
            self.spark,
            lambda: self.keep("open_totals", batch_id, after.totals, open_windows.TOTALS),
            lambda: self.keep("open_lasts", batch_id, after.lasts, open_windows.LASTS),
            lambda: self.keep("open_marks", batch_id, marks_after, open_windows.MARKS),
        )
        return Held(totals, lasts)

    def require_history(self, formulas: FormulaSet) -> None:
        """Without readings to fill them, windows would be lost as deadlines move on."""
        if self.read_history is None and formulas.kinds - {"continuous"}:
            raise ValueError("windowed formulas need read_history")


def _seen(readings: DataFrame) -> Row:
    """Count, highest id and newest time of a batch, and the rows of its largest partition.

    Read before the batch is held, of these two columns only.
    """
    place = F.monotonically_increasing_id().bitwiseAND(PLACE)
    return readings.select("id", "created_on", place.alias("_place")).agg(
        F.count(F.lit(1)).alias("readings"),
        F.max("id").alias("last_id"),
        F.unix_micros(F.max(F.col("created_on").cast("timestamp"))).alias("clock"),
        (F.coalesce(F.max("_place") + 1, F.lit(0))).alias("largest"),
    ).first()


def spread(readings: DataFrame, count: int, largest: int) -> DataFrame:
    """A batch dealt over more tasks, if its source gave one of them too much of it.

    A source may deliver a large batch whole, as one row group of one file.
    """
    if largest <= ROWS_PER_TASK:
        return readings
    return readings.repartition(min(-(-count // ROWS_PER_TASK), MAX_TASKS), "id")


def start_stream(
    readings: DataFrame,
    read_variables: Callable[[], DataFrame],
    out_path: str,
    checkpoint: str,
    *,
    read_history: Callable[[], DataFrame] | None = None,
    start: str | int = "latest",
    refresh_seconds: float = 30,
    clock: str = "wall",
    delay: timedelta = timedelta(0),
    windows: str = "tick",
    poll: str | None = None,
    tick_every: timedelta | None = None,
    open_windows: str = "history",
    fold_log: int = FOLD,
    service_name: str = "gaugework",
) -> StreamingQuery:
    """Evaluate formulas over a stream of readings, batch by batch.

    ``read_variables`` and ``read_history`` are called to read the current
    formula table and the table of all readings; the latter is needed for
    windowed formulas and for ``start="latest"``. ``start`` is "earliest", an id
    to start after, or "latest" for the newest id at the first start; a restart
    keeps the id of the first.

    ``clock`` says when windows are due: "wall" by the time of day, "event" by
    the newest ``created_on`` seen, less ``delay``. ``windows`` is "tick" for at
    most one window per formula and batch, stale ones dropped, or "replay" for
    all windows since the last deadline. ``open_windows`` is where a window's readings come from when it
    fires: "history" reads them again from the table of all readings, "state" keeps what
    the stream has processed of each window, and reads no history but once for formulas that are
    new, changed or anchored anew, and for aggregates over several nodes.

    Without ``poll`` the stream ends when the source is drained, else it looks
    for new readings that often ("1 second"). Every ``fold_log`` batches the log of batches is
    folded into one table. A stream runs no batch without
    data; with ``tick_every`` due windows do not wait for the next reading.
    """
    if clock not in ("wall", "event") or windows not in ("tick", "replay"):
        raise ValueError("clock is 'wall' or 'event', windows is 'tick' or 'replay'")
    if open_windows not in ("history", "state"):
        raise ValueError("open_windows is 'history' or 'state'")
    if fold_log < 1:
        raise ValueError("fold_log is 1 or more")
    spark = readings.sparkSession
    service = _Service(
        spark=spark,
        out_path=out_path.rstrip("/"),
        read_variables=read_variables,
        read_history=read_history,
        refresh_seconds=refresh_seconds,
        clock=clock,
        delay=delay,
        windows=windows,
        service_name=service_name,
        open_windows=open_windows,
        fold_log=fold_log,
    )
    _bind(service, checkpoint)
    offset = _first_offset(service, start)
    source = readings.filter(F.col("id") > offset)
    if tick_every is not None:
        ticks = (
            spark.readStream.format("rate-micro-batch")
            .option("rowsPerBatch", 1)
            .option("advanceMillisPerBatch", int(tick_every.total_seconds() * 1000))
            .load()
        )
        source = source.unionByName(
            ticks.select(
                *(F.lit(None).cast(kind.dataType).alias(kind.name) for kind in readings.schema)
            )
        )
    writer = source.writeStream.foreachBatch(service.run).option("checkpointLocation", checkpoint)
    if tick_every is not None and poll is None:
        poll = f"{int(tick_every.total_seconds() * 1000)} milliseconds"
    trigger = {"availableNow": True} if poll is None else {"processingTime": poll}
    return writer.trigger(**trigger).start()


def rerun_batch(
    readings: DataFrame,
    read_variables: Callable[[], DataFrame],
    out_path: str,
    batch_id: int,
    *,
    read_history: Callable[[], DataFrame] | None = None,
    clock: str = "wall",
    delay: timedelta = timedelta(0),
    windows: str = "tick",
    open_windows: str = "history",
    fold_log: int = FOLD,
    service_name: str = "gaugework",
) -> None:
    """Run the last batch of a stopped service once more, over the same readings.

    Its outcomes are read as they were until the new ones are whole, see
    :mod:`gaugework.sources.results`; an earlier batch cannot be run again, as the state
    that it started from is gone.
    """
    spark, out_path = readings.sparkSession, out_path.rstrip("/")
    last = batches(spark, out_path).agg(F.max("batch_id")).first()[0]
    if last is not None and batch_id not in (last, last + 1):
        raise ValueError(f"the last batch is {last}")
    _Service(
        spark, out_path, read_variables, read_history, 0.0, clock, delay, windows, service_name, open_windows, fold_log
    ).run(readings, batch_id)


def batch_readings(spark: SparkSession, out_path: str, readings: DataFrame, batch_id: int) -> DataFrame:
    """The readings of a committed batch of a stream in order of ids, by the range of ids that the log gives it."""
    upto = {row.batch_id: row.last_processed_id for row in batches(spark, out_path).filter(
        F.col("batch_id").isin(batch_id - 1, batch_id)
    ).collect()}
    if batch_id not in upto:
        raise ValueError(f"batch {batch_id} is not committed")
    first = read_if_present(spark, f"{out_path}/start", schemas.STATE).first().last_processed_id
    return readings.filter((F.col("id") > upto.get(batch_id - 1, first)) & (F.col("id") <= upto[batch_id]))


def _bind(service: _Service, checkpoint: str) -> None:
    """Tie ``out_path`` to the checkpoint of its first start."""
    path, checkpoint = f"{service.out_path}/run", checkpoint.rstrip("/")
    bound = read_if_present(service.spark, path, "checkpoint string").first()
    if bound is None:
        service.spark.range(1).select(F.lit(checkpoint).alias("checkpoint")).write.mode("overwrite").parquet(path)
    elif bound.checkpoint != checkpoint:
        raise ValueError(f"{service.out_path} belongs to the checkpoint {bound.checkpoint}")


def latest_state_table(spark: SparkSession, out_path: str) -> DataFrame:
    """(node_id, id, value): the latest value of each node after the last committed batch."""
    last = batches(spark, out_path).agg(F.max("batch_id")).first()[0]
    return LatestRuns(spark, f"{out_path}/latest").after(-1 if last is None else last)


def deadlines(spark: SparkSession, out_path: str) -> DataFrame:
    """(variable_id, time_interval): the next deadline of each windowed formula after the last committed batch."""
    return _after_last_batch(spark, out_path, "deadlines", schemas.DEADLINES)


def _after_last_batch(spark: SparkSession, out_path: str, name: str, schema: str) -> DataFrame:
    last = batches(spark, out_path).agg(F.max("batch_id")).first()[0]
    which = "start" if last is None else last % SLOTS
    return read_if_present(spark, f"{out_path}/{name}/slot={which}", schema)


def _first_offset(service: _Service, start: str | int) -> int:
    """The id this service starts after: stored at the first start, then kept.

    The snapshot at that point comes from the history, as a service joining a
    running plant knows the latest values of all nodes.
    """
    spark, path = service.spark, f"{service.out_path}/start"
    stored = read_if_present(spark, path, schemas.STATE).first()
    if stored is not None:
        return stored.last_processed_id
    history = service.read_history() if service.read_history and start != "earliest" else None
    if start == "latest":
        if history is None:
            raise ValueError("start='latest' needs read_history")
        state = batches(spark, service.out_path)
        offset = start_offset(state, history, service.service_name).first()[0]
    else:
        offset = -(2**63) if start == "earliest" else int(start)
    if history is not None:
        known = latest_state(history.filter(F.col("id") <= offset))
        LatestRuns(spark, f"{service.out_path}/latest").start(known)
    spark.range(1).select(
        F.lit(service.service_name).alias("service_name"),
        F.lit(offset).cast("long").alias("last_processed_id"),
        F.current_timestamp().alias("updated_at"),
        F.lit(None).cast("timestamp").alias("as_of"),
        F.lit(0).cast("long").alias("readings"),
    ).write.mode("overwrite").parquet(path)
    return offset

"""Streams against batch, replays, restarts, live formula changes and ticks."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

import gaugework as gw
from gaugework import schemas
from gaugework.operators.latest import latest_state
from gaugework.sources import results
from gaugework.streaming.service import _Service

START = datetime(2024, 1, 1)
FORMULAS = [(1, "[a] + [b]"), (2, "sqrt([b] - 10)"), (3, "[a] / [gone]")]


def batch_rows(number, size=20):
    """The readings of one file: a and b in turn, one per minute."""
    return [
        (i, "ab"[i % 2], i, str(START + timedelta(minutes=i)))
        for i in range(number * size + 1, (number + 1) * size + 1)
    ]


@pytest.fixture
def plant(spark, tmp_path, readings_of):
    """A folder of readings that files can be added to."""

    class Plant:
        folder, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
        rows = []

        def add(self, number):
            rows = batch_rows(number)
            self.rows = [*self.rows, *rows]
            readings_of(rows).coalesce(1).write.mode("append").parquet(self.folder)
            time.sleep(0.05)  # the file source orders files by time

        def history(self):
            return spark.read.schema(schemas.READINGS).parquet(self.folder)

        def drain(self, variables, **how):
            stream = spark.readStream.schema(schemas.READINGS).option("maxFilesPerTrigger", 1)
            query = gw.start_stream(
                stream.parquet(self.folder),
                variables if callable(variables) else lambda: variables,
                self.out,
                self.checkpoint,
                **{"start": "earliest", "clock": "event", **how},
            )
            query.awaitTermination(120)
            return query

        def outcomes(self):
            saved = {
                (row.batch_id, row.tag_id, row.variable_id): row.result
                for row in results.executions(spark, self.out).collect()
            }
            dead = {
                (row.batch_id, row.tag_id, row.variable_id): row.error_message
                for row in results.failures(spark, self.out).collect()
            }
            assert not saved.keys() & dead.keys()
            return saved | dead

    return Plant()


def expected(readings_of, variables, numbers):
    """Batch results under the snapshot each batch would have seen."""
    made = {}
    for batch_id, number in enumerate(numbers):
        seen = readings_of([row for earlier in numbers[: batch_id + 1] for row in batch_rows(earlier)])
        outcome = gw.evaluate(readings_of(batch_rows(number)), variables, gw.latest_values(seen))
        for row in outcome.collect():
            made[batch_id, row.tag_id, row.variable_id] = row.result if row.error is None else row.error
    return made


def test_stream_is_batch_and_survives_restart_and_replay(spark, plant, readings_of, variables_of):
    variables = variables_of(*FORMULAS)
    for number in (0, 1):
        plant.add(number)
    plant.drain(variables)
    assert plant.outcomes() == expected(readings_of, variables, [0, 1])
    plant.drain(variables)  # nothing new
    plant.add(2)
    plant.drain(variables)
    whole = expected(readings_of, variables, [0, 1, 2])
    assert plant.outcomes() == whole

    # The last batch runs again, as after a crash before its commit.
    service = _Service(spark, plant.out, lambda: variables, None, 30, "event", timedelta(0), "tick", "gaugework")
    service.run(readings_of(batch_rows(2)), 2)
    assert plant.outcomes() == whole
    last = gw.latest_state_table(spark, plant.out)
    assert sorted(last.collect()) == sorted(latest_state(plant.history()).collect())
    marks = results.batches(spark, plant.out).orderBy("batch_id").collect()
    assert [(row.last_processed_id, row.readings) for row in marks] == [(20, 20), (40, 20), (60, 20)]
    stats = results.service_stats(spark, plant.out).first()
    assert (stats.total_tags_processed, stats.batches_processed) == (60, 3)
    assert stats.total_formulas_executed == sum(not isinstance(value, str) for value in whole.values())
    assert stats.first_batch_at < stats.last_batch_at


def test_uncommitted_batches_are_not_read(spark, plant, readings_of, variables_of):
    plant.add(0)
    plant.drain(variables_of(*FORMULAS))
    before = plant.outcomes()
    half_done = results.executions(spark, plant.out).limit(1).withColumn("error", F.lit(None).cast("string"))
    results.write_outcomes(half_done.drop("created_on", "batch_id"), plant.out, 1)
    assert plant.outcomes() == before


def test_starting_from_the_latest_reading(spark, plant, variables_of):
    plant.add(0)
    variables = variables_of((1, "[a] + [b]"))
    plant.drain(variables, start="latest", read_history=plant.history)
    assert plant.outcomes() == {}
    plant.add(1)
    plant.drain(variables, start="latest", read_history=plant.history)
    made = plant.outcomes()
    assert {key[1] for key in made} == set(range(21, 41))


def test_formulas_change_while_running(spark, plant, variables_of):
    for number in range(3):
        plant.add(number)
    reads = []

    def variables():
        reads.append(1)
        return variables_of((1, f"[a] * {len(reads)}"))

    plant.drain(variables, refresh_seconds=0)
    made = plant.outcomes()
    assert made[0, 2, 1] == 2.0 and made[1, 22, 1] == 44.0 and made[2, 42, 1] == 126.0
    assert len(reads) == 3


def test_formulas_are_kept_until_they_are_old(spark, plant, variables_of):
    for number in range(3):
        plant.add(number)
    reads = []

    def variables():
        reads.append(1)
        return variables_of((1, "[a]"))

    plant.drain(variables, refresh_seconds=3600)
    assert len(reads) == 1


def test_windows_by_tick_and_by_replay(spark, plant, variables_of):
    for number in range(3):
        plant.add(number)
    variables = variables_of(
        (1, "SUM([a])", 15, "2024-01-01 00:15:00"),
        (2, "SUM([b])", 5, "2024-01-01 00:05:00"),
        (3, "[gone]", 15, "2024-01-01 00:15:00"),
        (4, "SUM([a])", 15),
    )

    def ends(out):
        rows = results.executions(spark, out).orderBy("variable_id", "window_end").collect()
        return [(row.variable_id, row.batch_id, f"{row.window_end:%H:%M}", row.result) for row in rows]

    plant.drain(variables, read_history=plant.history)
    # Batches end at 00:20, 00:40 and 01:00. Formula 2 is stale at each of them.
    # Formula 4 is first seen at 00:20, so its windows end at 00:35 and 00:50.
    assert ends(plant.out) == [
        (1, 0, "00:15", sum(range(2, 16, 2))),
        (1, 1, "00:30", sum(range(16, 31, 2))),
        (1, 2, "00:45", sum(range(30, 46, 2))),
        (4, 1, "00:35", sum(range(20, 36, 2))),
        (4, 2, "00:50", sum(range(36, 51, 2))),
    ]
    dead = results.failures(spark, plant.out).collect()
    assert [row.error_message for row in dead] == ["NO_DATA_IN_WINDOW: gone"] * 3

    plant.out, plant.checkpoint = plant.out + "2", plant.checkpoint + "2"
    plant.drain(variables, read_history=plant.history, windows="replay")
    made = ends(plant.out)
    assert [row[2] for row in made if row[0] == 1] == ["00:15", "00:30", "00:45", "01:00"]
    assert [row[2] for row in made if row[0] == 2] == [f"{m // 60:02}:{m % 60:02}" for m in range(5, 61, 5)]


def test_ticks_fire_windows_without_readings(spark, plant, variables_of):
    plant.add(0)
    due = (datetime.now() + timedelta(seconds=5)).replace(microsecond=0)
    variables = variables_of((1, "SUM([a])", 60 * 24 * 365 * 20, str(due)))
    stream = spark.readStream.schema(schemas.READINGS).parquet(plant.folder)
    query = gw.start_stream(
        stream, lambda: variables, plant.out, plant.checkpoint,
        start="earliest", read_history=plant.history, tick_every=timedelta(seconds=2),
    )
    try:
        for _ in range(45):
            time.sleep(1)
            assert query.exception() is None
            if results.executions(spark, plant.out).filter("window_end is not null").count():
                break
        row = results.executions(spark, plant.out).filter("window_end is not null").first()
        assert row.result == sum(range(2, 21, 2)) and row.batch_id > 0
    finally:
        query.stop()


def test_windows_without_history_are_refused(plant, variables_of):
    plant.add(0)
    with pytest.raises(StreamingQueryException, match="read_history"):
        plant.drain(variables_of((1, "SUM([a])", 5, "2024-01-01 00:05:00")))


def test_another_checkpoint_is_refused(plant, readings_of, variables_of):
    variables = variables_of(*FORMULAS)
    plant.add(0)
    plant.drain(variables)
    checkpoint, plant.checkpoint = plant.checkpoint, plant.checkpoint + "-new"
    with pytest.raises(ValueError, match="belongs to the checkpoint"):
        plant.drain(variables)
    plant.checkpoint = checkpoint
    plant.add(1)
    plant.drain(variables)
    assert plant.outcomes() == expected(readings_of, variables, [0, 1])


def test_state_can_be_read_back(spark, plant, variables_of):
    assert gw.latest_state_table(spark, plant.out).count() == 0
    plant.add(0)
    plant.add(1)
    plant.drain(variables_of((1, "SUM([a])", 60, "2024-01-01 00:30:00")), read_history=plant.history)
    assert sorted(gw.latest_state_table(spark, plant.out).collect()) == sorted(latest_state(plant.history()).collect())
    deadline = gw.deadlines(spark, plant.out).first()
    assert deadline.variable_id == 1 and deadline.time_interval == datetime(2024, 1, 1, 1, 30)


def test_newest_executions_read_the_newest_batches_only(spark, plant, variables_of):
    for number in range(3):
        plant.add(number)
    variables = variables_of(*FORMULAS)
    plant.drain(variables)
    log = {row.batch_id: row for row in results.batches(spark, plant.out).collect()}
    made = list(plant.outcomes().items())
    for batch_id, row in log.items():
        values = [value for key, value in made if key[0] == batch_id]
        assert row.failures == sum(isinstance(value, str) for value in values)
        assert row.successes == len(values) - row.failures
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    for limit, since in ((1, 2), (log[2].successes, 2), (log[2].successes + 1, 1), (10_000, 0)):
        newest = gw.newest_executions(spark, plant.out, limit)
        assert {row.batch_id for row in newest.collect()} == set(range(since, 3))
        plan = newest._jdf.queryExecution().executedPlan().toString()
        assert f">= {since})" in plan.split("PartitionFilters: [")[1].split("]")[0]
    spark.conf.unset("spark.sql.maxMetadataStringLength")

"""What a stream keeps between batches, and how its batches are bounded and committed."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import gaugework as gw
from gaugework import schemas
from gaugework.operators.latest import latest_state
from gaugework.sources import results
from gaugework.sources.id_stream import FIRST, ById, ByIdReader
from gaugework.streaming import latest_runs, open_windows, service
from gaugework.streaming.latest_runs import LatestRuns, merged_at, runs_after
from tests.test_stream import FORMULAS, START, batch_rows, plant  # noqa: F401

EVERY_KIND = [
    (1, "SUM([a])", 15, "2024-01-01 00:15:00"),
    (2, "AVG([b] * 2)", 30, "2024-01-01 00:30:00"),
    (3, "[a] + [b]", 15, "2024-01-01 00:15:00"),
    (4, "SUM([a])", 15),
    (5, "[gone]", 15, "2024-01-01 00:15:00"),
    (6, "SUM([b])", 5, "2024-01-01 00:05:00"),
]


def windows_of(spark, out):
    rows = gw.fired_windows(spark, out).collect()
    return sorted((r.variable_id, str(r.window_end), r.batch_id, r.result, r.error) for r in rows)


@pytest.mark.parametrize("windows", ["tick", "replay"])
def test_windows_fire_from_state_as_from_history(spark, plant, variables_of, windows):  # noqa: F811
    for number in range(4):
        plant.add(number)
    variables = variables_of(*EVERY_KIND)
    plant.drain(variables, read_history=plant.history, windows=windows)
    wanted = windows_of(spark, plant.out)
    plant.out, plant.checkpoint = plant.out + "2", plant.checkpoint + "2"
    reads = []

    def history():
        reads.append(1)
        return plant.history()

    plant.drain(variables, read_history=history, windows=windows, open_windows="state")
    assert windows_of(spark, plant.out) == wanted and len(wanted) > 8
    # At the first batch, and by tick where formula 6 is stale and anchored anew.
    assert len(reads) <= (4 if windows == "tick" else 1)


def test_a_tick_scans_state_only(spark, plant, variables_of, monkeypatch):  # noqa: F811
    plans = []
    evaluate = service.evaluate_windows

    def watched(*given, **named):
        made = evaluate(*given, **named)
        plans.append(made._jdf.queryExecution().executedPlan().toString())
        return made

    monkeypatch.setattr(service, "evaluate_windows", watched)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    for number in range(3):
        plant.add(number)
    reads = []

    def history():
        reads.append(1)
        return plant.history()

    plant.drain(variables_of(*EVERY_KIND[:3]), read_history=history, open_windows="state")
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert len(reads) == 1 and len(plans) == 3
    assert all("open_totals" in plan and "open_lasts" in plan and plant.folder not in plan for plan in plans)
    assert len([row for row in windows_of(spark, plant.out) if row[4] is None]) >= 6


def test_a_changed_formula_gets_its_window_from_the_history_once(spark, plant, variables_of):  # noqa: F811
    for number in range(3):
        plant.add(number)
    batches = []

    def variables():
        batches.append(1)
        text = "SUM([a])" if len(batches) < 2 else "SUM([a] + 1)"
        return variables_of((1, text, 30, "2024-01-01 00:30:00"), (2, "[b]", 30, "2024-01-01 00:30:00"))

    reads = []

    def history():
        reads.append(1)
        return plant.history()

    plant.drain(variables, read_history=history, open_windows="state", refresh_seconds=0)
    made = {(row[0], row[1]): row[3] for row in windows_of(spark, plant.out)}
    first = [a + 1 for a in range(2, 31, 2)]
    second = [a + 1 for a in range(30, 61, 2)]
    assert made[1, "2024-01-01 00:30:00"] == sum(first) and made[1, "2024-01-01 01:00:00"] == sum(second)
    assert made[2, "2024-01-01 00:30:00"] == 29 and len(reads) == 2


def test_a_replayed_batch_leaves_the_same_state(spark, plant, readings_of, variables_of):  # noqa: F811
    for number in range(3):
        plant.add(number)
    variables = variables_of(*EVERY_KIND[:3])
    plant.drain(variables, read_history=plant.history, open_windows="state")

    def state():
        found = []
        for name, schema in (("totals", open_windows.TOTALS), ("lasts", open_windows.LASTS), ("marks", open_windows.MARKS)):
            rows = spark.read.schema(schema).parquet(f"{plant.out}/open_{name}/slot=2").collect()
            found.append(sorted(map(tuple, rows)))
        return found, sorted(gw.latest_state_table(spark, plant.out).collect())

    before, outcomes = state(), windows_of(spark, plant.out)
    rows = gw.batch_readings(spark, plant.out, plant.history(), 2)
    assert sorted(r.id for r in rows.collect()) == list(range(41, 61))
    gw.rerun_batch(
        rows, lambda: variables, plant.out, 2, read_history=plant.history, clock="event", open_windows="state"
    )
    assert state() == before and windows_of(spark, plant.out) == outcomes


def test_readers_see_the_old_rows_until_the_new_line_is_there(spark, plant, readings_of, variables_of, monkeypatch):  # noqa: F811
    plant.add(0)
    plant.add(1)
    plant.drain(variables_of(*FORMULAS))
    before, seen = plant.outcomes(), []
    commit = service.write_batch

    def between(*given, **named):
        seen.append(plant.outcomes())
        commit(*given, **named)

    monkeypatch.setattr(service, "write_batch", between)
    other = variables_of((1, "[a] + [b] + 1000"))
    gw.rerun_batch(readings_of(batch_rows(1)), lambda: other, plant.out, 1, clock="event")
    assert seen == [before]
    after = plant.outcomes()
    assert {k: v for k, v in after.items() if k[0] == 0} == {k: v for k, v in before.items() if k[0] == 0}
    assert all(value > 1000 for key, value in after.items() if key[0] == 1) and {k[2] for k in after if k[0] == 1} == {1}
    assert results.batches(spark, plant.out).count() == 2
    assert results.remove_superseded(spark, plant.out) == 1 and plant.outcomes() == after
    assert results.remove_superseded(spark, plant.out) == 0


@pytest.mark.parametrize("fan", [2, 3, 8])
def test_runs_cover_every_batch_once(fan):
    for batch in range(200):
        spans = [(last - fan**level + 1, last) for level, last in runs_after(batch, fan)]
        assert sorted(n for low, high in spans for n in range(low, high + 1)) == list(range(batch + 1))
        assert max(level for level, _ in runs_after(batch, fan)) >= merged_at(batch, fan)
    assert runs_after(-1, fan) == []


def test_runs_hold_the_latest_value(spark, tmp_path):
    runs = LatestRuns(spark, str(tmp_path / "latest"), fan=2)
    rows = lambda data: spark.createDataFrame(data, schemas.LATEST)
    runs.start(rows([("z", 0, 1.0), ("a", 0, 0.5)]))
    wanted = {"z": (0, 1.0), "a": (0, 0.5)}
    for batch in range(9):
        data = [("abc"[batch % 3], 10 * batch + 1, float(batch)), ("d", 10 * batch + 2, None)]
        for _ in range(2):  # again, as after a crash
            runs.add(batch, rows(data))
        wanted |= {node: (i, value) for node, i, value in data}
        assert {r.node_id: (r.id, r.value) for r in runs.after(batch).collect()} == wanted
        if batch:  # the state before can still be read, for a batch that runs again
            assert "d" in {r.node_id for r in runs.after(batch - 1).collect()}
    assert len(os.listdir(tmp_path / "latest")) < 9 + 3


def test_a_batch_writes_what_it_brings(spark, tmp_path):
    """A million nodes, a thousand readings a batch: what is written follows the batch."""
    path = tmp_path / "latest"
    runs = LatestRuns(spark, str(path))
    nodes = F.concat(F.lit("ns=2;s=Node"), "id").alias("node_id")
    runs.start(spark.range(1_000_000).select(nodes, "id", F.lit(1.0).alias("value")))

    def size(folder):
        return sum(os.path.getsize(os.path.join(at, name)) for at, _, names in os.walk(folder) for name in names)

    whole = size(path)
    for batch in range(latest_runs.FAN):
        brought = spark.range(1000).select(nodes, F.lit(2_000_000 + batch).cast("long").alias("id"), F.lit(2.0).alias("value"))
        before = size(path)
        runs.add(batch, brought)
        assert size(path) - before < whole / 50
    assert runs.after(batch).filter("value = 2.0").count() == 1000 and runs.after(batch).count() == 1_000_000


def reader(path, rows, after=FIRST):
    options = {"path": str(path), "idcolumn": "id", "rows": str(rows), "after": str(after)}
    return ByIdReader(options, None)


def test_batches_end_at_the_nth_id(spark, tmp_path):
    path = str(tmp_path / "in")
    ids = [7 * i % 1009 for i in range(1000)]  # no order within files
    for part in range(4):
        own = spark.createDataFrame([(i,) for i in ids if i // 260 == part], "id long")
        own.repartition(3).write.mode("append").parquet(path)
    known, at = sorted(set(ids)), -1
    source = reader(path, 130, -1)
    for batch in range(8):
        end = source.latestOffset()
        wanted = known[130 * batch : 130 * (batch + 1)]
        assert end == {"id": wanted[-1]}
        assert source.latestOffset() == end  # asked again before the batch is planned
        parts = source.partitions({"id": at}, end)
        assert all(p.group.high > at and p.group.low <= end["id"] for p in parts)
        source.commit(end)
        at = end["id"]
    assert source.latestOffset() == {"id": at}
    again = reader(path, 130, -1)  # after a restart Spark says where the stream is
    again.partitions({"id": 500}, {"id": 500})
    assert again.latestOffset() == {"id": known[known.index(500) + 130] if 500 in known else sorted(k for k in known if k > 500)[129]}
    assert reader(tmp_path / "nothing", 5).latestOffset() == {"id": FIRST}


def test_a_stream_in_order_of_ids_resumes(spark, plant, readings_of, variables_of):  # noqa: F811
    spark.dataSource.register(ById)
    rows = [row for number in (2, 0, 1) for row in batch_rows(number)]
    readings_of(rows).repartition(3).write.parquet(plant.folder)
    variables = variables_of(*FORMULAS)

    def run():
        stream = gw.stream_by_id(spark, plant.folder, schemas.READINGS, 25)
        query = gw.start_stream(
            stream, lambda: variables, plant.out, plant.checkpoint, start="earliest", clock="event", poll="0 seconds"
        )
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    run()
    log = lambda: [
        (r.batch_id, r.readings, r.last_processed_id) for r in results.batches(spark, plant.out).orderBy("batch_id").collect()
    ]
    assert log() == [(0, 25, 25), (1, 25, 50), (2, 10, 60)]
    readings_of(batch_rows(3)).write.mode("append").parquet(plant.folder)
    run()
    assert log() == [(0, 25, 25), (1, 25, 50), (2, 10, 60), (3, 20, 80)]
    seen = readings_of([row for number in range(4) for row in batch_rows(number)])
    assert sorted(gw.latest_state_table(spark, plant.out).collect()) == sorted(latest_state(seen).collect())
    assert {key[1] for key in plant.outcomes()} == set(range(1, 81))


def test_late_readings_and_corrected_windows(spark, plant, readings_of, variables_of):  # noqa: F811
    plant.add(0)
    late = [(21, "a", 1000, str(START + timedelta(minutes=5))), (22, "b", "x", str(START + timedelta(minutes=6)))]
    late += [(23, "a", 7, str(START + timedelta(minutes=15))), (24, "c", 7, str(START + timedelta(minutes=5)))]
    late += [(25, "b", 9, str(START + timedelta(minutes=40)))]
    readings_of(late).coalesce(1).write.mode("append").parquet(plant.folder)
    variables = variables_of(*EVERY_KIND[:1], (3, "[a] + [b]", 15, "2024-01-01 00:15:00"))
    how = {"read_history": plant.history, "windows": "replay", "open_windows": "state"}
    plant.drain(variables, **how)
    found = gw.late_readings(spark, plant.out, plant.history(), variables).collect()
    first, second = datetime(2024, 1, 1, 0, 15), datetime(2024, 1, 1, 0, 30)
    assert sorted((r.variable_id, r.window_end, r.id) for r in found) == [(1, first, 21), (1, first, 23), (3, first, 21), (3, first, 23)]
    counts = {(r.variable_id, r.window_end): (r.late, r.first_late_id) for r in gw.late_counts(gw.late_readings(spark, plant.out, plant.history(), variables)).collect()}
    assert counts == {(1, first): (2, 21), (3, first): (2, 21)}
    made = {r.variable_id: r for r in gw.corrected_windows(spark, plant.out, plant.history(), variables).collect()}
    assert made[1].fired_result == sum(range(2, 16, 2)) and made[1].result == made[1].fired_result + 1007
    assert made[3].fired_result == 14 + 15 and made[3].result == 7 + 15
    fired = {(r.variable_id, r.window_end): r.result for r in gw.fired_windows(spark, plant.out).collect()}
    assert fired[1, second] == sum(range(16, 21, 2)) + 7  # id 23 lies on the edge, and came before this one fired


def log_of(spark, out):
    rows = results.log_lines(spark, out).orderBy("batch_id").collect()
    return [(r.batch_id, r.readings, r.last_processed_id, r.successes, r.failures, r.attempt) for r in rows]


def folders(out, name):
    return sorted(int(entry.split("=")[1]) for entry in os.listdir(f"{out}/{name}") if "=" in entry)


def test_the_log_is_folded_and_reads_as_before(spark, plant, readings_of, variables_of):  # noqa: F811
    for number in range(8):
        plant.add(number)
    variables = variables_of(*FORMULAS)
    plant.drain(variables, fold_log=3)
    # Folded after batches 3 and 6; the lines that the first fold took up went with the second.
    assert folders(plant.out, "folded") == [2, 5] and folders(plant.out, "batches") == [3, 4, 5, 6, 7]
    folded, outcomes = log_of(spark, plant.out), plant.outcomes()
    assert [line[0] for line in folded] == list(range(8)) and {line[1] for line in folded} == {20}
    stats = results.service_stats(spark, plant.out).first()
    assert (stats.total_tags_processed, stats.batches_processed) == (160, 8)
    assert results.newest_executions(spark, plant.out, 10**6).count() == results.executions(spark, plant.out).count()
    # The last batch can still run again, and a stream goes on from there.
    gw.rerun_batch(readings_of(batch_rows(7)), lambda: variables, plant.out, 7, clock="event", fold_log=3)
    again = log_of(spark, plant.out)
    assert [line[:5] for line in again] == [line[:5] for line in folded] and again[7][5] != folded[7][5]
    assert plant.outcomes() == outcomes and results.remove_superseded(spark, plant.out) == 1
    plant.out, plant.checkpoint = plant.out + "2", plant.checkpoint + "2"
    plant.drain(variables)
    assert plant.outcomes() == outcomes
    assert [line[:5] for line in log_of(spark, plant.out)] == [line[:5] for line in folded]


def test_a_fold_that_was_cut_short_is_not_read(spark, tmp_path):
    out = str(tmp_path / "out")

    def commit(batch, attempt):
        results.write_batch(
            spark, out, batch, attempt, last_processed_id=batch * 10, readings=10, as_of=None, fold=4
        )

    for batch in range(4):
        commit(batch, f"a{batch}")
    before = log_of(spark, out)
    half = results.log_lines(spark, out).limit(1)
    half.write.parquet(f"{out}/folded/upto=3")
    os.remove(f"{out}/folded/upto=3/_SUCCESS")
    assert results.folded_upto(spark, out) == -1 and log_of(spark, out) == before
    # The batch that was folding is run again: it has two lines, the newer counts, and the fold is whole.
    commit(4, "a4")
    commit(4, "b4")
    assert results.folded_upto(spark, out) == 3
    assert log_of(spark, out) == [*before, (4, 10, 40, 0, 0, "b4")]
    for batch in range(5, 10):
        commit(batch, f"a{batch}")
    assert folders(out, "folded") == [3, 7] and folders(out, "batches") == list(range(4, 10))
    assert log_of(spark, out)[4][5] == "b4"
    results.fold_log(spark, out, 7)
    results.fold_log(spark, out, 8)
    assert folders(out, "folded") == [7, 8] and folders(out, "batches") == [8, 9]
    assert [line[0] for line in log_of(spark, out)] == list(range(10))


def test_a_batch_of_one_row_group_is_dealt_over_tasks(spark, plant, variables_of, monkeypatch):  # noqa: F811
    """The file source delivers each batch in one partition; no task holds more than its share."""
    from gaugework.streaming import service

    held = []
    run = service._Service._run

    def counted(self, readings, seen, batch_id):
        sizes = readings.groupBy(F.spark_partition_id()).count().collect()
        held.append((seen.largest, max(row["count"] for row in sizes), sum(row["count"] for row in sizes)))
        return run(self, readings, seen, batch_id)

    monkeypatch.setattr(service, "ROWS_PER_TASK", 5)
    monkeypatch.setattr(service._Service, "_run", counted)
    plant.add(0)
    plant.add(1)
    plant.drain(variables_of(*FORMULAS))
    assert [(largest, total) for largest, _, total in held] == [(20, 20)] * 2
    assert all(most < 20 for _, most, _ in held)
    split = plant.outcomes()
    monkeypatch.undo()
    assert split and {tag for _, tag, _ in split} >= set(range(12, 41))


@pytest.mark.parametrize("name", ["stream_continuous", "late_readings"])
def test_a_batch_of_several_files_is_one_batch(spark, monkeypatch, name):
    import os

    from checks import catalog
    from checks.compare import database, difference
    from checks.oracles import ORACLES

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    monkeypatch.setattr(catalog, "ROWS_PER_FILE", 50)
    paths = []
    fresh = catalog.fresh_dir

    def noted(spark, kind):
        paths.append(fresh(spark, kind))
        return paths[-1]

    monkeypatch.setattr(catalog, "fresh_dir", noted)
    made = catalog.QUERIES[name](spark, folder).toPandas()
    source = next(path for path in paths if "stream-" not in path.rsplit("/", 1)[1])
    files = len(spark.read.parquet(source).inputFiles())
    assert files % catalog.BATCHES == 0 and files > catalog.BATCHES
    assert difference(made, database(folder).execute(ORACLES[name]).df()) is None


def test_what_a_batch_asks_of_its_formulas_is_at_hand(spark, plant, variables_of, monkeypatch):  # noqa: F811
    """Deadlines and schedules are as small as the formulas: read once, not by each of a batch's plans."""
    plans = []
    evaluate = service.evaluate_windows

    def watched(readings, formulas, schedule, **named):
        plans.extend(table._jdf.queryExecution().optimizedPlan().toString() for table in (schedule, formulas.table))
        return evaluate(readings, formulas, schedule, **named)

    monkeypatch.setattr(service, "evaluate_windows", watched)
    for number in range(2):
        plant.add(number)
    plant.drain(variables_of(*EVERY_KIND), read_history=plant.history, windows="replay", open_windows="state")
    assert len(plans) == 4 and all(plan.startswith("LocalRelation") for plan in plans)
    assert windows_of(spark, plant.out)


def test_steps_side_by_side_end_together(spark):
    from gaugework.session import side_by_side

    ended = []

    def fails():
        raise ValueError("first")

    def named():
        ended.append(spark.sparkContext.getLocalProperty("spark.job.description"))
        return spark.range(3).count()

    spark.sparkContext.setJobDescription("caller")
    try:
        assert side_by_side(spark, named, lambda: 1) == [3, 1]
        with pytest.raises(ValueError, match="first"):
            side_by_side(spark, fails, named)
    finally:
        spark.sparkContext.setJobDescription(None)
    assert ended == ["caller", "caller"]


def test_formulas_without_windows_start_no_job_for_them(spark, plant, variables_of):  # noqa: F811
    plant.add(0)
    schedule = gw.replay_schedule(variables_of(*FORMULAS), "2024-01-02 00:00:00")
    made = gw.evaluate_windows(plant.history(), variables_of(*FORMULAS), schedule)
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    other = gw.evaluate_windows(plant.history(), variables_of(*EVERY_KIND), schedule)
    assert made.schema.simpleString() == other.schema.simpleString()
    assert made.count() == 0


def test_a_batch_is_read_by_the_range_of_its_rows(spark, monkeypatch, tmp_path):
    from checks import catalog

    spark.range(1000).withColumnRenamed("id", "event_id").write.parquet(f"{tmp_path}/events")
    rows = spark.read.parquet(f"{tmp_path}/events")
    monkeypatch.setattr(catalog, "fresh_dir", lambda spark, name: f"{tmp_path}/{name}")
    wheres, where = [], type(rows).where
    monkeypatch.setattr(type(rows), "where", lambda self, test: wheres.append(where(self, test)) or wheres[-1])
    catalog.in_batches(rows, F.expr(f"event_id * {catalog.BATCHES} div 1000"), "stream")
    plans = [table._jdf.queryExecution().optimizedPlan().toString() for table in wheres]
    assert sum("event_id#" in plan and "<= 499" in plan and ">= 250" in plan for plan in plans) == 1
    assert sorted(row[0] for row in spark.read.parquet(f"{tmp_path}/stream").collect()) == list(range(1000))

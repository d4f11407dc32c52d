from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import gaugework as gw
from gaugework.operators import windows
from gaugework.operators.positions import positions_by_range, with_positions

DAY = "2024-01-01 "


def at(text):
    return datetime.fromisoformat(DAY + text)


def results(readings, variables, as_of, **how):
    formulas = gw.read_formulas(variables)
    made = gw.evaluate_windows(readings, formulas, gw.replay_schedule(formulas, as_of), **how)
    return {
        (row.variable_id, row.window_end.strftime("%H:%M")): row.result if row.error is None else row.error
        for row in made.collect()
    }


@pytest.fixture
def plant(readings_of):
    return readings_of(
        [
            (1, "a", 1, DAY + "00:01"),
            (2, "b", 10, DAY + "00:02"),
            (3, "a", 2, DAY + "00:03"),
            (4, "a", "abc", DAY + "00:04"),
            (5, "a", 3, DAY + "00:05"),
            (6, "b", 20, DAY + "00:10"),
            (7, "a", 4, DAY + "00:10"),
            (8, "a", 5, DAY + "00:10"),
            (9, "c", -1, DAY + "00:30"),
        ]
    )


def test_windows_are_closed_at_both_ends(plant, variables_of):
    made = results(plant, variables_of((1, "SUM([a])", 10, DAY + "00:10")), DAY + "00:35")
    assert made == {
        (1, "00:10"): 15.0,  # the readings at 00:10 count here
        (1, "00:20"): 9.0,  # and here
        (1, "00:30"): "NO_DATA_IN_WINDOW: a",
    }


def test_aligned_rows_stop_at_the_shortest_node(plant, variables_of):
    variables = variables_of((1, "AVG([a] + [b])", 10, DAY + "00:10"))
    assert results(plant, variables, DAY + "00:10") == {(1, "00:10"): (11 + 22) / 2}
    formulas = gw.read_formulas(variables)
    rows = gw.aligned_readings(plant, formulas, gw.replay_schedule(formulas, DAY + "00:10"))
    assert sorted((row.position, row.x0, row.x1) for row in rows.collect()) == [(0, 1.0, 10.0), (1, 2.0, 20.0)]


def test_kinds_of_windowed_formulas(plant, variables_of):
    variables = variables_of(
        (1, "AVG(sqrt([c]))", 10, DAY + "00:30"),
        (2, "AVG([a] + [gone])", 10, DAY + "00:10"),
        (3, "[a] + [b]", 10, DAY + "00:10"),
        (4, "[a] + [gone] + [gone]", 10, DAY + "00:10"),
        (5, "[gone] + [lost]", 10, DAY + "00:10"),
        (6, "SUM([a]) / 2", 10, DAY + "00:10"),
        (7, "AVG([a], [b])", 10, DAY + "00:10"),
        (8, "1 + 1", 10, DAY + "00:10"),
        (9, "SUM([a] + )", 10, DAY + "00:10"),
        (10, "foo([a])", 10, DAY + "00:10"),
        (11, "SUM(10 / ([a] - 2))", 10, DAY + "00:10"),
        (12, "SUM([a])", 10),
        (13, "SUM([b] * [b] + [b])", 10, DAY + "00:10"),
    )
    first = {key[0]: value for key, value in results(plant, variables, DAY + "00:10").items()}
    assert first == {
        2: "NO_COMPUTABLE_ROWS_IN_WINDOW",
        3: 25.0,
        4: "UNRESOLVED_NODE: gone, gone",
        5: "NO_DATA_IN_WINDOW: gone, lost",
        6: 2.5,
        7: 12.5,
        9: "NO_COMPUTABLE_ROWS_IN_WINDOW",
        10: "COMPILE_ERROR: Compile error: Unsafe function: foo",
        11: pytest.approx(-10 + 10 + 5 + 10 / 3),
        13: 110.0 + 420.0,
    }
    assert results(plant, variables, DAY + "00:30")[1, "00:30"] == "NO_COMPUTABLE_ROWS_IN_WINDOW"


def test_formulas_share_windows_only_on_the_same_grid(plant, variables_of):
    variables = variables_of(
        (1, "[a] + [b]", 10, DAY + "00:10"),
        (2, "[a] * [b]", 10, DAY + "00:20"),
        (3, "[a] - [b]", 10, DAY + "00:13"),
        (4, "[a] - [b]", 5, DAY + "00:10"),
    )
    assert results(plant, variables, DAY + "00:20") == {
        (1, "00:10"): 25.0,
        (1, "00:20"): 25.0,
        (2, "00:20"): 100.0,
        (3, "00:13"): -15.0,
        (4, "00:10"): -15.0,
        (4, "00:15"): -15.0,
        (4, "00:20"): "NO_DATA_IN_WINDOW: a, b",
    }


def test_large_formula_tables(plant, variables_of):
    variables = variables_of(
        (1, "SUM([a])", 10, DAY + "00:10"), (2, "AVG([a] + [b])", 10, DAY + "00:10"),
        (3, "[a] + [b]", 5, DAY + "00:05"), (4, "[gone]", 10, DAY + "00:20"),
    )
    expected = results(plant, variables, DAY + "00:30")
    large = gw.read_formulas(variables, max_formulas=1)
    schedule = gw.replay_schedule(large, DAY + "00:30")
    made = gw.evaluate_windows(plant, large, schedule).collect()
    assert len(made) == len(expected) == 3 + 3 + 6 + 2
    for row in made:
        key = (row.variable_id, row.window_end.strftime("%H:%M"))
        assert expected[key] == (row.result if row.error is None else row.error)


def test_schedules_longer_than_one_array(spark, variables_of, monkeypatch):
    variables = variables_of((1, "[a]", 1, DAY + "00:00"), (2, "[a]", 7, DAY + "00:03"))
    schedule = gw.replay_schedule(variables, DAY + "02:00")
    whole = gw.window_schedule(schedule).collect()
    monkeypatch.setattr(windows, "WINDOWS_PER_ROW", 3)
    monkeypatch.setattr(windows, "WINDOWS_PER_TASK", 40)
    assert sorted(gw.window_schedule(schedule).collect()) == sorted(whole)
    assert len(whole) == 121 + 17


def test_positions_of_a_hot_group_match_row_numbers(spark):
    # Half of the rows in one group, many of them at the same moment.
    rows = spark.range(20_000).select(
        F.expr("CASE WHEN id % 2 = 0 THEN 'hot' ELSE 'n' || (id % 13) END").alias("node"),
        F.expr("CASE WHEN id % 3 = 0 THEN 5 ELSE (id * 7919) % 1000 END").alias("at"),
        "id",
    )
    plain = with_positions(rows, ["node"], ["at", "id"])
    ranged = positions_by_range(rows, ["node"], ["at", "id"])
    assert plain.exceptAll(ranged).count() == 0
    assert ranged.exceptAll(plain).count() == 0
    # Only the hot group goes by ranges.
    mixed = with_positions(rows, ["node"], ["at", "id"], rows_per_task=5_000)
    assert mixed.exceptAll(plain).count() == 0 and plain.exceptAll(mixed).count() == 0


def test_a_hot_group_is_cut_into_ranges(spark, tmp_path):
    # Small test partitions would be joined again.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(20_000).select(F.lit("hot").alias("node"), F.lit(5).alias("at"), "id")
        ranged = positions_by_range(rows, ["node"], ["at", "id"])
        sizes = ranged.groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) > 1 and max(row["count"] for row in sizes) < 20_000
        assert ranged.filter("position <> id").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_alignment_by_ranges_gives_the_same_results(spark, plant, variables_of):
    variables = variables_of((1, "AVG([a] + [b])", 10, DAY + "00:10"), (2, "SUM([a] - [b])", 5, DAY + "00:05"))
    assert results(plant, variables, DAY + "00:20", rows_per_task=0) == results(plant, variables, DAY + "00:20")


@pytest.mark.parametrize(
    "as_of, action, following",
    [
        ("00:09:59.999999", "wait", "00:10"),
        ("00:10", "run", "00:20"),
        ("00:20", "run", "00:20"),
        ("00:20:00.000001", "stale", "00:30:00.000001"),
    ],
)
def test_due(variables_of, as_of, action, following):
    row = gw.due_windows(variables_of((1, "[a]", 10, DAY + "00:10")), DAY + as_of).first()
    assert (row.action, row.next_deadline) == (action, at(following))
    expected = (at("00:00"), at("00:10")) if action == "run" else (None, None)
    assert (row.window_start, row.window_end) == expected


def test_first_sight_and_formulas_without_nodes(variables_of):
    variables = variables_of((1, "[a]", 10), (2, "1 + 1", 10, DAY + "00:10"), (3, "[a]"))
    rows = {row.variable_id: row for row in gw.due_windows(variables, DAY + "00:12").collect()}
    assert {key: row.action for key, row in rows.items()} == {1: "init", 2: "advance"}
    assert rows[1].next_deadline == at("00:22") and rows[2].next_deadline == at("00:20")


def test_tick_reads_only_its_window(plant, variables_of):
    formulas = gw.read_formulas(variables_of((1, "SUM([a])", 10, DAY + "00:10")))
    schedule = gw.tick_schedule(gw.due_windows(formulas, DAY + "00:15"))
    row = gw.evaluate_windows(plant, formulas, schedule).first()
    assert (row.result, row.window_start, row.window_end) == (15.0, at("00:00"), at("00:10"))
    nothing = gw.tick_schedule(gw.due_windows(formulas, DAY + "00:05"))
    assert gw.evaluate_windows(plant, formulas, nothing).count() == 0


def test_window_readings_against_a_range_join(spark, readings_of, variables_of):
    start = at("00:00")
    rows = readings_of(
        [
            (i, "ab"[i % 2], i, str(start + timedelta(seconds=(i * 37) % 3600 if i % 3 else 300 * (i % 12))))
            for i in range(400)
        ]
    )
    variables = variables_of((1, "[a] + [b]", 5, DAY + "00:05"), (2, "[a]", 7, DAY + "00:03:20"))
    formulas = gw.read_formulas(variables)
    schedule = gw.replay_schedule(formulas, DAY + "01:00")
    made = gw.window_readings(rows, formulas, schedule)
    nodes = gw.formula_nodes(variables).withColumnRenamed("node_id", "n")
    plain = (
        gw.window_schedule(schedule)
        .join(nodes, "variable_id")
        .join(rows, F.expr("node_id = n AND created_on BETWEEN window_start AND window_end"))
    ).select("variable_id", "node_id", "window_start", "window_end", "id", F.col("value").cast("double"))
    assert made.count() == plain.count() > 0
    assert made.exceptAll(plain).count() == 0

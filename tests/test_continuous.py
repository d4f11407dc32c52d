import pytest

import gaugework as gw
from gaugework.operators.formulas import FormulaSet
from gaugework.operators.latest import latest_state

T = "2024-01-01 00:00:00"


def found(table):
    return {
        (row.tag_id, row.variable_id): row.result if row.error is None else row.error
        for row in table.collect()
    }


def test_own_reading_overrides_the_snapshot(readings_of, variables_of):
    rows = readings_of([(1, "a", 1, T), (2, "b", 10, T), (3, "a", 2, T)], "double")
    made = found(gw.evaluate(rows, variables_of((7, "[a] + [b]"), (8, "[b] * 2"), (9, "1 + 1"))))
    # The snapshot is the latest of the whole table, also for earlier readings.
    assert made == {(1, 7): 11.0, (2, 7): 12.0, (3, 7): 12.0, (2, 8): 20.0}


def test_a_formula_fires_once_per_reading(readings_of, variables_of):
    rows = readings_of([(1, "a", 3, T)])
    assert found(gw.evaluate(rows, variables_of((1, "[a] + [a] * [a]")))) == {(1, 1): 12.0}


def test_names_match_whole_and_by_case(readings_of, variables_of):
    rows = readings_of([(1, "ab", 3, T), (2, "A", 3, T)])
    assert found(gw.evaluate(rows, variables_of((1, "[a]")))) == {}


def test_bad_latest_value_hides_the_older_one(readings_of):
    rows = readings_of([(1, "a", 5, T), (2, "a", "abc", T), (3, "b", "1_000", T), (4, None, 1, T)])
    latest = {row.node_id: (row.id, row.value) for row in gw.latest_values(rows).collect()}
    assert latest == {"b": (3, 1000.0)}
    assert {row.node_id: row.id for row in latest_state(rows).collect()} == {"a": 2, "b": 3}


def test_bad_readings_are_failures(readings_of, variables_of):
    bad = [None, "abc", "nan", "-inf", "1.5d", "0x10", " 4 ", "1e3"]
    rows = readings_of([(at, "a", value, T) for at, value in enumerate(bad)])
    made = found(gw.evaluate(rows, variables_of((1, "[a] * 2"))))
    codes = ["NULL_VALUE", "INVALID_TYPE", "NAN_VALUE", "INFINITE_VALUE", "INVALID_TYPE", "INVALID_TYPE"]
    assert [made[at, 1] for at in range(8)] == [*codes, 8.0, 2000.0]


def test_order_of_checks(readings_of, variables_of):
    rows = readings_of([(1, "a", None, T), (2, "b", "nan", T), (3, "c", 1, T)])
    variables = variables_of(
        (1, "foo([a]) + [gone]"), (2, "foo([a])"), (3, "[c] + [b]"), (4, "1 if [c] else [b]")
    )
    made = found(gw.evaluate(rows, variables))
    assert made[1, 1] == "UNRESOLVED_NODE: gone"
    assert made[1, 2] == "NULL_VALUE"
    assert made[3, 3] == "VALUE_ERROR: Variable 'nan' not in context"
    assert made[2, 3] == "NAN_VALUE"
    assert made[3, 4] == 1.0


def test_wide_formulas(readings_of, variables_of):
    count = 40
    rows = readings_of([(at, f"n{at}", at, T) for at in range(count)])
    mean = "AVG(" + ", ".join(f"[n{at}]" for at in range(count)) + ")"
    last = f"[n0] + [n{count - 1}]"
    made = found(gw.evaluate(rows, variables_of((1, mean), (2, last), (3, mean + " * [gone]"))))
    assert {made[at, 1] for at in range(count)} == {(count - 1) / 2}
    assert made[0, 2] == made[count - 1, 2] == count - 1
    assert made[5, 3] == "UNRESOLVED_NODE: gone"


def test_large_formula_tables_are_read_in_tasks(spark, readings_of, variables_of):
    nodes = ["hot"] * 60 + ["a", "b", "c"] * 10
    rows = readings_of([(at, node, at % 7, T) for at, node in enumerate(nodes)], "double")
    variables = variables_of(
        *((at, f"[{node}] {op} {at}") for at, (node, op) in enumerate(
            (node, op) for node in ("hot", "a", "b", "gone") for op in "+-*/")),
        (50, "[hot] + [a]"), (51, "[gone] + [a]"), (52, "foo([a])"),
    )
    small = gw.read_formulas(variables)
    large = gw.read_formulas(variables, max_formulas=3)
    assert isinstance(large, FormulaSet) and small.bounded and not large.bounded
    expected = found(gw.evaluate(rows, small))
    assert len(expected) == 60 * 5 + 10 * (4 + 3) + 10 * 4
    assert found(gw.evaluate(rows, large)) == expected


def test_active_formulas_and_nodes(spark, variables_of):
    table = spark.sql(
        """SELECT * FROM VALUES
        (1L, 'b', '[x] + [y] + [x]', '', 5, NULL, false), (2L, 'a', '', 'SINGLE', 0, NULL, false),
        (3L, 'c', NULL, 'SINGLE', 0, NULL, false), (4L, 'd', '[x]', 'PAIR', NULL, NULL, false),
        (5L, 'e', '[x]', 'PAIR', NULL, NULL, true)
        AS t(variable_id, variable_name, pre_save_formula, formula_type, time, time_interval, is_deleted)"""
    )
    rows = gw.active_formulas(table).orderBy("variable_id").collect()
    assert [(r.variable_id, r.formula_type, r.minutes, r.is_windowed) for r in rows] == [
        (1, "SINGLE", 5, True),
        (4, "PAIR", 0, False),
    ]
    nodes = gw.formula_nodes(table).orderBy("variable_id", "pos").collect()
    assert [tuple(row) for row in nodes] == [(1, 0, "x"), (1, 1, "y"), (4, 0, "x")]
    assert gw.formula_counts(table).first().asDict() == {"single": 2, "pair": 0, "total": 2}
    assert [row.variable_name for row in gw.formula_list(table).collect()] == ["b", "d"]


def test_new_readings_and_start_offset(spark, readings_of):
    rows = readings_of([(at, "a", at, T) for at in (5, 1, 9, 7)])
    assert [row.id for row in gw.new_readings(rows, 1, 2).collect()] == [5, 7]
    state = "service_name string, last_processed_id bigint"

    def offset(*marks):
        table = spark.createDataFrame([("gaugework", mark) for mark in marks], state)
        return gw.start_offset(table, rows).first()[0]

    assert (offset(), offset(0), offset(4)) == (9, 9, 4)
    nothing = spark.createDataFrame([], state)
    assert gw.start_offset(nothing, rows.limit(0)).first()[0] == 0


def test_readings_are_scanned_once_for_any_number_of_shapes(spark, readings_of, variables_of, tmp_path, monkeypatch):
    from gaugework.operators import continuous

    monkeypatch.setattr(continuous, "SHAPES_PER_PASS", 4)
    rows = [(i, "ab"[i % 2], float(i), f"2024-01-01 00:00:{i:02d}") for i in range(1, 21)]
    path = str(tmp_path / "readings")
    readings_of(rows, "double").write.parquet(path)
    variables = variables_of(*((i, "[a]" + " + [b]" * i) for i in range(1, 19)), (90, "foo([a])"))
    written = []
    keep = continuous.stored

    def watched(df, *how):
        plan = df._jdf.queryExecution().executedPlan().toString()
        written.append(plan.count("ReadSchema: struct<id:bigint,node_id:string,value:double,timestamp"))
        return keep(df, *how)

    monkeypatch.setattr(continuous, "stored", watched)
    made = gw.evaluate(spark.read.parquet(path), variables)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert written == [1] and path not in plan
    found = {(r.variable_id, r.tag_id): r.result for r in made.collect()}
    latest = {"a": 20.0, "b": 19.0}
    for i in range(1, 19):
        for tag, node, value, _ in rows:
            own = {**latest, node: value}
            assert found[i, tag] == pytest.approx(own["a"] + i * own["b"])
    assert {k for k in found if k[0] == 90} == {(90, tag) for tag, node, *_ in rows if node == "a"}

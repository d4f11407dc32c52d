"""No formula may disturb another one, whatever its text."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import gaugework as gw
from gaugework.functions.formula_text import read_formula
from gaugework.operators.formulas import _record

ROWS = [(1, "a", 2.5, "2024-01-01 00:00:00"), (2, "b", 4.0, "2024-01-01 00:00:01")]
PARTS = ["[a]", "[b]", "x1", "x0", "k", "ops", "1", "2.5", "1e999", "+", "-", "*", "/", "^", "%", "(", ")", ",", "IF ", " THEN ",
         " ELSE ", "round(", "pow(", "max(", "avg(", " and ", " or ", "not ", "<", "==", "'", '"', "[", "]", "lambda", ".", ":", "\n", "é"]
ODD = st.one_of(st.lists(st.sampled_from(PARTS), max_size=25).map("".join), st.text(max_size=30))


@settings(max_examples=500, deadline=None)
@given(ODD)
def test_any_text_can_be_read(text):
    record = _record(1, 0, None, text)
    assert (record["shape"] is None) == (record["compile_error"] is not None)


@pytest.mark.parametrize("most", [10_000, 1])
@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=st.lists(ODD, min_size=30, max_size=30))
def test_a_neighbour_keeps_its_rows(spark, readings_of, variables_of, most, texts):
    odd = [(i + 2, "[a] " + text) for i, text in enumerate(texts)]
    variables = variables_of((1, "[a] * 2"), *odd)
    made = gw.evaluate(readings_of(ROWS), gw.read_formulas(variables, max_formulas=most)).collect()
    assert [r.result for r in made if r.variable_id == 1] == [5.0]
    assert {r.variable_id for r in made if r.tag_id == 1} == {1, *(i for i, _ in odd)}


@pytest.mark.parametrize("nodes", [1, 2, 12])
def test_generated_names_are_never_a_users(nodes):
    mentioned = " + ".join(f"[n{i}]" for i in range(nodes))
    for name in [p + str(i) for p in ("x", "xx", "xxx") for i in range(nodes + 1)] + ["x", "k", "k0", "v", "a", "_add", "ops"]:
        made = read_formula(f"{mentioned} * {name}")
        assert made.shape is not None and made.shape.count(name) == 1 + ("x[" in made.shape) * (name == "x") * nodes


@pytest.mark.parametrize("how", ["table", "set"])
def test_every_scenario_has_a_row(spark, variables_of, how):
    variables = variables_of((1, "[a] * 2"), (2, " "), (3, None))
    rows = [(i, v, {"a": 3.0}) for i, v in enumerate((1, 2, 3, 99))]
    scenarios = spark.createDataFrame(rows, "scenario_id long, variable_id long, tags map<string,double>")
    made = gw.evaluate_scenarios(scenarios, variables if how == "table" else gw.read_formulas(variables)).collect()
    errors = {r.variable_id: r.error for r in made}
    empty = "COMPILE_ERROR: Empty formula" if how == "table" else "UNKNOWN_VARIABLE"
    assert errors == {1: None, 2: empty, 3: empty, 99: "UNKNOWN_VARIABLE"}


@pytest.mark.parametrize("formula, tasks", [("[a] * 2", 1), ("[a]" + " + [b]" * 400, 2)])
def test_readings_of_long_formulas_are_dealt_over_tasks(readings_of, variables_of, formula, tasks):
    rows = [(i, "ab"[i % 2], i, "2024-01-01 00:00:00") for i in range(100)]
    made = gw.evaluate(readings_of(rows).coalesce(1), variables_of((1, formula)))
    found = made.select("tag_id", F.spark_partition_id().alias("task")).collect()
    assert min(len({r.task for r in found}), 2) == tasks
    assert sorted(r.tag_id for r in found) == [i for i in range(100) if tasks == 2 or i % 2 == 0]

"""Empty inputs."""

import gaugework as gw

T = "2024-01-01 00:00:00"


def test_no_formulas(readings_of, variables_of):
    rows = readings_of([(1, "a", 1, T)])
    for variables in (variables_of((1, "")), variables_of((1, "1 + 1")), variables_of((1, "foo([b])"))):
        formulas = gw.read_formulas(variables)
        assert gw.evaluate(rows, formulas).count() == 0
        schedule = gw.replay_schedule(formulas, T)
        assert gw.evaluate_windows(rows, formulas, schedule).count() == 0
        assert gw.window_readings(rows, formulas, schedule).count() == 0
        assert gw.aligned_readings(rows, formulas, schedule).count() == 0
        assert gw.window_schedule(schedule).count() == 0


def test_only_broken_formulas(readings_of, variables_of):
    rows = readings_of([(1, "a", 1, T)])
    made = gw.evaluate(rows, variables_of((1, "foo([a])"))).first()
    assert made.error == "COMPILE_ERROR: Compile error: Unsafe function: foo"


def test_no_readings(readings_of, variables_of):
    rows = readings_of([(1, "a", 1, T)]).limit(0)
    formulas = gw.read_formulas(
        variables_of((1, "[a]"), (2, "AVG([a] + [b])", 5, T), (3, "SUM([a])", 5, T), (4, "[a]", 5, T))
    )
    assert gw.evaluate(rows, formulas).count() == 0
    made = gw.evaluate_windows(rows, formulas, gw.replay_schedule(formulas, T)).collect()
    assert sorted((row.variable_id, row.error) for row in made) == [
        (2, "NO_DATA_IN_WINDOW: a, b"),
        (3, "NO_DATA_IN_WINDOW: a"),
        (4, "NO_DATA_IN_WINDOW: a"),
    ]
    assert gw.latest_values(rows).count() == 0
    assert gw.executions_summary(
        variables_of((1, "[a]")),
        gw.all_executions(gw.evaluate(rows, formulas), gw.evaluate_windows(rows, formulas, gw.replay_schedule(formulas, T)).limit(0), T),
    ).first().total_executions == 0

import gaugework as gw

T = "2024-01-01 00:00:0"


def executions(spark, rows):
    """(variable_id, tag_id, result, second, deleted)"""
    values = ", ".join(
        f"({v}L, {t}L, double({r}), timestamp'{T}{s}', {str(d).lower()})" for v, t, r, s, d in rows
    )
    return spark.sql(
        "SELECT variable_id, tag_id, result, at AS result_on, at AS processed_on, at AS created_on, "
        "CAST(NULL AS timestamp) AS window_end, is_deleted "
        f"FROM VALUES {values} AS t(variable_id, tag_id, result, at, is_deleted)"
    )


def test_summary_keeps_variables_that_never_ran(spark, variables_of):
    variables = variables_of((1, "[a]"), (2, "[b]", 5), (3, ""))
    runs = executions(
        spark, [(1, 1, 5, 1, False), (1, 2, 3, 2, False), (1, 3, 99, 3, True), (7, 4, 1, 1, False)]
    )
    rows = gw.executions_summary(variables, runs).collect()
    assert [(r.variable_name, r.current_interval, r.total_executions, r.max_result) for r in rows] == [
        ("V1", 0, 2, 5.0),
        ("V2", 5, 0, None),
        ("V3", 0, 0, None),
    ]
    assert str(rows[0].last_processed_on) == f"{T}2"


def test_latest_executions(spark, variables_of):
    variables = variables_of((1, "[a]"), (12, "[b]"), (2, "[c]"))
    runs = executions(
        spark,
        [(1, 1, 5, 1, False), (12, 2, 3, 2, False), (2, 3, 4, 3, False), (12, 4, 1, 4, True), (9, 5, 1, 5, False)],
    )
    everything = gw.executions_latest(runs, variables, limit=3).collect()
    assert [(row.variable_id, row.variable_name) for row in everything] == [(9, None), (2, "V2"), (12, "V12")]
    some = gw.executions_latest(runs, variables, alias="V1").collect()
    assert [row.variable_name for row in some] == ["V12", "V1"]


def test_raw_data(spark, readings_of):
    rows = readings_of([(1, "x.y.a", 1, T + "1"), (2, "b", "bad", T + "2"), (3, None, 3, T + "2")])
    newest = gw.raw_data_latest(rows, 2).collect()
    assert [(row.id, row.alias, row.value) for row in newest] == [(3, "", 3.0), (2, "b", None)]
    stats = gw.raw_data_stats(rows, T + "3").first()
    assert (stats.tags_per_second, stats.distinct_nodes) == (2, 2)
    assert gw.raw_data_stats(rows.limit(0), T + "3").first().tags_per_second == 0


def test_batch_stats(spark):
    def table(*batches):
        return spark.createDataFrame([(batch,) for batch in batches], "batch_id bigint")

    rows = gw.batch_stats(table(1, 1, 2), table(2), table(0, 1, 1, 2)).orderBy("batch_id").collect()
    assert [tuple(row) for row in rows] == [(0, 1, 0, 0), (1, 2, 2, 0), (2, 1, 1, 1)]

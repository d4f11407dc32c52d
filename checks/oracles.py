"""The registered queries in SQL for DuckDB, written independently of Spark plans."""

from __future__ import annotations

from checks import fixtures
from checks.fixtures import NODES, Variable

END = "TIMESTAMP '2024-01-31 00:00:00'"
MIDDLE = "TIMESTAMP '2024-01-15 12:00:00'"

READINGS = """readings AS (
    SELECT event_id AS id, event_type AS short, 'ns=2;s=Line1.' || event_type AS node_id, value, ts
    FROM events)"""


def stamp(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S.%f')"


def snapshot(value: str = "value") -> str:
    latest = ", ".join(
        f"arg_max({value}, id) FILTER (WHERE short = '{name}') AS {name}" for name in NODES
    )
    own = ", ".join(
        f"CASE WHEN r.short = '{name}' THEN r.value ELSE s.{name} END AS {name}" for name in NODES
    )
    return (
        f"snap AS (SELECT {latest} FROM readings),\n"
        f"t AS (SELECT r.id, r.short, r.ts, {own} FROM readings r CROSS JOIN snap s)"
    )


def outcomes(variables: list[Variable], columns: str = "id AS tag_id") -> str:
    """Selects over ``t``, one per formula."""
    parts = []
    for each in variables:
        nodes = ", ".join(f"'{name}'" for name in each.nodes)
        parts.append(
            f"SELECT {columns}, CAST({each.id} AS BIGINT) AS variable_id, "
            f"CASE WHEN e IS NULL THEN CAST(v AS DOUBLE) END AS result, CAST(e AS VARCHAR) AS error "
            f"FROM (SELECT *, {each.failure} AS e, {each.value} AS v FROM t "
            f"WHERE short IN ({nodes}))"
        )
    return "\nUNION ALL\n".join(parts)


def continuous(variables: list[Variable], digits: int | None = None) -> str:
    result = "result" if digits is None else f"round(result, {digits})"
    return (
        f"WITH {READINGS},\n{snapshot()}\n"
        f"SELECT tag_id, variable_id, {result} AS result, error FROM (\n{outcomes(variables)})"
    )


CUSTOMER_VARIABLES = """variables AS (
    SELECT c_custkey AS variable_id, c_name AS variable_name,
        CASE c_custkey % 7
            WHEN 0 THEN NULL
            WHEN 1 THEN ''
            WHEN 2 THEN u || '.click] * 0.001'
            WHEN 3 THEN 'AVG(' || u || '.view] + ' || u || '.click])'
            WHEN 4 THEN u || '.view] / ' || u || '.click] + ' || u || '.view]'
            WHEN 5 THEN '1 + 1'
            ELSE 'IF (' || u || '.error] > 100) THEN 1 ELSE 0' END AS pre_save_formula,
        CASE c_nationkey % 4 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN 'SINGLE' ELSE 'PAIR' END
            AS formula_type,
        CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE c_nationkey * 60 END AS time,
        CASE WHEN c_custkey % 3 <> 0 THEN TIMESTAMP '2023-12-31 00:00:00'
            + to_minutes(CAST(c_custkey % 1500 AS INT)) END AS time_interval,
        c_acctbal < 0 AS is_deleted
    FROM (SELECT *, '[ns=2;s=User' || (1 + c_custkey % 1500) AS u FROM customer)),
active AS (
    SELECT *, coalesce(time, 0) AS minutes FROM variables
    WHERE NOT is_deleted AND pre_save_formula IS NOT NULL AND pre_save_formula <> '')"""


def windows(variables: list[Variable]) -> str:
    """``w``: every window up to END, one row each."""
    parts = [
        f"SELECT CAST({each.id} AS BIGINT) AS variable_id, "
        f"unnest(generate_series(TIMESTAMP '{each.anchor}', {END}, INTERVAL '{each.minutes}' MINUTE))"
        f" AS window_end, INTERVAL '{each.minutes}' MINUTE AS length"
        for each in variables
    ]
    return (
        "w AS (SELECT variable_id, window_end - length AS window_start, window_end FROM ("
        + " UNION ALL ".join(parts)
        + "))"
    )


def in_windows(variables: list[Variable], clock: str = "r.ts") -> str:
    """``n``: the readings of each window, numbered per node."""
    pairs = ", ".join(f"({each.id}, '{name}')" for each in variables for name in each.nodes)
    return (
        f"n AS (SELECT w.*, r.node_id, r.short, r.id, r.value, row_number() OVER "
        f"(PARTITION BY w.variable_id, w.window_end, r.short ORDER BY {clock}, r.id) - 1 AS position "
        f"FROM w JOIN (VALUES {pairs}) AS p(variable_id, short) ON p.variable_id = w.variable_id "
        f"JOIN readings r ON r.short = p.short AND {clock} BETWEEN w.window_start AND w.window_end)"
    )


def windowed(*names: str) -> str:
    """Outcomes of the named windowed formulas: w, n and ``done``."""
    variables = fixtures.windowed(*names)
    click, view = (f"max(value) FILTER (WHERE short = '{name}')" for name in ("click", "view"))
    last_click, last_view = (
        f"arg_max(value, position) FILTER (WHERE short = '{name}')" for name in ("click", "view")
    )
    made = {
        "W1": "SELECT variable_id, window_end, sum(value) AS v, NULL AS e FROM n WHERE variable_id = 10 GROUP BY ALL",
        "W2": "SELECT variable_id, window_end, avg(c + d) AS v, CASE WHEN count(c + d) = 0 THEN "
        f"'NO_COMPUTABLE_ROWS_IN_WINDOW' END AS e FROM (SELECT variable_id, window_end, position, {click} AS c, "
        f"{view} AS d FROM n WHERE variable_id = 11 GROUP BY ALL) GROUP BY ALL",
        "W3": f"SELECT variable_id, window_end, ({last_click} + {last_view}) / 2.0::DOUBLE AS v, "
        "CASE WHEN count(DISTINCT short) < 2 THEN 'UNRESOLVED_NODE: ns=2;s=Line1.' || "
        "CASE max(short) WHEN 'view' THEN 'click' ELSE 'view' END END AS e "
        "FROM n WHERE variable_id = 12 GROUP BY variable_id, window_end",
        "W4": "SELECT variable_id, window_end, sum(value) AS v, NULL AS e FROM n WHERE variable_id = 13 GROUP BY ALL",
        "W5": "SELECT variable_id, window_end, NULL AS v, 'NO_COMPUTABLE_ROWS_IN_WINDOW' AS e "
        "FROM n WHERE variable_id = 14 GROUP BY ALL",
        "W6": "SELECT variable_id, window_end, avg(s) AS v, CASE WHEN count(s) = 0 THEN "
        "'NO_COMPUTABLE_ROWS_IN_WINDOW' END AS e FROM (SELECT *, CASE WHEN value >= 50 THEN "
        "sqrt(value - 50) END AS s FROM n WHERE variable_id = 15) GROUP BY variable_id, window_end",
        "W7": f"SELECT variable_id, window_end, {last_click} / 2.0::DOUBLE AS v, NULL AS e "
        "FROM n WHERE variable_id = 16 GROUP BY variable_id, window_end",
    }
    parts = [
        f"SELECT variable_id, window_end, CAST(v AS DOUBLE) AS v, CAST(e AS VARCHAR) AS e FROM ({made[name]})"
        for name in names
    ]
    no_data = "CASE w.variable_id " + " ".join(
        f"WHEN {each.id} THEN 'NO_DATA_IN_WINDOW: "
        + ", ".join(
            sorted(
                fixtures.node(name)
                for name in NODES + fixtures.ABSENT
                if "{" + name + "}" in each.formula
            )
        )
        + "'"
        for each in variables
    ) + " END"
    return (
        f"{windows(variables)},\n{in_windows(variables)},\ndone AS (\n"
        "SELECT w.variable_id, w.window_start, w.window_end, "
        "CASE WHEN f.variable_id IS NOT NULL AND f.e IS NULL THEN f.v END AS result, "
        f"CASE WHEN f.variable_id IS NULL THEN {no_data} ELSE f.e END AS error FROM w LEFT JOIN (\n"
        + "\nUNION ALL\n".join(parts)
        + ") f ON f.variable_id = w.variable_id AND f.window_end = w.window_end)"
    )


def window_rows(*names: str) -> str:
    return (
        f"WITH {READINGS},\n{windowed(*names)}\nSELECT variable_id, {stamp('window_start')} AS window_start, "
        f"{stamp('window_end')} AS window_end, round(result, 8) AS result, error FROM done"
    )


def window_readings(names: tuple[str, ...], clock: str = "r.ts") -> str:
    variables = fixtures.windowed(*names)
    return (
        f"WITH {READINGS},\n{windows(variables)},\n{in_windows(variables, clock)}\n"
        f"SELECT variable_id, node_id, {stamp('window_start')} AS window_start, "
        f"{stamp('window_end')} AS window_end, id, value FROM n"
    )


ALL_WINDOWED = ("W1", "W2", "W3", "W4", "W5", "W6", "W7")
RAN = [each for each in fixtures.CONTINUOUS + fixtures.UNUSED if not each.deleted and each.nodes]


def executed() -> str:
    """``ex``: all outcomes with their times."""
    return (
        f"WITH {READINGS},\n{snapshot()},\n{windowed(*ALL_WINDOWED)},\nex AS (\n"
        f"SELECT variable_id, tag_id, result, error, ts AS result_on, NULL::TIMESTAMP AS window_end, "
        f"ts AS created_on FROM ({outcomes(RAN, 'id AS tag_id, ts')})\n"
        f"UNION ALL SELECT variable_id, NULL, result, error, {END}, window_end, window_end FROM done),\n"
        f"variables({fixtures.COLUMNS}) AS ({fixtures.values(fixtures.VARIABLES, 'VARCHAR')})"
    )


def executions_latest(where: str, limit: int) -> str:
    return (
        f"{executed()}\nSELECT e.variable_id, v.variable_name, v.pre_save_formula AS formula, e.tag_id, "
        f"round(e.result, 8) AS result, {stamp('e.result_on')} AS result_on, {stamp(END)} AS processed_on, "
        f"{stamp('e.window_end')} AS window_end, {stamp('e.created_on')} AS created_on "
        f"FROM ex e LEFT JOIN variables v ON v.variable_id = e.variable_id WHERE e.error IS NULL{where} "
        f"ORDER BY e.created_on DESC, e.variable_id, e.tag_id NULLS FIRST, e.window_end NULLS FIRST LIMIT {limit}"
    )


NUMBER = """CASE id % 11 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 'NaN'::DOUBLE
    WHEN 3 THEN 'Infinity'::DOUBLE WHEN 4 THEN '-Infinity'::DOUBLE WHEN 5 THEN 1000.5 WHEN 6 THEN NULL
    WHEN 7 THEN 12 ELSE value END"""

VALIDATE = f"""WITH raw AS (
    SELECT event_id AS id, event_type AS short, 'ns=2;s=Line1.' || event_type AS node_id,
        event_id % 11 AS k, value FROM events),
readings AS (SELECT id, short, node_id, k, {NUMBER} AS value FROM raw),
last AS (
    SELECT max(click) AS click, max(view) AS view FROM (
        SELECT CASE WHEN r.short = 'click' THEN r.value END AS click,
            CASE WHEN r.short = 'view' THEN r.value END AS view
        FROM readings r WHERE id IN (SELECT max(id) FROM readings GROUP BY short))),
t AS (
    SELECT r.id, r.short, r.value, r.k,
        CASE WHEN r.short = 'click' THEN r.value ELSE l.click END AS click,
        CASE WHEN r.short = 'view' THEN r.value ELSE l.view END AS view,
        CASE WHEN r.k = 0 THEN 'NULL_VALUE' WHEN r.k IN (1, 6) THEN 'INVALID_TYPE'
            WHEN r.k = 2 THEN 'NAN_VALUE' WHEN r.k IN (3, 4) THEN 'INFINITE_VALUE' END AS bad,
        CASE r.short WHEN 'click' THEN l.view ELSE l.click END AS other,
        CASE r.short WHEN 'click' THEN 'view' ELSE 'click' END AS other_name
    FROM readings r CROSS JOIN last l WHERE r.short IN ('click', 'view'))
SELECT id AS tag_id, 1::BIGINT AS variable_id, CASE WHEN bad IS NULL THEN view * 2 END AS result, bad AS error
FROM t WHERE short = 'view'
UNION ALL
SELECT id, 2, CASE WHEN e IS NULL THEN view + click END, e FROM (
    SELECT *, CASE
        WHEN other IS NULL THEN 'UNRESOLVED_NODE: ns=2;s=Line1.' || other_name
        WHEN bad IS NOT NULL THEN bad
        WHEN isnan(other) THEN 'VALUE_ERROR: Variable ''nan'' not in context'
        WHEN isinf(other) THEN 'VALUE_ERROR: Variable ''inf'' not in context' END AS e FROM t)"""


def scenarios() -> str:
    """Each user's highest value per node in place of readings."""
    highest = ", ".join(f"max(value) FILTER (WHERE event_type = '{name}') AS {name}" for name in NODES)
    parts = []
    for each in fixtures.SCENARIOS:
        missing = " || ".join(
            f"CASE WHEN {name} IS NULL THEN ', {fixtures.node(name)}' ELSE '' END"
            for name in sorted(each.nodes, key=lambda name: each.formula.index("{" + name + "}"))
        )
        if each.name == "V4":  # every mention counts, in formula order
            missing = " || ".join(
                f"CASE WHEN {name} IS NULL THEN ', {fixtures.node(name)}' ELSE '' END"
                for name in ("view", "error", "view", "error")
            )
        parts.append(
            f"SELECT user_id AS scenario_id, {each.id}::BIGINT AS variable_id, "
            "CASE WHEN e IS NULL THEN CAST(v AS DOUBLE) END AS result, e AS error FROM ("
            f"SELECT user_id, coalesce(CASE WHEN m <> '' THEN 'UNRESOLVED_NODE: ' || m[3:] END, {each.failure}) AS e, "
            f"{each.value} AS v FROM (SELECT *, {missing} AS m FROM u))"
        )
    for each in (fixtures.EMPTY, fixtures.DELETED, fixtures.UNKNOWN):
        parts.append(
            f"SELECT user_id AS scenario_id, {each.id}::BIGINT AS variable_id, NULL::DOUBLE AS result, "
            f"{each.failure} AS error FROM u"
        )
    return f"WITH u AS (SELECT user_id, {highest} FROM events GROUP BY user_id)\n" + "\nUNION ALL\n".join(parts)


PARTS = 4
LATEST_OF = ", ".join(f"arg_max(value, id) FILTER (WHERE short = '{name}') AS {name}" for name in NODES)
OWN_OR_LATEST = ", ".join(f"CASE WHEN r.short = '{name}' THEN r.value ELSE s.{name} END AS {name}" for name in NODES)
# Each batch of a stream sees the latest values as they are at its own end.
BATCHED = f"""{READINGS},
parts AS (SELECT *, id * {PARTS} // (max(id) OVER () + 1) AS part FROM readings),
snap AS (SELECT p.part, {LATEST_OF} FROM (SELECT DISTINCT part FROM parts) p JOIN parts r ON r.part <= p.part GROUP BY p.part),
t AS (SELECT r.id, r.short, r.ts, r.part, {OWN_OR_LATEST} FROM parts r JOIN snap s ON s.part = r.part)"""
STREAMED = f"WITH {BATCHED}\nSELECT * FROM ({outcomes(fixtures.CONTINUOUS)})"
REFRESHED = (
    f"WITH {BATCHED}\nSELECT * EXCLUDE (part) FROM ({outcomes(fixtures.CONTINUOUS, 'part, id AS tag_id')}) WHERE part < 2\n"
    f"UNION ALL\nSELECT * EXCLUDE (part) FROM ({outcomes(fixtures.REPLACED, 'part, id AS tag_id')}) WHERE part >= 2"
)


def ticks() -> str:
    """``ticks``: what each batch does about each formula of TICKED, and the deadline after it."""
    rows = ", ".join(
        f"({v.id}::BIGINT, '{v.nodes[0]}', INTERVAL '{v.minutes}' MINUTE, "
        f"{'NULL' if v.anchor is None else repr(v.anchor)}::TIMESTAMP)"
        for v in fixtures.TICKED
    )
    action = """CASE WHEN next IS NULL THEN 'init' WHEN now < next THEN 'wait'
            WHEN now > next + len THEN 'stale' ELSE 'run' END"""
    return f"""WITH RECURSIVE {READINGS},
parts AS (SELECT *, id * {PARTS} // (max(id) OVER () + 1) AS part FROM readings),
clock AS (SELECT part, max(max(ts)) OVER (ORDER BY part) AS now FROM parts GROUP BY part),
formulas(variable_id, short, len, anchor) AS (VALUES {rows}),
ticks AS (
    SELECT -1::BIGINT AS part, variable_id, short, len, NULL::TIMESTAMP AS window_end, anchor AS next FROM formulas
    UNION ALL
    SELECT part, variable_id, short, len, CASE WHEN action = 'run' THEN next END,
        CASE WHEN action IN ('init', 'stale') THEN now + len WHEN action = 'wait' THEN next ELSE next + len END
    FROM (SELECT c.part, variable_id, short, len, next, now, {action} AS action
        FROM ticks t JOIN clock c ON c.part = t.part + 1))"""


def delayed() -> str:
    """``late``: readings of fired windows that came after the batch in which these fired; ``inside``: all of them."""
    rows = ", ".join(
        f"({v.id}::BIGINT, '{v.nodes[0]}', INTERVAL '{v.minutes}' MINUTE, TIMESTAMP '{v.anchor}')" for v in fixtures.LATE
    )
    return f"""WITH {READINGS},
sized AS (SELECT *, max(id) OVER () + 1 AS size FROM readings),
moved AS (SELECT * EXCLUDE (id), CASE WHEN id % 7 = 0 THEN id + size ELSE id END AS id FROM sized),
parts AS (SELECT *, id * {PARTS} // (2 * size) AS part FROM moved),
clock AS (
    SELECT part, max(max(ts)) OVER (ORDER BY part) AS now, max(max(id)) OVER (ORDER BY part) AS high_id
    FROM parts GROUP BY part),
formulas(variable_id, short, len, anchor) AS (VALUES {rows}),
ends AS (
    SELECT variable_id, short, len, unnest(generate_series(anchor, (SELECT max(now) FROM clock)::TIMESTAMP, len)) AS window_end
    FROM formulas),
fired AS (
    SELECT e.variable_id, e.short, e.len, e.window_end, min(c.high_id) AS high_id
    FROM ends e JOIN clock c ON c.now >= e.window_end GROUP BY ALL),
inside AS (
    SELECT f.variable_id, r.node_id, f.window_end - f.len AS window_start, f.window_end, r.id, r.value, f.high_id
    FROM fired f JOIN moved r ON r.short = f.short AND r.ts BETWEEN f.window_end - f.len AND f.window_end),
late AS (SELECT * FROM inside WHERE id > high_id)"""


ACTIVE = f"""WITH {CUSTOMER_VARIABLES}
SELECT variable_id, pre_save_formula AS formula,
    CASE WHEN formula_type IS NULL OR formula_type = '' THEN 'SINGLE' ELSE formula_type END AS formula_type,
    minutes, {stamp("time_interval")} AS time_interval, minutes > 0 AS is_windowed FROM active"""

FORMULA_NODES = f"""WITH {CUSTOMER_VARIABLES},
mentions AS (
    SELECT variable_id, unnest(tokens) AS node_id, generate_subscripts(tokens, 1) AS place
    FROM (SELECT variable_id, regexp_extract_all(pre_save_formula, '\\[([^\\]]+)\\]', 1) AS tokens FROM active)),
firsts AS (SELECT variable_id, node_id, min(place) AS place FROM mentions GROUP BY ALL)
SELECT variable_id, CAST(row_number() OVER (PARTITION BY variable_id ORDER BY place) - 1 AS INT) AS pos, node_id
FROM firsts"""

DUE = f"""WITH {CUSTOMER_VARIABLES},
d AS (
    SELECT variable_id, minutes, time_interval AS deadline, to_minutes(CAST(minutes AS INT)) AS len,
        TIMESTAMP '2024-01-01 00:20:00' AS now, pre_save_formula LIKE '%[%' AS mentioned
    FROM active WHERE minutes > 0),
a AS (
    SELECT *, CASE WHEN deadline IS NULL THEN 'init' WHEN now < deadline THEN 'wait'
        WHEN now > deadline + len THEN 'stale' WHEN NOT mentioned THEN 'advance' ELSE 'run' END AS action FROM d)
SELECT variable_id, minutes, action,
    CASE WHEN action = 'run' THEN {stamp("deadline - len")} END AS window_start,
    CASE WHEN action = 'run' THEN {stamp("deadline")} END AS window_end,
    {stamp("CASE action WHEN 'init' THEN now + len WHEN 'stale' THEN now + len WHEN 'wait' THEN deadline ELSE deadline + len END")}
        AS next_deadline
FROM a"""

SCHEDULE = f"""WITH {CUSTOMER_VARIABLES},
e AS (
    SELECT variable_id, to_minutes(CAST(minutes AS INT)) AS len,
        unnest(generate_series(time_interval, {END}, to_minutes(CAST(minutes AS INT)))) AS window_end
    FROM active WHERE minutes > 0 AND time_interval IS NOT NULL AND pre_save_formula LIKE '%[%')
SELECT variable_id, {stamp("window_end - len")} AS window_start, {stamp("window_end")} AS window_end FROM e"""


def bounded_log(parts: int) -> str:
    return f"""WITH {READINGS},
numbered AS (
    SELECT *, (row_number() OVER (ORDER BY id) - 1) // (count(*) OVER () // {parts} + 7) AS part FROM readings),
snap AS (SELECT p.part, {LATEST_OF} FROM (SELECT DISTINCT part FROM numbered) p JOIN numbered r ON r.part <= p.part GROUP BY p.part),
t AS (SELECT r.id, r.short, r.ts, r.part, {OWN_OR_LATEST} FROM numbered r JOIN snap s ON s.part = r.part),
made AS (SELECT part, count(*) AS successes FROM ({outcomes(fixtures.CONTINUOUS, "part, id AS tag_id")}) WHERE error IS NULL GROUP BY part)
SELECT n.part AS batch_id, count(*) AS readings, max(n.id) AS last_processed_id, any_value(m.successes) AS successes
FROM numbered n LEFT JOIN made m ON m.part = n.part GROUP BY n.part"""


ORACLES: dict[str, str] = {
    "incremental_scan": f"""WITH {READINGS}
SELECT id, node_id, value, {stamp("ts")} AS timestamp, 'Good' AS quality FROM readings
WHERE id > 400 ORDER BY id LIMIT 200""",
    "start_offset": """SELECT max(event_id) AS last_processed_id, 'first run' AS case FROM events
UNION ALL SELECT max(event_id), 'stored zero' FROM events UNION ALL SELECT 4711, 'stored'""",
    "latest_values": """SELECT 'ns=2;s=User' || user_id || '.' || event_type AS node_id, max(event_id) AS id,
    arg_max(value, event_id) AS value FROM events GROUP BY 1""",
    "window_readings": window_readings(("W2", "W3", "W4")),
    "raw_data_latest": f"""WITH {READINGS}
SELECT id, node_id, split_part(node_id, '.', -1) AS alias, value, {stamp("ts")} AS timestamp, 'Good' AS quality
FROM readings ORDER BY id DESC LIMIT 20""",
    "raw_data_stats": f"""SELECT count(*) FILTER (WHERE ts BETWEEN {MIDDLE} - INTERVAL 1 SECOND AND {MIDDLE}) AS tags_per_second,
    count(DISTINCT event_type) AS distinct_nodes FROM events""",
    "active_formulas": ACTIVE,
    "formula_nodes": FORMULA_NODES,
    "formula_list": f"""WITH {CUSTOMER_VARIABLES}
SELECT variable_id, variable_name, pre_save_formula AS formula, formula_type, time AS interval
FROM active ORDER BY variable_name""",
    "formula_counts": f"""WITH {CUSTOMER_VARIABLES}
SELECT count(*) AS single, 0::BIGINT AS pair, count(*) AS total FROM active""",
    "continuous_eval": continuous(fixtures.CONTINUOUS),
    "unresolved_nodes": continuous(fixtures.MISSING),
    "failed_executions": f"""WITH {READINGS},
{snapshot()}
SELECT tag_id, variable_id, error AS error_message, {stamp(END)} AS failed_at, 0 AS retry_count,
    false AS is_resolved FROM ({outcomes(fixtures.CONTINUOUS)}) WHERE error IS NOT NULL""",
    "invalid_formulas": continuous(fixtures.INVALID),
    "fault_isolation": continuous(fixtures.FAULTS, 8),
    "whatif_scenarios": scenarios(),
    **{name: continuous(rows, 8) for name, rows in fixtures.SCALARS.items()},
    "scalar_validate": VALIDATE,
    "window_schedule": SCHEDULE,
    "window_boundary": window_readings(("W1", "W2"), "date_trunc('hour', r.ts)"),
    "due_windows": DUE,
    "windowed_zip": f"""WITH {READINGS},
{windows(fixtures.windowed("W2"))},
{in_windows(fixtures.windowed("W2"))}
SELECT variable_id, {stamp("window_end")} AS window_end, position,
    max(value) FILTER (WHERE short = 'click') AS x0, max(value) FILTER (WHERE short = 'view') AS x1
FROM n GROUP BY variable_id, n.window_end, position HAVING count(*) = 2""",
    "windowed_sum": window_rows("W1", "W4"),
    "windowed_avg": window_rows("W2", "W6"),
    "windowed_last": window_rows("W3", "W7"),
    "windowed_errors": window_rows("W4", "W5"),
    "all_executions": f"""{executed()}
SELECT variable_id, tag_id, round(result, 8) AS result, error, {stamp("result_on")} AS result_on,
    {stamp("window_end")} AS window_end, {stamp(END)} AS processed_on, 'system' AS created_by,
    false AS is_deleted FROM ex""",
    "executions_latest": executions_latest("", 100),
    "executions_by_alias": executions_latest(" AND v.variable_name LIKE 'W%'", 50),
    "executions_summary": f"""{executed()}
SELECT v.variable_name, v.pre_save_formula AS formula, v.time AS current_interval,
    count(e.variable_id) AS total_executions,
    CASE WHEN count(e.variable_id) > 0 THEN {stamp(END)} END AS last_processed_on,
    round(max(e.result), 8) AS max_result
FROM variables v LEFT JOIN (SELECT * FROM ex WHERE error IS NULL) e ON e.variable_id = v.variable_id
WHERE NOT v.is_deleted AND v.formula_type = 'SINGLE' GROUP BY 1, 2, 3 ORDER BY 1""",
    "batch_stats": f"""WITH {READINGS},
{snapshot()},
{windowed("W1", "W3", "W5")},
o AS (SELECT tag_id // 200 AS batch_id, error FROM ({outcomes(fixtures.CONTINUOUS)})
    UNION ALL SELECT 0, error FROM done),
r AS (SELECT id // 200 AS batch_id, count(*) AS n FROM readings GROUP BY 1)
SELECT r.batch_id, any_value(r.n)::BIGINT AS readings, count(*) FILTER (WHERE o.error IS NULL) AS successes,
    count(*) FILTER (WHERE o.error IS NOT NULL) AS failures
FROM r JOIN o ON o.batch_id = r.batch_id GROUP BY r.batch_id""",
    "stream_continuous": STREAMED,
    "stream_latest_state": f"""WITH {READINGS}
SELECT node_id, max(id) AS id, arg_max(value, id) AS value FROM readings GROUP BY node_id""",
    "stream_windowed": f"""WITH {READINGS},
{windowed("W1", "W2", "W3", "W5", "W6")}
SELECT variable_id, CASE WHEN error IS NULL THEN {stamp("window_end")} END AS window_end,
    round(result, 8) AS result, error FROM done WHERE window_end <= (SELECT max(ts) FROM readings)""",
    "stream_formula_refresh": REFRESHED,
    "stream_replayed": STREAMED,
    "stream_totals": f"""WITH {BATCHED}
SELECT (SELECT count(*) FROM readings) AS total_tags_processed, (SELECT count(DISTINCT part) FROM parts) AS batches_processed,
    count(*) AS total_formulas_executed FROM ({outcomes(fixtures.CONTINUOUS)}) WHERE error IS NULL""",
    "stream_executions_newest": f"""WITH {BATCHED},
names AS (SELECT unnest({[v.id for v in fixtures.CONTINUOUS]})::BIGINT AS variable_id, unnest({[v.name for v in fixtures.CONTINUOUS]}) AS variable_name)
SELECT variable_id, variable_name, tag_id, round(result, 8) AS result
FROM ({outcomes(fixtures.CONTINUOUS, "part, id AS tag_id")}) JOIN names USING (variable_id)
WHERE error IS NULL ORDER BY part DESC, variable_id, tag_id LIMIT 100""",
    "stream_ticks": f"""{ticks()}
SELECT t.variable_id, {stamp("t.window_end")} AS window_end, round(sum(r.value), 8) AS result, NULL::VARCHAR AS error
FROM ticks t JOIN readings r ON r.short = t.short AND r.ts BETWEEN t.window_end - t.len AND t.window_end
GROUP BY t.variable_id, t.window_end""",
    "stream_deadlines": f"""{ticks()}
SELECT variable_id, {stamp("next")} AS time_interval FROM ticks WHERE part = {PARTS - 1}""",
    "stream_bounded": bounded_log(PARTS),
    "stream_folded_log": bounded_log(2 * PARTS),
    "late_readings": f"""{delayed()}
SELECT variable_id, node_id, {stamp("window_start")} AS window_start, {stamp("window_end")} AS window_end, id, value, high_id
FROM late""",
    "late_windows": f"""{delayed()}
SELECT variable_id, {stamp("window_start")} AS window_start, {stamp("window_end")} AS window_end,
    round(sum(value), 8) AS result, NULL::VARCHAR AS error,
    round(sum(value) FILTER (WHERE id <= high_id), 8) AS fired_result, NULL::VARCHAR AS fired_error,
    count(*) FILTER (WHERE id > high_id) AS late
FROM inside GROUP BY variable_id, window_start, window_end HAVING count(*) FILTER (WHERE id > high_id) > 0""",
}
ORACLES["stream_window_state"] = ORACLES["stream_ticks"]
ORACLES["stream_window_replay"] = ORACLES["stream_windowed"]

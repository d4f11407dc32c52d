"""Formula tables for the registered queries.

Formulas are templates: ``{click}`` stands for the node of that event type. A
formula that is checked by SQL has its value and its error beside it, written
over the columns ``click, view, error, purchase, signup`` (a reading's own value
for its own node, the latest values for the others).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

NODES = ("click", "error", "purchase", "signup", "view")
ABSENT = ("absent", "gone")


def node(name: str) -> str:
    return f"ns=2;s=Line1.{name}"


def spelled(template: str) -> str:
    """The formula with its nodes in brackets."""
    for name in NODES + ABSENT:
        template = template.replace("{" + name + "}", f"[{node(name)}]")
    return template


@dataclass(frozen=True)
class Variable:
    id: int
    name: str
    formula: str | None
    kind: str | None = "SINGLE"
    minutes: int | None = 0
    anchor: str | None = None
    deleted: bool = False
    value: str = "CAST(NULL AS DOUBLE)"
    failure: str = "CAST(NULL AS VARCHAR)"

    @property
    def nodes(self) -> list[str]:
        return [name for name in NODES if self.formula and "{" + name + "}" in self.formula]


def _quoted(text: str | None) -> str:
    return "CAST(NULL AS {string})" if text is None else "'" + text.replace("'", "''") + "'"


def values(variables: list[Variable], string: str) -> str:
    """A VALUES list in either dialect; ``string`` is the name of the text type."""
    rows = []
    for each in variables:
        formula = None if each.formula is None else spelled(each.formula)
        anchor = "NULL" if each.anchor is None else f"'{each.anchor}'"
        rows.append(
            "("
            + ", ".join(
                [
                    f"CAST({each.id} AS BIGINT)",
                    _quoted(each.name),
                    _quoted(formula),
                    _quoted(each.kind),
                    "CAST(NULL AS INT)" if each.minutes is None else f"CAST({each.minutes} AS INT)",
                    f"CAST({anchor} AS TIMESTAMP)",
                    str(each.deleted).lower(),
                ]
            ).replace("{string}", string)
            + ")"
        )
    return "VALUES " + ",\n".join(rows)


COLUMNS = (
    "variable_id, variable_name, pre_save_formula, formula_type, time, time_interval, is_deleted"
)


def table(spark: SparkSession, variables: list[Variable]) -> DataFrame:
    # Spark reads backslashes in literals; no formula here contains one.
    return spark.sql(f"SELECT * FROM {values(variables, 'STRING')} AS t({COLUMNS})")


def failing(test: str, message: str) -> str:
    return f"CASE WHEN {test} THEN '{message}' END"


DIVISION = "VALUE_ERROR: Division by zero"
DOMAIN = "VALUE_ERROR: math domain error"
SYNTAX = "COMPILE_ERROR: Syntax error: invalid formula"
UNRESOLVED = f"UNRESOLVED_NODE: {node('absent')}"

# The formula table of the main queries.
CONTINUOUS = [
    Variable(1, "V1", "{click} * 0.001", value="click * 0.001::DOUBLE"),
    Variable(2, "V2", "({click} + {view}) / 2", minutes=None, value="(click + view) / 2.0::DOUBLE"),
    Variable(3, "V3", "1 if {error} > 100 else 0", value="CASE WHEN error > 100 THEN 1 ELSE 0 END"),
    Variable(
        4,
        "V4",
        "IF ({view} >= {error}) THEN {view} ELSE 0 - {error}",
        kind="",
        value="CASE WHEN view >= error THEN view ELSE 0 - error END",
    ),
    Variable(
        5, "V5", "AVG({click}, {view}, {signup})", value="(click + view + signup) / 3.0::DOUBLE"
    ),
    Variable(6, "V6", "{click} + {absent}", failure=f"'{UNRESOLVED}'"),
    Variable(
        7,
        "V7",
        "{purchase} / (floor({view}) % 2)",
        value="CASE WHEN floor(view)::BIGINT % 2 = 1 THEN purchase END",
        failure=failing("floor(view)::BIGINT % 2 = 0", DIVISION),
    ),
    Variable(
        8,
        "V8",
        "sqrt({view} - 50)",
        value="CASE WHEN view >= 50 THEN sqrt(view - 50) END",
        failure=failing("view < 50", DOMAIN),
    ),
    Variable(
        9, "V9", "foo({view})", failure="'COMPILE_ERROR: Compile error: Unsafe function: foo'"
    ),
]

DAY = "2024-01-01 06:00:00"
WINDOWED = [
    Variable(10, "W1", "SUM({click})", minutes=360, anchor=DAY),
    Variable(11, "W2", "AVG({click} + {view})", minutes=360, anchor=DAY),
    Variable(12, "W3", "({click} + {view}) / 2", minutes=360, anchor="2024-01-01 06:07:00"),
    Variable(13, "W4", "SUM({view})", minutes=5, anchor="2024-01-01 00:05:00"),
    Variable(14, "W5", "AVG({click} + {absent})", minutes=360, anchor=DAY),
    Variable(15, "W6", "AVG(sqrt({view} - 50))", minutes=360, anchor=DAY),
    Variable(16, "W7", "SUM({click}) / 2", minutes=360, anchor=DAY),
    Variable(17, "W8", "1 + 1", minutes=360, anchor=DAY),
    Variable(18, "W9", "SUM({click})", minutes=360),
]
UNUSED = [
    Variable(19, "X1", "{click}", deleted=True),
    Variable(20, "X2", ""),
    Variable(21, "X3", None),
    Variable(22, "X4", "{click}", kind="PAIR", value="click"),
]
VARIABLES = CONTINUOUS + WINDOWED + UNUSED


def windowed(*names: str) -> list[Variable]:
    return [variable for variable in WINDOWED if variable.name in names]


def _scalars(*rows: tuple[str, str, str]) -> list[Variable]:
    return [
        Variable(at, f"S{at}", formula, value=value or "CAST(NULL AS DOUBLE)",
                 failure=failure or "CAST(NULL AS VARCHAR)")
        for at, (formula, value, failure) in enumerate(rows, 1)
    ]


FLOORED = "CASE WHEN {r} <> 0 AND ({r} < 0) <> ({b} < 0) THEN {r} + {b} ELSE {r} END"


def _mod(a: str, b: str) -> str:
    rest = f"(({a}) - trunc(({a}) / ({b})) * ({b}))"
    return FLOORED.format(r=rest, b=b)


# One list per family of scalar functions: formula, SQL value, SQL error.
SCALARS: dict[str, list[Variable]] = {
    "scalar_arith": _scalars(
        ("{click} + {view} - 3 * {error}", "click + view - 3 * error", ""),
        ("-{click} + 2", "-click + 2", ""),
        ("+{view} * -1.5", "view * -1.5::DOUBLE", ""),
        (
            "1e308 * ({view} + 2) * 10",
            "",
            "'RESULT_INFINITE_VALUE'",
        ),
        (
            "1e308 * ({view} + 2) * 10 - 1e308 * ({view} + 2) * 10",
            "",
            "'RESULT_NAN_VALUE'",
        ),
    ),
    "scalar_div": _scalars(
        ("{click} / ({view} + 1)", "click / (view + 1)", ""),
        (
            "{click} / (floor({view}) - floor({view}))",
            "",
            f"'{DIVISION}'",
        ),
        (
            "1 / (({view} > 50) * {view})",
            "CASE WHEN view > 50 THEN 1.0::DOUBLE / view END",
            failing("view <= 50", DIVISION),
        ),
    ),
    "scalar_mod": _scalars(
        ("floor({click}) % 7", "floor(click)::BIGINT % 7", ""),
        ("-floor({click}) % 7", _mod("-floor(click)", "7.0::DOUBLE"), ""),
        ("floor({click}) % -7", _mod("floor(click)", "-7.0::DOUBLE"), ""),
        (
            "{click} % (floor({view}) % 2)",
            "CASE WHEN floor(view)::BIGINT % 2 = 1 THEN " + _mod("click", "1.0::DOUBLE") + " END",
            failing("floor(view)::BIGINT % 2 = 0", "DIVISION_BY_ZERO"),
        ),
    ),
    "scalar_pow": _scalars(
        ("{click} ** 2", "click * click", ""),
        ("(0 - {click}) ^ 2", "click * click", ""),
        ("-{click} ^ 2", "-(click * click)", ""),
        ("pow({view}, 0.5)", "sqrt(view)", ""),
        (
            "({view} > 50) ^ -1",
            "CASE WHEN view > 50 THEN 1 END",
            failing("view <= 50", "DIVISION_BY_ZERO"),
        ),
        ("10.0 ^ (400 + {view})", "", "'OVERFLOW'"),
        ("(0 - {view} - 1) ^ 0.5", "", "'RESULT_INVALID_TYPE'"),
    ),
    "scalar_compare": _scalars(
        ("{click} > {view}", "CASE WHEN click > view THEN 1 ELSE 0 END", ""),
        ("{click} == {click}", "1", ""),
        ("{click} != 42.13", "CASE WHEN click <> 42.13::DOUBLE THEN 1 ELSE 0 END", ""),
        ("10 < {view} <= {error}", "CASE WHEN 10 < view AND view <= error THEN 1 ELSE 0 END", ""),
        (
            "10 < {view} < 1 / (floor({error}) - floor({error}))",
            "CASE WHEN view <= 10 THEN 0 END",
            failing("view > 10", DIVISION),
        ),
        ("({view} >= 50) * 10 + ({view} <= 5)", "CASE WHEN view >= 50 THEN 10 WHEN view <= 5 THEN 1 ELSE 0 END", ""),
    ),
    "scalar_bool": _scalars(
        ("{click} > 10 and {view} > 10", "CASE WHEN click > 10 AND view > 10 THEN 1 ELSE 0 END", ""),
        ("{click} > 50 or {view} > 50", "CASE WHEN click > 50 OR view > 50 THEN 1 ELSE 0 END", ""),
        ("{click} > 1e9 and 1 / 0", "", f"'{DIVISION}'"),
        ("not {click}", "", "'VALUE_ERROR: Operator not allowed: Not'"),
        ("{click} // 2", "", "'VALUE_ERROR: Operator not allowed: FloorDiv'"),
        ("{click} AND {view}", "", f"'{SYNTAX}'"),
    ),
    "scalar_ternary": _scalars(
        ("{click} if {click} > 20 else {view}", "CASE WHEN click > 20 THEN click ELSE view END", ""),
        (
            "1 if {view} > 50 else 1 / 0",
            "CASE WHEN view > 50 THEN 1 END",
            failing("view <= 50", DIVISION),
        ),
        (
            "1 if {view} > 100 else 2 if {view} > 50 else 3",
            "CASE WHEN view > 100 THEN 1 WHEN view > 50 THEN 2 ELSE 3 END",
            "",
        ),
        (
            "{view} if {view} > 50 else None",
            "CASE WHEN view > 50 THEN view END",
            failing("view <= 50", "RESULT_NULL_VALUE"),
        ),
    ),
    "scalar_if_then_else": _scalars(
        ("IF ({click} > 20) THEN 1 ELSE 0", "CASE WHEN click > 20 THEN 1 ELSE 0 END", ""),
        ("if {click} > 20 then {click} else 0 - {view}", "CASE WHEN click > 20 THEN click ELSE 0 - view END", ""),
        (
            "IF ({view} > 100) THEN 1 ELSE IF ({view} > 50) THEN 2 ELSE 3",
            "CASE WHEN view > 100 THEN 1 WHEN view > 50 THEN 2 ELSE 3 END",
            "",
        ),
        ("(IF ({view} > 50) THEN 1 ELSE 2) * 10", "CASE WHEN view > 50 THEN 10 ELSE 20 END", ""),
        ("{view} + IF ((({view})) > 50) THEN 1 ELSE 2", "view + CASE WHEN view > 50 THEN 1 ELSE 2 END", ""),
        ("IF ({view} > 50) THEN 1", "", f"'{SYNTAX}'"),
    ),
    "scalar_iif": _scalars(
        ("IIF({view} > 50, 1, 2)", "CASE WHEN view > 50 THEN 1 ELSE 2 END", ""),
        ("iif({view} > {click}, {view}, {click})", "CASE WHEN view > click THEN view ELSE click END", ""),
        ("Iif({view} > 50, 1, 1 / (0 * {view}))", "", f"'{DIVISION}'"),
        ("iif({view} > 50, 1)", "", "'EXECUTION_ERROR: iif() cannot take these arguments'"),
    ),
    "scalar_math": _scalars(
        ("abs({click} - {view})", "abs(click - view)", ""),
        ("ceil({view})", "ceil(view)", ""),
        ("floor(0 - {view})", "floor(0 - view)", ""),
        ("floor({view} * 1e200)", "view * 1e200::DOUBLE", ""),
        ("ABS({view})", "", "'COMPILE_ERROR: Compile error: Unsafe function: ABS'"),
    ),
    "scalar_round": _scalars(
        ("round({view})", "round_even(view, 0)", ""),
        ("round(floor({view}) / 2)", "round_even(floor(view) / 2.0::DOUBLE, 0)", ""),
        ("round({view}, 1)", "round_even(view::DECIMAL(18,2), 1)", ""),
        ("round(floor({view}), -1)", "round_even(floor(view) / 10.0::DOUBLE, 0) * 10", ""),
        ("round({view}, {click})", "", "'EXECUTION_ERROR: round() cannot take these arguments'"),
    ),
    "scalar_minmax": _scalars(
        ("min({click}, {view}, {error})", "least(click, view, error)", ""),
        ("max({click}, {view}, 100)", "greatest(click, view, 100)", ""),
        ("max(sqrt({view} - 50), 1)", "CASE WHEN view >= 50 THEN greatest(sqrt(view - 50), 1) END", failing("view < 50", DOMAIN)),
        ("min({view})", "", "'EXECUTION_ERROR: min() cannot take these arguments'"),
    ),
    "scalar_domain": _scalars(
        ("sqrt({view} - 50)", "CASE WHEN view >= 50 THEN sqrt(view - 50) END", failing("view < 50", DOMAIN)),
        ("log({view} + 1)", "ln(view + 1)", ""),
        ("log({view} - 50)", "CASE WHEN view > 50 THEN ln(view - 50) END", failing("view <= 50", DOMAIN)),
        ("log({view} + 1, 2)", "ln(view + 1) / ln(2.0::DOUBLE)", ""),
        ("log({view} + 1, 1)", "", "'DIVISION_BY_ZERO'"),
        ("log10({view} + 1)", "log10(view + 1)", ""),
        ("exp({view} / 100)", "exp(view / 100.0::DOUBLE)", ""),
        (
            "exp({view} * 100)",
            "CASE WHEN view * 100 < 709.7 THEN exp(view * 100) END",
            failing("view * 100 >= 709.7", "OVERFLOW"),
        ),
    ),
    "scalar_trig": _scalars(
        ("sin({view})", "sin(view)", ""),
        ("cos({view})", "cos(view)", ""),
        ("tan({view} / 1000)", "tan(view / 1000.0::DOUBLE)", ""),
        ("sin({view} * 1e308 * 1e308 + 1e308 * 1e308)", "", f"'{DOMAIN}'"),
    ),
    "scalar_avg_sum": _scalars(
        ("avg({click}, {view}, {error})", "(click + view + error) / 3.0::DOUBLE", ""),
        ("AVERAGE({click}, {view}) + 1", "(click + view) / 2.0::DOUBLE + 1", ""),
        ("SUM({click}, {view}, 5)", "click + view + 5", ""),
        ("Avg({click}) * 2", "click * 2", ""),
        ("sum() + avg() + {click}", "click", ""),
    ),
}

VALIDATED = _scalars(
    ("{view} * 2", "view * 2", ""),
    ("{view} + {click}", "view + click", ""),
)

INVALID = _scalars(
    ("foo({view})", "", "'COMPILE_ERROR: Compile error: Unsafe function: foo'"),
    ('"x" if {view} else 0', "", "'COMPILE_ERROR: Formula returns string value — not supported'"),
    ("{view} +", "", f"'{SYNTAX}'"),
    ("2{view}", "", f"'{SYNTAX}'"),
    ("{view}.real", "", "'COMPILE_ERROR: Compile error: Attribute access not allowed'"),
    ("(lambda: {view})", "", "'COMPILE_ERROR: Compile error: Function definitions not allowed'"),
    ("{view} + other", "", "'VALUE_ERROR: Variable ''other'' not in context'"),
    ("({view}, 1)", "", "'VALUE_ERROR: Unsupported node: Tuple'"),
    ("{view} in (1, 2)", "", "'VALUE_ERROR: Comparison not allowed: In'"),
    ("~{view}", "", "'VALUE_ERROR: Operator not allowed: Invert'"),
    ("{view} * x0 + 1", "", "'VALUE_ERROR: Variable ''x0'' not in context'"),
    ("{view} * x1 + {click}", "", "'VALUE_ERROR: Variable ''x1'' not in context'"),
    ("{view} * xx1 + x", "", "'VALUE_ERROR: Variable ''xx1'' not in context'"),
    ("{view} * k", "", "'VALUE_ERROR: Variable ''k'' not in context'"),
    ("{view} * ops", "", "'VALUE_ERROR: Variable ''ops'' not in context'"),
)

DEEP = "EXECUTION_ERROR: formula is nested too deeply"
HUGE = "1" + "0" * 400

# Formulas that must not disturb the others, the first, a healthy one, included.
FAULTS = _scalars(
    ("{click} * 2", "click * 2", ""),
    ("{click}" + " + {view}" * 400, "click + 400 * view", ""),
    ("-" * 900 + "{click}", "click", ""),
    ("(" + " + ".join(["{click}", "{view}"] * 1000) + ") / 2000", "(click + view) / 2", ""),
    ("avg(" + ", ".join(["{click}", "{view}"] * 1000) + ")", "(click + view) / 2", ""),
    ("{click}" + " * 1.0" * 2000, "click", ""),
    ("round({click}, 99999999999)", "click", ""),
    ("round({click}, 2000000000)", "click", ""),
    ("round({click}, -2000000000)", "0", ""),
    ("round({click}, 2 - 1 + 0 * 3)", "round_even(click, 1)", ""),
    (f"pow({HUGE}, 1, 2{HUGE}) + {{click}}", "", "'OVERFLOW'"),
    ("pow(2, -1, 4) + {click}", "", "'VALUE_ERROR: base is not invertible for the given modulus'"),
    ("pow(2, 1, 0) + {click}", "", "'VALUE_ERROR: pow() 3rd argument cannot be 0'"),
    ("{click}" + " / {view}" * 300, "", f"'{DEEP}'"),
    ("not " * 500 + "{click}", "", f"'{DEEP}'"),
    ("max(" * 120 + "{click}, 1" + ", 1)" * 120, "", f"'{DEEP}'"),
    ("(" * 300 + "{click}" + ")" * 300, "", f"'{SYNTAX}'"),
)

MISSING = [
    Variable(1, "M1", "{click} + {absent}", failure=f"'{UNRESOLVED}'"),
    Variable(
        2,
        "M2",
        "{gone} / {click} + {absent} * {gone}",
        failure=f"'UNRESOLVED_NODE: {node('gone')}, {node('absent')}, {node('gone')}'",
    ),
    Variable(3, "M3", "{click} + {view}", value="click + view"),
    Variable(4, "M4", "foo({absent}) + {view}", failure=f"'{UNRESOLVED}'"),
]

SCENARIOS = [variable for variable in CONTINUOUS if variable.name in ("V1", "V2", "V4", "V5", "V8", "V9")]

# Scenarios of these have no formula to evaluate: empty, deleted, and in no table at all.
EMPTY = Variable(91, "EMPTY", "  ", failure="'COMPILE_ERROR: Empty formula'")
DELETED = Variable(92, "DELETED", "{click} + 1", deleted=True, failure="'UNKNOWN_VARIABLE'")
UNKNOWN = Variable(93, "UNKNOWN", None, failure="'UNKNOWN_VARIABLE'")

# Weekly windows of which one is due in each of the stream's batches, one that is
# always stale, and one without a first deadline.
TICKED = [
    Variable(21, "T1", "SUM({click})", minutes=10_080, anchor="2024-01-05 00:00:00"),
    Variable(22, "T2", "SUM({view})", minutes=1_440, anchor="2024-01-01 06:00:00"),
    Variable(23, "T3", "SUM({error})", minutes=10_080),
    Variable(24, "T4", "SUM({click})", minutes=10_080, anchor="2030-01-01 00:00:00"),
]
#: Windows whose readings come late, each over one node.
LATE = [
    Variable(31, "L1", "SUM({click})", minutes=10_080, anchor="2024-01-05 00:00:00"),
    Variable(32, "L2", "SUM({view})", minutes=7_200, anchor="2024-01-04 06:00:00"),
]
REPLACED = [
    Variable(1, "V1", "{click} * 0.002", value="click * 0.002::DOUBLE"),
    Variable(9, "V9", "{view} + 1", value="view + 1"),
]

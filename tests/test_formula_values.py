"""Values and errors of formulas, against a table and against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

import gaugework as gw
from gaugework.operators import continuous

OPERANDS = {"a": 8.0, "b": 3.0, "c": -3.0, "h": 2.5, "z": 0.0}
DIVISION = "VALUE_ERROR: Division by zero"

TABLE = [
    ("[a] * 0.001", 0.008),
    ("([a] + [b]) / 2", 5.5),
    ("1 if [a] > 100 else 0", 0.0),
    ("AVG([a], [b], [c])", 2.6666666666666665),
    ("sum([a], [b])", 11.0),
    ("[c] % [b]", 0.0),
    ("-7 % 3", 2.0),
    ("7 % -3", -2.0),
    ("[c] ^ 2", 9.0),
    ("-[b] ** 2", -9.0),
    ("2 ** 3 ** 2", 512.0),
    ("round([h])", 2.0),
    ("round(3.5)", 4.0),
    ("round([a] / [b], 2)", 2.67),
    ("round(1234.5, -2)", 1200.0),
    ("min([a], [b], [c])", -3.0),
    ("max([a], [b], [c])", 8.0),
    ("sqrt([a])", 2.8284271247461903),
    ("log([a], 2)", 3.0),
    ("log10([a])", 0.9030899869919435),
    ("ceil([h])", 3.0),
    ("floor(-[h])", -3.0),
    ("floor(1e300)", 1e300),
    ("([a] > 5) * 10", 10.0),
    ("1 < [b] < [a]", 1.0),
    ("True + 1", 2.0),
    ("IIF([a] > 5, 1, 2)", 1.0),
    ("IF ([a] > 5) THEN 1 ELSE 2", 1.0),
    ("1 if [a] > 5 else 1 / [z]", 1.0),
    ("1 > 2 > 1 / [z]", 0.0),
    ("[a] if [z] else [b]", 3.0),
    ("[a] and [b]", 1.0),
    ("[z] or [z]", 0.0),
    ("pow(7, 2, 5)", 4.0),
    ("sum()", 0.0),
    ("avg() + 1", 1.0),
    ("1 if [a] < 5 else (2 if 1e308 * 10 > 1 else 3)", 2.0),
    ("(1e308 * 10 - 1e308 * 10) == (1e308 * 10 - 1e308 * 10)", 0.0),
    ("(1e308 * 10 - 1e308 * 10) != 1", 1.0),
    ("(1e308 * 10 - 1e308 * 10) > 1", 0.0),
    ("iif([a] > 5, 1, 1 / [z])", DIVISION),
    ("[a] < 5 and 1 / [z] > 0", DIVISION),
    ("[a] / [z]", DIVISION),
    ("[a] % [z]", "DIVISION_BY_ZERO"),
    ("[z] ^ -1", "DIVISION_BY_ZERO"),
    ("log([a], 1)", "DIVISION_BY_ZERO"),
    ("exp(1000)", "OVERFLOW"),
    ("10.0 ^ 400", "OVERFLOW"),
    ("floor(1e308 * 10)", "OVERFLOW"),
    ("1e308 * 10", "RESULT_INFINITE_VALUE"),
    ("1e999", "RESULT_INFINITE_VALUE"),
    ("1e308 * 10 - 1e308 * 10", "RESULT_NAN_VALUE"),
    ("round(1e308 * 10 - 1e308 * 10)", "VALUE_ERROR: cannot convert float NaN to integer"),
    ("sqrt([c])", "VALUE_ERROR: math domain error"),
    ("log([z])", "VALUE_ERROR: math domain error"),
    ("log([a], [z])", "VALUE_ERROR: math domain error"),
    ("sin(1e308 * 10)", "VALUE_ERROR: math domain error"),
    ("([c] - 5) ^ (1 / 3)", "RESULT_INVALID_TYPE"),
    ("1j", "RESULT_INVALID_TYPE"),
    ("None", "COMPILE_ERROR: Null formula"),
    ("None if [a] else 1", "RESULT_NULL_VALUE"),
    ("None + [a]", "EXECUTION_ERROR: operand is not a number"),
    ("min([a])", "EXECUTION_ERROR: min() cannot take these arguments"),
    ("sqrt([a], [b])", "EXECUTION_ERROR: sqrt() cannot take these arguments"),
    ("pow([a], 2, 5)", "EXECUTION_ERROR: pow() with 3 arguments needs integers"),
    ("round([a], [b])", "EXECUTION_ERROR: round() cannot take these arguments"),
    ("not [a]", "VALUE_ERROR: Operator not allowed: Not"),
    ("[a] // [b]", "VALUE_ERROR: Operator not allowed: FloorDiv"),
    ("[a] | [b]", "VALUE_ERROR: Operator not allowed: BitOr"),
    ("~[a]", "VALUE_ERROR: Operator not allowed: Invert"),
    ("[a] is [b]", "VALUE_ERROR: Comparison not allowed: Is"),
    ("1 > 2 > ([a] is [b])", 0.0),
    ("[a] + other", "VALUE_ERROR: Variable 'other' not in context"),
    ("x + [a]", "VALUE_ERROR: Variable 'x' not in context"),
    ("k + [a]", "VALUE_ERROR: Variable 'k' not in context"),
    ("1 if [a] > 5 else other", 1.0),
    ("([a], [b])", "VALUE_ERROR: Unsupported node: Tuple"),
    ("[] if [z] else 1", 1.0),
    ("[a] + []", "VALUE_ERROR: Unsupported node: List"),
    ("(y := [a])", "VALUE_ERROR: Unsupported node: NamedExpr"),
    ("ABS([c])", "COMPILE_ERROR: Compile error: Unsafe function: ABS"),
    ('"x" if [a] else 0', "COMPILE_ERROR: Formula returns string value — not supported"),
    ("[a] +", "COMPILE_ERROR: Syntax error: invalid formula"),
    ("[a] + [gone] * [b] + [lost] + [gone]", "UNRESOLVED_NODE: gone, lost, gone"),
]


def outcomes(spark, variables_of, texts, operands=OPERANDS):
    variables = variables_of(*enumerate(texts))
    tags = F.create_map(*(F.lit(part) for pair in operands.items() for part in pair))
    scenarios = variables.select(F.lit(1).alias("scenario_id"), "variable_id", tags.alias("tags"))
    rows = gw.evaluate_scenarios(scenarios, variables).collect()
    return {row.variable_id: row.result if row.error is None else row.error for row in rows}


def test_table(spark, variables_of):
    made = outcomes(spark, variables_of, [text for text, _ in TABLE])
    wrong = [
        (text, expected, made.get(at))
        for at, (text, expected) in enumerate(TABLE)
        if made.get(at) != expected
    ]
    assert not wrong


def test_shapes_in_several_passes(spark, variables_of, monkeypatch):
    monkeypatch.setattr(continuous, "SHAPES_PER_PASS", 7)
    made = outcomes(spark, variables_of, [text for text, _ in TABLE])
    assert [made[at] for at in range(len(TABLE))] == [expected for _, expected in TABLE]


class Fails(Exception):
    pass


def _plain(tree, values):
    """What Python makes of an expression tree; Fails carries the error code."""
    kind, *parts = tree
    if kind == "node":
        return values[parts[0]]
    if kind == "number":
        return parts[0]
    if kind == "if":
        return _plain(parts[1] if _plain(parts[0], values) else parts[2], values)
    if kind == "chain":
        left = _plain(parts[0], values)
        for op, part in parts[1]:
            right = _plain(part, values)
            if not {"<": left < right, ">=": left >= right, "==": left == right}[op]:
                return False
            left = right
        return True
    made = [_plain(part, values) for part in parts]
    try:
        if kind == "/" and made[1] == 0:
            raise Fails(DIVISION)
        if kind == "**":
            made = [float(made[0]), float(made[1])]
        return {
            "+": lambda a, b: a + b,
            "-": lambda a, b: a - b,
            "*": lambda a, b: a * b,
            "/": lambda a, b: a / b,
            "%": lambda a, b: float(a) % float(b),
            "**": lambda a, b: a**b,
            "neg": lambda a: -a,
            "and": lambda a, b: bool(a) and bool(b),
            "or": lambda a, b: bool(a) or bool(b),
            "abs": abs,
            "min": min,
            "max": max,
            "sqrt": math.sqrt,
            "log": math.log,
            "floor": math.floor,
            "ceil": math.ceil,
            "round": round,
            "exp": math.exp,
            "avg": lambda *a: sum(a) / len(a),
            "iif": lambda a, b, c: b if a else c,
        }[kind](*made)
    except ZeroDivisionError:
        raise Fails("DIVISION_BY_ZERO") from None
    except OverflowError:
        raise Fails("OVERFLOW") from None
    except ValueError:
        raise Fails("VALUE_ERROR: math domain error") from None


def _text(tree):
    kind, *parts = tree
    if kind == "node":
        return f"[{parts[0]}]"
    if kind == "number":
        return repr(parts[0])
    if kind == "if":
        test, body, other = map(_text, parts)
        return f"(IF ({test}) THEN {body} ELSE {other})"
    if kind == "chain":
        return "(" + _text(parts[0]) + "".join(f" {op} {_text(part)}" for op, part in parts[1]) + ")"
    if kind == "neg":
        return f"(-{_text(parts[0])})"
    if kind in ("+", "-", "*", "/", "%", "**", "and", "or"):
        return f"({_text(parts[0])} {kind} {_text(parts[1])})"
    return f"{kind}({', '.join(map(_text, parts))})"


def _tree(random_, depth):
    if depth == 0 or random_.random() < 0.15:
        if random_.random() < 0.7:
            return ("node", random_.choice("abchz"))
        return ("number", random_.choice([0, 1, 2, 3, 0.5, 10, 1.25]))

    def grow():
        return _tree(random_, depth - 1)

    kind = random_.choice(
        ["+", "-", "*", "/", "%", "**", "neg", "and", "or", "abs", "min", "max", "sqrt", "log",
         "floor", "ceil", "round", "exp", "avg", "iif", "if", "chain"]
    )
    if kind in ("neg", "abs", "sqrt", "log", "floor", "ceil", "round", "exp"):
        return (kind, grow())
    if kind in ("iif", "if"):
        return (kind, grow(), grow(), grow())
    if kind == "chain":
        links = [(random_.choice(["<", ">=", "=="]), grow()) for _ in range(random_.choice([1, 2]))]
        return (kind, grow(), links)
    return (kind, grow(), grow())


def _expected(tree):
    try:
        value = _plain(tree, OPERANDS)
        if isinstance(value, complex):
            return "RESULT_INVALID_TYPE"
        value = float(value)
    except Fails as failed:
        return str(failed)
    except OverflowError:
        return "OVERFLOW"
    except TypeError:  # a complex intermediate value, reported at once by ours
        return "RESULT_INVALID_TYPE"
    if math.isnan(value):
        return "RESULT_NAN_VALUE"
    return "RESULT_INFINITE_VALUE" if math.isinf(value) else value


def _has_complex(tree):
    kind, *parts = tree
    if kind in ("node", "number"):
        return False
    children = [parts[0], *(part for _, part in parts[1])] if kind == "chain" else parts
    if any(_has_complex(child) for child in children):
        return True
    try:
        return kind == "**" and isinstance(_plain(tree, OPERANDS), complex)
    except (Fails, TypeError, OverflowError):
        return False


@pytest.mark.parametrize("seed", [1, 2])
def test_random_formulas_against_python(spark, variables_of, seed):
    random_ = random.Random(seed)
    trees = []
    while len(trees) < 60:
        tree = _tree(random_, random_.choice([2, 3, 3, 4]))
        if not _has_complex(tree) and "node" in str(tree):
            trees.append(tree)
    made = outcomes(spark, variables_of, [_text(tree) for tree in trees])
    wrong = []
    for at, tree in enumerate(trees):
        expected, got = _expected(tree), made[at]
        same = (
            math.isclose(expected, got, rel_tol=1e-9, abs_tol=1e-12)
            if isinstance(expected, float) and isinstance(got, float)
            else expected == got
        )
        if not same:
            wrong.append((_text(tree), expected, got))
    assert not wrong


def test_exp_has_the_last_place_of_python(spark, readings_of, variables_of):
    """Spark's own is a unit off in the last place for about one value in twelve."""
    values = [at / 8 for at in range(-5600, 5677, 4)] + [709.0, 709.75, -744.0, 0.01, 1e-300]
    rows = [(at, "a", value, "2024-01-01 00:00:00") for at, value in enumerate(values, 1)]
    made = gw.evaluate(readings_of(rows, "double"), variables_of((1, "exp([a])"))).collect()
    got = {row.tag_id: row.result for row in made}
    wanted = {at: math.exp(value) for at, value in enumerate(values, 1)}
    assert all(math.isclose(got[at], value, rel_tol=4e-16, abs_tol=5e-324) for at, value in wanted.items())
    assert sum(got[at] != value for at, value in wanted.items()) < len(values) / 50


def test_results_are_rounded_as_sql_rounds(spark):
    import duckdb

    from checks.catalog import rounded

    values = [math.exp(at / 7) for at in range(1, 4960, 9)] + [0.5e-8, -1.5e-8, 2.5, 1e308, -math.exp(40), 0.0]
    rows = spark.createDataFrame([(at, value) for at, value in enumerate(values)], "at int, result double")
    got = [row.result for row in rounded(rows).orderBy("at").collect()]
    wanted = duckdb.execute("SELECT list_transform($1::DOUBLE[], lambda x: round(x, 8))", [values]).fetchone()[0]
    assert got == wanted

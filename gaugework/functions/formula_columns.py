"""Formula shapes as Spark SQL expressions.

Each part of a formula becomes a :class:`Term`: a value and an error, both as
expression text over operands and the column ``constants``. An
error is data, never an exception, so one bad row cannot fail a job. Where the
error is set the value is meaningless; the caller masks it.

Text rather than Column calls, because a formula is parsed by Spark in one step
instead of one gateway call per operator.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from decimal import Decimal, localcontext

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugework.functions.formula_text import CHAIN, Shape, literal_int

# Error codes.
DIVISION = "VALUE_ERROR: Division by zero"
ZERO_DIVISOR = "DIVISION_BY_ZERO"
OVERFLOW = "OVERFLOW"
DOMAIN = "VALUE_ERROR: math domain error"
NAN_TO_INT = "VALUE_ERROR: cannot convert float NaN to integer"
NAN_OPERAND = "VALUE_ERROR: Variable 'nan' not in context"
INFINITE_OPERAND = "VALUE_ERROR: Variable 'inf' not in context"
NOT_A_NUMBER = "EXECUTION_ERROR: operand is not a number"
RESULT_TYPE = "RESULT_INVALID_TYPE"
RESULT_NULL = "RESULT_NULL_VALUE"
RESULT_NAN = "RESULT_NAN_VALUE"
RESULT_INFINITE = "RESULT_INFINITE_VALUE"

INFINITY = "double('Infinity')"
BINARY = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*"}
COMPARE = {
    ast.Eq: "=",
    ast.NotEq: "<>",
    ast.Lt: "<",
    ast.LtE: "<=",
    ast.Gt: ">",
    ast.GtE: ">=",
}


@dataclass(frozen=True)
class Term:
    value: str
    error: str | None = None  # None: cannot fail
    truth: bool = False  # the value is boolean
    nan: bool = False  # the value may be NaN

    @property
    def number(self) -> str:
        return f"double({self.value})" if self.truth else self.value

    @property
    def condition(self) -> str:
        return self.value if self.truth else f"({self.value} <> 0D)"


def text(value: str) -> str:
    return '"' + value + '"'


def case(*branches: tuple[str, str], otherwise: str | None = None) -> str:
    body = " ".join(f"WHEN {test} THEN {value}" for test, value in branches)
    return f"CASE {body}{f' ELSE {otherwise}' if otherwise else ''} END"


def first_error(*errors: str | None) -> str | None:
    present = [error for error in errors if error is not None]
    return f"coalesce({', '.join(present)})" if len(present) > 1 else (present or [None])[0]


Operand = Callable[[int], str]


def outcome(shape: str, operand: Operand) -> str:
    """``struct<result double, error string>`` of one shape, result unchecked.

    ``operand`` gives the expression of the i-th operand, which should be short.
    """
    term = _Build(operand).term(ast.parse(shape, mode="eval").body)
    error = term.error or "string(NULL)"
    return f"named_struct('result', double({term.number}), 'error', {error})"


# Choices of one CASE. Spark moves the branches of a CASE to methods of their own
# only if it has several, so a binary choice would end up in one huge method.
BRANCHES = 8


def outcome_by_shape(shapes: Sequence[Shape], operand: Operand) -> Column:
    """The outcome of whichever shape the column ``shape_id`` names.

    The choice is a tree of CASE expressions, so a row passes some comparisons
    per level and then only its own formula, however many shapes there are.
    """
    if len(shapes) == 1:
        return F.expr(outcome(shapes[0].text, operand))
    size = BRANCHES ** max(level for level in range(12) if BRANCHES**level < len(shapes))
    groups = [shapes[at : at + size] for at in range(0, len(shapes), size)]
    chosen = F
    for group in groups:
        chosen = chosen.when(F.expr(f"shape_id <= {group[-1].id}"), outcome_by_shape(group, operand))
    return chosen


def operand_count(shapes: Sequence[Shape]) -> int:
    """How many operands the widest of the shapes has."""
    return 1 + max(
        (
            node.slice.value
            for shape in shapes
            for node in ast.walk(ast.parse(shape.text, mode="eval"))
            if isinstance(node, ast.Subscript) and node.value.id == "x"
        ),
        default=-1,
    )


def _failure(message: str) -> Term:
    return Term("double(NULL)", text(message))


# An operand longer than this is computed once and named where it is needed twice.
LONG = 160


def _named(build: Callable[..., str], *values: str) -> str:
    """``build(*values)``, whose text may repeat its arguments.

    Nested repetitions would multiply, so long arguments are bound to the
    variable of a lambda.
    """
    if sum(map(len, values)) <= LONG:
        return build(*values)
    fields = ", ".join(f"'{at}', {value}" for at, value in enumerate(values))
    body = build(*(f"v.`{at}`" for at in range(len(values))))
    return f"get(transform(array(named_struct({fields})), v -> {body}), 0)"


def _infinite(value: str) -> str:
    return f"abs({value}) = {INFINITY}"


def _finite(value: str) -> str:
    return f"abs({value}) < {INFINITY}"


class _Build:
    """Builds the terms of one formula, part by part in evaluation order."""

    def __init__(self, operand: Operand) -> None:
        self.operand = operand
        # Operands already checked on every way to the part being built.
        self.checked: set[int] = set()

    def term(self, node: ast.AST) -> Term:
        build = getattr(self, "on_" + type(node).__name__, None)
        if build is None:
            return _failure(f"VALUE_ERROR: Unsupported node: {type(node).__name__}")
        return build(node)

    def numeric(self, node: ast.AST) -> Term:
        """A term used as an operand: None and the like are type errors here."""
        if isinstance(node, ast.Constant) and not isinstance(node.value, (int, float)):
            return _failure(NOT_A_NUMBER)
        return self.term(node)

    def perhaps(self, node: ast.AST, build: Callable[[ast.AST], Term]) -> Term:
        """A term that is only sometimes evaluated."""
        before = set(self.checked)
        made = build(node)
        self.checked = before
        return made

    def on_Constant(self, node: ast.Constant) -> Term:
        if isinstance(node.value, bool):
            return Term(str(node.value).lower(), truth=True)
        if isinstance(node.value, int):  # kept in the shape by pow() and round()
            return Term(f"double('{node.value}')")
        return _failure(RESULT_NULL if node.value is None else RESULT_TYPE)

    def on_Name(self, node: ast.Name) -> Term:
        return _failure(f"VALUE_ERROR: Variable '{node.id}' not in context")

    def on_Subscript(self, node: ast.Subscript) -> Term:
        index = node.slice.value
        if node.value.id == "k":
            return Term(f"get(constants, {index})")
        value = self.operand(index)
        if index in self.checked:
            return Term(value)
        self.checked.add(index)
        # A NaN or infinite operand is not a number a formula can use.
        reason = case((f"isnan({value})", text(NAN_OPERAND)), otherwise=text(INFINITE_OPERAND))
        return Term(value, case((f"NOT ({_finite(value)})", reason)))

    def on_UnaryOp(self, node: ast.UnaryOp) -> Term:
        if not isinstance(node.op, (ast.USub, ast.UAdd)):
            return _failure(f"VALUE_ERROR: Operator not allowed: {type(node.op).__name__}")
        inner = self.numeric(node.operand)
        value = f"(- {inner.number})" if isinstance(node.op, ast.USub) else inner.number
        return Term(value, inner.error, nan=inner.nan)

    def on_BinOp(self, node: ast.BinOp) -> Term:
        kind = type(node.op)
        if kind not in BINARY and kind not in (ast.Div, ast.Mod, ast.Pow):
            return _failure(f"VALUE_ERROR: Operator not allowed: {kind.__name__}")
        left, right = self.numeric(node.left), self.numeric(node.right)
        a, b = left.number, right.number
        if kind in BINARY:
            made = Term(f"({a} {BINARY[kind]} {b})")
        elif kind is ast.Div:
            made = Term(f"try_divide({a}, {b})", case((f"{b} = 0D", text(DIVISION))))
        else:
            made = _floored_mod(a, b) if kind is ast.Mod else _power(a, b)
        return Term(made.value, first_error(left.error, right.error, made.error), nan=True)

    def on_Compare(self, node: ast.Compare) -> Term:
        # A chain stops at the first comparison that is false, so a later part
        # can only fail while everything before it holds.
        left = self.numeric(node.left)
        errors = [left.error]
        holds: list[str] = []
        for op, part in zip(node.ops, node.comparators):
            known = type(op) in COMPARE
            if not known:
                right = _failure(f"VALUE_ERROR: Comparison not allowed: {type(op).__name__}")
            elif holds:
                right = self.perhaps(part, self.numeric)
            else:
                right = self.numeric(part)
            if right.error:
                until = " AND ".join(holds)
                errors.append(case((until, right.error)) if holds else right.error)
            if not known:
                break
            holds.append(_compare(op, left, right))
            left = right
        value = f"({' AND '.join(holds)})" if holds else "false"
        return Term(value, first_error(*errors), truth=True)

    def on_BoolOp(self, node: ast.BoolOp) -> Term:
        parts = [self.term(value) for value in node.values]
        word = " AND " if isinstance(node.op, ast.And) else " OR "
        value = f"({word.join(part.condition for part in parts)})"
        return Term(value, first_error(*(part.error for part in parts)), truth=True)

    def on_IfExp(self, node: ast.IfExp) -> Term:
        test = self.term(node.test)
        body = self.perhaps(node.body, self.term)
        other = self.perhaps(node.orelse, self.term)
        taken = None
        if body.error or other.error:
            taken = case(
                (test.condition, body.error or "string(NULL)"),
                otherwise=other.error or "string(NULL)",
            )
        return Term(
            _choice(test, body, other), first_error(test.error, taken), nan=body.nan or other.nan
        )

    def on_Call(self, node: ast.Call) -> Term:
        name, arguments = node.func.id, node.args
        if name == "pow" and len(arguments) == 3:
            return self._modular_power(arguments)
        digits = None
        if name == "round" and len(arguments) == 2:
            digits = literal_int(arguments[1])
            if digits is not None:
                arguments = arguments[:1]
        each = self.term if name == "iif" else self.numeric
        parts = [each(argument) for argument in arguments]
        made = _call(name, parts, digits)
        errors = [part.error for part in parts]
        return Term(made.value, first_error(*errors, made.error), nan=True)

    def _modular_power(self, arguments: list[ast.AST]) -> Term:
        values = [literal_int(argument) for argument in arguments]
        if None not in values:
            try:
                return Term(f"double('{float(pow(*values))!r}')")
            except OverflowError:
                return _failure(OVERFLOW)
            except ValueError as problem:
                return _failure(f"VALUE_ERROR: {problem}")
        errors = [self.numeric(argument).error for argument in arguments]
        refused = text("EXECUTION_ERROR: pow() with 3 arguments needs integers")
        return Term("double(NULL)", first_error(*errors, refused))


def _compare(op: ast.cmpop, left: Term, right: Term) -> str:
    def holds(a: str, b: str) -> str:
        plain = f"({a} {COMPARE[type(op)]} {b})"
        # Spark holds NaN equal to itself and above all numbers.
        for value, side in ((a, left), (b, right)):
            if side.nan and isinstance(op, ast.NotEq):
                plain = f"(isnan({value}) OR {plain})"
            elif side.nan:
                plain = f"(NOT isnan({value}) AND {plain})"
        return plain

    if not (left.nan or right.nan):
        return holds(left.number, right.number)
    return _named(holds, left.number, right.number)


def _floored_mod(a: str, b: str) -> Term:
    def floored(a: str, b: str) -> str:
        rest = f"try_mod({a}, {b})"
        shift = case((f"signum({rest}) * signum({b}) < 0D", b), otherwise="0D")
        return f"({rest} + {shift})"

    return Term(_named(floored, a, b), case((f"{b} = 0D", text(ZERO_DIVISOR))))


def _power(a: str, b: str) -> Term:
    def failed(a: str, b: str) -> str:
        return case(
            (f"{a} = 0D AND {b} < 0D", text(ZERO_DIVISOR)),
            (f"{a} < 0D AND rint({b}) <> {b}", text(RESULT_TYPE)),
            (f"{_infinite(f'power({a}, {b})')} AND {_finite(a)} AND {_finite(b)}", text(OVERFLOW)),
        )

    return Term(f"power({a}, {b})", _named(failed, a, b))


def _choice(test: Term, body: Term, other: Term) -> str:
    return case((test.condition, body.number), otherwise=other.number)


def _whole(x: str, value: str) -> Term:
    """A rounding to a whole number: undefined for NaN and infinity."""
    return Term(
        value, case((f"isnan({x})", text(NAN_TO_INT)), (_infinite(x), text(OVERFLOW)))
    )


def _to_long(x: str, rounding: str) -> str:
    # floor and ceil return a bigint, which saturates; from 2**53 on a double
    # is whole anyway.
    return _named(
        lambda x: case((f"abs({x}) < {2.0**53!r}D", f"double({rounding}({x}))"), otherwise=x), x
    )


def _natural_log(x: str) -> Term:
    return Term(f"ln({x})", case((f"{x} <= 0D", text(DOMAIN))))


def _periodic(function: str, x: str) -> Term:
    return Term(f"{function}({x})", case((_infinite(x), text(DOMAIN))))


# exp(j / STEPS) for j from -MOST to MOST, each as a double and what that lacks.
STEPS, MOST = 64, 23
LOG2_E = 1.4426950408889634
LN2_HIGH, LN2_LOW = 6.93147180369123816490e-01, 1.90821492927058770002e-10


def _exp_table() -> tuple[str, str]:
    with localcontext() as context:
        context.prec = 50
        exact = [(Decimal(j) / STEPS).exp() for j in range(-MOST, MOST + 1)]
        rest = [float(value - Decimal(float(value))) for value in exact]
    highs, lows = (", ".join(f"{number!r}D" for number in part) for part in (map(float, exact), rest))
    return f"array({highs})", f"array({lows})"


def _bound(name: str, value: str, body: str) -> str:
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _exponential(x: str) -> str:
    """exp within 0.52 units of the last place, as C and Python have it; Spark's may be a whole unit off.

    x is k ln 2 + j / STEPS + a rest below 0.01, of which ``expm1`` is precise enough.
    """
    highs, lows = _exp_table()
    high, low = (f"get({part}, int(j) + {MOST})" for part in (highs, lows))
    made = _bound("h", high, f"(h + ({low} + h * q)) * power(2D, k - 1D) * 2D")
    made = _bound("q", f"expm1(r - j / {STEPS}D - k * {LN2_LOW!r}D)", made)
    made = _bound("j", f"rint(r * {STEPS}D)", made)
    made = _bound("r", f"x - k * {LN2_HIGH!r}D", made)
    made = _bound("k", f"rint(x * {LOG2_E!r}D)", made)
    return _bound("x", x, case(("x > -700D AND x < 710D", made), otherwise="exp(x)"))


ONE_ARGUMENT: dict[str, Callable[[str], Term]] = {
    "abs": lambda x: Term(f"abs({x})"),
    "round": lambda x: _whole(x, f"(rint({x}) + 0D)"),
    "ceil": lambda x: _whole(x, _to_long(x, "ceil")),
    "floor": lambda x: _whole(x, _to_long(x, "floor")),
    "sqrt": lambda x: Term(f"sqrt({x})", case((f"{x} < 0D", text(DOMAIN)))),
    "log": _natural_log,
    "log10": lambda x: Term(f"log10({x})", case((f"{x} <= 0D", text(DOMAIN)))),
    "exp": lambda x: Term(
        _exponential(x), case((f"{_infinite(f'exp({x})')} AND {_finite(x)}", text(OVERFLOW)))
    ),
    "sin": lambda x: _periodic("sin", x),
    "cos": lambda x: _periodic("cos", x),
    "tan": lambda x: _periodic("tan", x),
}


# No double has a digit further from the point.
ALL_DIGITS = 330


def _fold(values: list[str], sign: str) -> str:
    """The values joined from left to right, as one flat expression whatever their number."""
    return f"aggregate(array({', '.join(values[1:])}), double({values[0]}), (a, v) -> a {sign} v)"


def _call(name: str, parts: list[Term], digits: int | None) -> Term:
    count = len(parts)
    values = [part.number for part in parts]
    if digits is not None:
        if digits > ALL_DIGITS:
            return Term(values[0])
        if digits < -ALL_DIGITS:
            return Term(_named(lambda x: case((_finite(x), f"({x} * 0D)"), otherwise=x), values[0]))
        return Term(f"bround({values[0]}, {digits})")
    if name in ONE_ARGUMENT and count == 1:
        return ONE_ARGUMENT[name](values[0])
    if name == "log" and count == 2:
        logs = [_natural_log(value) for value in values]
        base_one = case((f"{values[1]} = 1D", text(ZERO_DIVISOR)))
        return Term(
            f"try_divide({logs[0].value}, {logs[1].value})",
            first_error(logs[0].error, logs[1].error, base_one),
        )
    if name == "pow" and count == 2:
        return _power(*values)
    if name in ("min", "max") and count >= 2:
        return Term(f"{'least' if name == 'min' else 'greatest'}({', '.join(values)})")
    if name in ("_add", "_multiply"):
        return Term(_fold(values, "+" if name == "_add" else "*"))
    if name in ("avg", "sum"):
        total = f"({' + '.join(values)})" if values else "0D"
        if count > CHAIN:
            total = _fold(values, "+")
        return Term(f"({total} / {count}D)" if name == "avg" and count > 1 else total)
    if name == "iif" and count == 3:
        return Term(_choice(*parts))
    return _failure(f"EXECUTION_ERROR: {name}() cannot take these arguments")

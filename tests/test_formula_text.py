import ast

import pytest

from gaugework.functions.formula_text import SYNTAX, read_formula


@pytest.mark.parametrize(
    "text, shape, constants",
    [
        ("[a] * 0.001", "x[0] * k[0]", (0.001,)),
        ("([a] + [b]) / 2", "(x[0] + x[1]) / k[0]", (2.0,)),
        ("[b] - [a] - [b]", "x[0] - x[1] - x[0]", ()),
        ("1 if [a] > 100 else 0", "k[1] if x[0] > k[0] else k[2]", (100.0, 1.0, 0.0)),
        ("IF ([a] > 1) THEN [a] ELSE [b]", "x[0] if x[0] > k[0] else x[1]", (1.0,)),
        ("if [a] > 1 then 2 else 3", "k[1] if x[0] > k[0] else k[2]", (1.0, 2.0, 3.0)),
        ("[a] ^ 2", "x[0] ** k[0]", (2.0,)),
        ("Iif([a], 1, 2)", "iif(x[0], k[0], k[1])", (1.0, 2.0)),
        ("AVERAGE([a], [b])", "avg(x[0], x[1])", ()),
        ("round([a], 2)", "round(x[0], 2)", ()),
        ("round([a] * 2)", "round(x[0] * k[0])", (2.0,)),
        ("SUM([a]) / 2", "sum(x[0]) / k[0]", (2.0,)),
    ],
)
def test_shape(text, shape, constants):
    formula = read_formula(text)
    assert (formula.shape, formula.constants, formula.compile_error) == (shape, constants, None)


@pytest.mark.parametrize(
    "text, same_as",
    [
        ("(IF ([a] > 1) THEN 2 ELSE 3) * 2", "(2 if [a] > 1 else 3) * 2"),
        ("IF ([a]>1) THEN 1 ELSE IF ([a]>2) THEN 2 ELSE 3", "1 if [a]>1 else (2 if [a]>2 else 3)"),
        ("IF [a] THEN IF [b] THEN 1 ELSE 2 ELSE 3", "(1 if [b] else 2) if [a] else 3"),
        ("IF [a] THEN 1 if [b] else 2 ELSE 3", "(1 if [b] else 2) if [a] else 3"),
        ("IF IF [a] THEN 1 ELSE 0 THEN 5 ELSE 6", "5 if (1 if [a] else 0) else 6"),
        ("1 if [a] else IF [b] THEN 2 ELSE 3", "1 if [a] else (2 if [b] else 3)"),
        ("max(IF [a] THEN 1 ELSE 2, 5)", "max((1 if [a] else 2), 5)"),
        ("4 + IF ([a] > 1) and [b] THEN 1 ELSE 2 + 3", "4 + (1 if ([a] > 1) and [b] else 2 + 3)"),
        ("IF(([a]))THEN(1)ELSE(2)", "1 if [a] else 2"),
    ],
)
def test_if_then_else_is_the_conditional(text, same_as):
    assert read_formula(text).compile_error is None

    def spelled(formula):
        shape = formula.shape
        for i, value in enumerate(formula.constants):
            shape = shape.replace(f"k[{i}]", repr(value))
        for i, node in enumerate(formula.nodes):
            shape = shape.replace(f"x[{i}]", node)
        return ast.dump(ast.parse(shape, mode="eval"))

    assert spelled(read_formula(text)) == spelled(read_formula(same_as))


@pytest.mark.parametrize(
    "text, aggregate, shape",
    [
        ("SUM([a] + [b])", "sum", "x[0] + x[1]"),
        (" Average ( [a] * 2 ) ", "avg", "x[0] * k[0]"),
        ("AVG(IF [a] > 1 THEN 2 ELSE 3)", "avg", "k[1] if x[0] > k[0] else k[2]"),
        ("AVG([a]) - AVG([b])", None, "avg(x[0]) - avg(x[1])"),
        ("AVG([a], [b])", None, "avg(x[0], x[1])"),
        ("SUM([a]) / 2", None, "sum(x[0]) / k[0]"),
        ("(SUM([a]))", None, "sum(x[0])"),
        ("SUM([a] + )", "sum", None),
    ],
)
def test_outer_aggregate(text, aggregate, shape):
    formula = read_formula(text)
    assert (formula.aggregate, formula.shape) == (aggregate, shape)


def test_nodes_keep_their_first_mention_and_repeats():
    formula = read_formula("[b] + [ns=2;s=IF.THEN 'x'] + [b]")
    assert formula.nodes == ("b", "ns=2;s=IF.THEN 'x'")
    assert formula.mentions == ("b", "ns=2;s=IF.THEN 'x'", "b")
    assert formula.compile_error is None


@pytest.mark.parametrize(
    "text, error",
    [
        ("none", "COMPILE_ERROR: Null formula"),
        (" NULL ", "COMPILE_ERROR: Null formula"),
        ("'x'", "COMPILE_ERROR: Formula returns string value — not supported"),
        ("[a] +", SYNTAX),
        ("2[a]", SYNTAX),
        ("[a][b]", SYNTAX),
        ("[a] AND [b]", SYNTAX),
        ("[a] = 1", SYNTAX),
        ("[a] <> 1", SYNTAX),
        ("IF [a] THEN 1", SYNTAX),
        ("((([a])", SYNTAX),
        ("[a] = 1; [b]", SYNTAX),
        ("ABS([a])", "COMPILE_ERROR: Compile error: Unsafe function: ABS"),
        ("eval([a])", "COMPILE_ERROR: Compile error: Unsafe function: eval"),
        ("[a].b()", "COMPILE_ERROR: Compile error: Unsafe function: ?"),
        ("[a].real", "COMPILE_ERROR: Compile error: Attribute access not allowed"),
        ("(lambda: 1)", "COMPILE_ERROR: Compile error: Function definitions not allowed"),
        ("max([a], key=1)", "COMPILE_ERROR: Compile error: Keyword arguments not allowed"),
    ],
)
def test_compile_errors(text, error):
    assert read_formula(text).compile_error == error

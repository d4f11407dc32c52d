"""Reading formula text: one short pass per row of the formula table.

The result names everything a Spark plan needs: the nodes, the constants, an
outer aggregate if there is one, and the *shape*, which is the formula with
nodes and constants replaced by ``x[0], x[1], …`` and ``k[0], k[1], …``, which no
formula can contain by itself. Formulas of one shape share one Column expression.
"""

from __future__ import annotations

import ast
import operator
import re
from dataclasses import dataclass

# Spelling of references, words and messages.
NODE = re.compile(r"\[([^\]]+)\]")
WORD_OR_MARK = re.compile(r"\s+|[A-Za-z_]\w*|[(),]|.", re.DOTALL)
OUTER_CALL = re.compile(r"\s*(sum|avg|average)\s*\(", re.IGNORECASE)
FUNCTIONS = {
    "abs", "round", "min", "max", "pow", "sqrt", "ceil", "floor", "log", "log10",
    "exp", "sin", "cos", "tan", "avg", "average", "sum", "iif",
}
ANY_CASE = {"avg": "avg", "average": "avg", "sum": "sum", "iif": "iif"}
NULL_FORMULA = "COMPILE_ERROR: Null formula"
TEXT_RESULT = "COMPILE_ERROR: Formula returns string value — not supported"
SYNTAX = "COMPILE_ERROR: Syntax error: invalid formula"
TOO_DEEP = "EXECUTION_ERROR: formula is nested too deeply"

# Sums and products of more operands than this are one call, not a chain of nested
# operations; what is nested deeper than the limit is refused, as Spark's own
# parser could not read its expression.
CHAIN = 20
DEPTH = 100


WHOLE = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul}


class FormulaError(ValueError):
    """The formula can never be evaluated; the message is the error code."""


@dataclass(frozen=True)
class Formula:
    nodes: tuple[str, ...]  # distinct, by first mention
    mentions: tuple[str, ...]  # every mention, in order
    aggregate: str | None  # "sum" or "avg" when one call spans the formula
    shape: str | None
    constants: tuple[float, ...]
    compile_error: str | None


@dataclass(frozen=True)
class Shape:
    id: int
    text: str
    kinds: frozenset[str]  # how formulas of this shape are evaluated


def read_formula(text: str) -> Formula:
    """Split a formula into nodes, constants and shape."""
    mentions = tuple(NODE.findall(text))
    nodes = tuple(dict.fromkeys(mentions))
    words = re.findall(r"\w+", NODE.sub(" ", text))
    prefix = "x"
    while any(word.startswith(prefix) for word in words):  # no word of the text is an operand's name
        prefix += "x"
    names = {node: f"{prefix}{i}" for i, node in enumerate(nodes)}
    body = NODE.sub(lambda match: f" {names[match.group(1)]} ", text).strip()
    inner, aggregate = _outer_aggregate(body)
    try:
        tree = _parse(inner)
        if aggregate and isinstance(tree.body, (ast.Tuple, ast.Starred)):
            tree, aggregate = _parse(body), None
        tree = ast.Expression(_flat(tree.body))
        if _too_deep(tree):
            raise FormulaError(TOO_DEEP)
        constants = _lift(tree, {name: i for i, name in enumerate(names.values())})
        return Formula(nodes, mentions, aggregate, ast.unparse(tree), tuple(constants), None)
    except FormulaError as problem:
        return Formula(nodes, mentions, aggregate, None, (), str(problem))
    except RecursionError:
        return Formula(nodes, mentions, aggregate, None, (), TOO_DEEP)


def _outer_aggregate(body: str) -> tuple[str, str | None]:
    """The argument text and name of a SUM/AVG call spanning all of ``body``."""
    call = OUTER_CALL.match(body)
    if not call:
        return body, None
    depth = 1
    for at in range(call.end(), len(body)):
        depth += {"(": 1, ")": -1}.get(body[at], 0)
        if depth == 0:
            inner = body[call.end() : at].strip()
            if inner and not body[at + 1 :].strip():
                return inner, ANY_CASE[call.group(1).lower()]
            break
    return body, None


def _parse(text: str) -> ast.Expression:
    if text.lower() in ("none", "null", ""):
        raise FormulaError(NULL_FORMULA)
    if '"' in text or "'" in text:
        raise FormulaError(TEXT_RESULT)
    words = _Words(text.replace("^", "**"))
    try:
        tree = ast.parse(words.rewrite().strip(), mode="eval")
    except (SyntaxError, ValueError, RecursionError, MemoryError) as problem:
        raise FormulaError(SYNTAX) from problem
    for node in ast.walk(tree):
        if isinstance(node, ast.Name):
            node.id = ANY_CASE.get(node.id.lower(), node.id)
    for node in ast.walk(tree):
        _refuse(node)
    return tree


def _refuse(node: ast.AST) -> None:
    """Raise for what no formula may contain."""
    if isinstance(node, ast.Call):
        name = getattr(node.func, "id", "?")
        if name not in FUNCTIONS:
            raise FormulaError(f"COMPILE_ERROR: Compile error: Unsafe function: {name}")
        if node.keywords:
            raise FormulaError("COMPILE_ERROR: Compile error: Keyword arguments not allowed")
    elif isinstance(node, ast.Attribute):
        raise FormulaError("COMPILE_ERROR: Compile error: Attribute access not allowed")
    elif isinstance(node, ast.Lambda):
        raise FormulaError("COMPILE_ERROR: Compile error: Function definitions not allowed")


def _flat(body: ast.expr) -> ast.expr:
    """``body`` with long chains of ``+ -`` or of ``*`` as calls of ``_add`` and ``_multiply``.

    Works without recursion along a chain. The names cannot be a user's: only
    listed functions may be called. A run of signs becomes one sign or none.
    """

    def operands(node: ast.expr, kinds: tuple[type, ...]) -> list[ast.expr]:
        found = []
        while isinstance(node, ast.BinOp) and isinstance(node.op, kinds):
            right = node.right
            found.append(ast.UnaryOp(ast.USub(), right) if isinstance(node.op, ast.Sub) else right)
            node = node.left
        return [node, *reversed(found)]

    def unsigned(node: ast.expr) -> ast.expr:
        minus, signs = False, 0
        while isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            minus ^= isinstance(node.op, ast.USub)
            signs, node = signs + 1, node.operand
        return ast.UnaryOp(ast.USub() if minus else ast.UAdd(), node) if signs else node

    class Flat(ast.NodeTransformer):
        def visit_BinOp(self, node: ast.BinOp) -> ast.AST:
            for kinds, name in (((ast.Add, ast.Sub), "_add"), ((ast.Mult,), "_multiply")):
                if isinstance(node.op, kinds) and len(parts := operands(node, kinds)) > CHAIN:
                    return ast.Call(ast.Name(name, ast.Load()), [self.visit(part) for part in parts], [])
            return self.generic_visit(node)

        def visit_UnaryOp(self, node: ast.UnaryOp) -> ast.AST:
            return self.generic_visit(unsigned(node))

    return Flat().visit(body)


def _too_deep(tree: ast.AST) -> bool:
    level, depth = [tree], 0
    while level:
        level, depth = [child for node in level for child in ast.iter_child_nodes(node)], depth + 1
        if depth > DEPTH:
            return True
    return False


def _slot(array: str, index: int) -> ast.Subscript:
    return ast.Subscript(ast.Name(array, ast.Load()), ast.Constant(index), ast.Load())


def _lift(tree: ast.Expression, operands: dict[str, int]) -> list[float]:
    """Put ``x[i]`` for operands and ``k[i]`` for number literals, in place."""
    constants: list[float] = []

    class Lift(ast.NodeTransformer):
        def visit_Name(self, node: ast.Name) -> ast.AST:
            return _slot("x", operands[node.id]) if node.id in operands else node

        def visit_Constant(self, node: ast.Constant) -> ast.AST:
            if type(node.value) not in (int, float):
                return node
            try:
                constants.append(float(node.value))
            except OverflowError:
                constants.append(float("inf"))
            return _slot("k", len(constants) - 1)

        def visit_Call(self, node: ast.Call) -> ast.AST:
            # Digits of round() and the integers of a three-argument pow()
            # change the plan, not just a value in it, so they stay in the shape.
            kept = {"round": slice(1, 2), "pow": slice(0, 3)}.get(node.func.id)
            fixed = node.args[kept] if kept else []
            if node.func.id == "pow" and len(node.args) != 3:
                fixed = []
            fixed = [arg for arg in fixed if literal_int(arg) is not None]
            node.args = [arg if arg in fixed else self.visit(arg) for arg in node.args]
            return node

    Lift().visit(tree)
    return constants


def literal_int(node: ast.AST) -> int | None:
    """The value of an integer literal, or of signs and sums, differences or products of such, else None."""
    if isinstance(node, ast.Constant) and type(node.value) is int:
        return node.value
    if isinstance(node, ast.BinOp) and type(node.op) in WHOLE:
        left, right = literal_int(node.left), literal_int(node.right)
        return None if left is None or right is None else WHOLE[type(node.op)](left, right)
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
        value = literal_int(node.operand)
        if value is not None:
            return -value if isinstance(node.op, ast.USub) else value
    return None


class _Words:
    """Rewrites IF c THEN a ELSE b to a conditional, minding parentheses.

    ELSE reaches to the end of the enclosing parenthesis, argument or text. An
    ``if`` without its THEN is the infix conditional and is left alone.
    """

    def __init__(self, text: str) -> None:
        self.parts = WORD_OR_MARK.findall(text)
        self.at = 0

    def rewrite(self) -> str:
        text = self._until(())
        while self.at < len(self.parts):  # unbalanced: leave it for the parser
            text += self.parts[self.at]
            self.at += 1
            text += self._until(())
        return text

    def _until(self, stops: tuple[str, ...]) -> str:
        """Text up to a stop word, a comma or a closing parenthesis."""
        out: list[str] = []
        infix = 0
        while self.at < len(self.parts):
            part = self.parts[self.at]
            word = part.lower()
            if part in "),":
                break
            if word in stops and not (word == "else" and infix):
                break
            self.at += 1
            if part == "(":
                out += [part, self._closed()]
            elif word == "if" and self._then_ahead():
                out.append(self._conditional())
            else:
                infix += {"if": 1, "else": -1}.get(word, 0)
                out.append(part)
        return "".join(out)

    def _closed(self) -> str:
        out = self._until(())
        while self.at < len(self.parts):
            part = self.parts[self.at]
            self.at += 1
            out += part
            if part == ")":
                break
            out += self._until(())
        return out

    def _conditional(self) -> str:
        condition = self._until(("then",))
        self.at += 1
        chosen = self._until(("else",))
        if self.at >= len(self.parts) or self.parts[self.at].lower() != "else":
            raise FormulaError(SYNTAX)
        self.at += 1
        other = self._until(("else", "then"))
        return f" (({chosen.strip()}) if ({condition.strip()}) else ({other.strip()})) "

    def _then_ahead(self) -> bool:
        """Whether the ``if`` just passed has a THEN of its own."""
        depth = 0
        open_words: list[str] = []
        for part in self.parts[self.at :]:
            word = part.lower()
            depth += {"(": 1, ")": -1}.get(part, 0)
            if depth < 0 or (depth == 0 and part == ","):
                return False
            if depth or word not in ("if", "then", "else"):
                continue
            if word == "if":
                open_words.append(word)
            elif not open_words:
                return word == "then"
            elif word == "then":
                open_words[-1] = word
            else:
                open_words.pop()
        return False

"""Small arithmetic expressions of templates, compiled to columns. Nothing is evaluated in Python, and what is not listed here is refused."""

from __future__ import annotations

import ast
import operator
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class UnsafeExpression(ValueError):
    """The expression uses something that templates may not use."""


_floor_div = lambda a, b: F.floor(a / b)
_mod = lambda a, b: a - F.floor(a / b) * b  # noqa: E731  the sign of the divisor, as in Python
_BINARY: dict[type, Callable] = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: lambda a, b: a.cast("double") / b, ast.FloorDiv: _floor_div, ast.Mod: _mod, ast.Pow: F.pow}
_COMPARE: dict[type, Callable] = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}
_UNARY: dict[type, Callable] = {ast.Not: operator.invert, ast.USub: operator.neg, ast.UAdd: lambda a: a}


def _many(columns: list[Column], pick: Callable) -> Column:
    return pick(*columns) if len(columns) > 1 else columns[0]


_CALLS: dict[str, Callable[[list[Column]], Column]] = {
    "abs": lambda a: F.abs(a[0]),
    "float": lambda a: a[0].cast("double"),
    "int": lambda a: F.when(a[0] < 0, F.ceil(a[0])).otherwise(F.floor(a[0])).cast("long"),
    "len": lambda a: F.length(a[0]),
    "max": lambda a: _many(a, F.greatest),
    "min": lambda a: _many(a, F.least),
    "round": lambda a: F.bround(a[0], 0),
    "sorted": lambda a: F.array_sort(F.array(*a)),
    "str": lambda a: a[0].cast("string"),
    "sum": lambda a: reduce(operator.add, a),
}


def names_in(expression: str) -> frozenset[str]:
    """The variables that an expression reads."""
    tree = _parse(expression)
    called = {n.func.id for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)}
    return frozenset(n.id for n in ast.walk(tree) if isinstance(n, ast.Name)) - called


def _parse(expression: str) -> ast.Expression:
    try:
        return ast.parse(expression.strip(), mode="eval")
    except SyntaxError as e:
        raise UnsafeExpression(f"{expression!r} is no expression") from e


def compile_expression(expression: str, variables: Mapping[str, Column]) -> Column:
    """The column of an expression over the columns of its variables."""

    def build(node: ast.AST) -> Column:
        match node:
            case ast.Expression(body=body):
                return build(body)
            case ast.Constant(value=bool() | int() | float() | str() as value):
                return F.lit(value)
            case ast.Name(id=name) if name in variables:
                return variables[name]
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
                return _BINARY[type(op)](build(a), build(b))
            case ast.UnaryOp(op=op, operand=a):
                return _UNARY[type(op)](build(a))
            case ast.BoolOp(op=op, values=values):
                return reduce(operator.and_ if isinstance(op, ast.And) else operator.or_, map(build, values))
            case ast.Compare(left=left, ops=ops, comparators=rights):
                sides = [left, *rights]
                return reduce(operator.and_, [compare(a, op, b) for a, op, b in zip(sides, ops, rights, strict=False)])
            case ast.IfExp(test=test, body=a, orelse=b):
                return F.when(build(test), build(a)).otherwise(build(b))
            case ast.Call(func=ast.Name(id="round"), args=[number, ast.Constant(value=int() as digits)], keywords=[]):
                return F.bround(build(number), digits)
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in _CALLS and args:
                inner = args[0].elts if len(args) == 1 and isinstance(args[0], ast.List | ast.Tuple) else args
                return _CALLS[name]([build(a) for a in inner])
        raise UnsafeExpression(f"{ast.unparse(node) if isinstance(node, ast.expr) else type(node).__name__} may not be used in {expression!r}")

    def compare(a: ast.AST, op: ast.AST, b: ast.AST) -> Column:
        if isinstance(op, ast.In | ast.NotIn) and isinstance(b, ast.List | ast.Tuple):
            inside = build(a).isin(*[build(x) for x in b.elts])
            return inside if isinstance(op, ast.In) else ~inside
        if type(op) in _COMPARE:
            return _COMPARE[type(op)](build(a), build(b))
        raise UnsafeExpression(f"{type(op).__name__} may not be used in {expression!r}")

    return build(_parse(expression))


def shared_variables(text: Column, expression: str) -> Column:
    """The placeholders of a text that the expression reads: a distractor with any is no distractor."""
    named = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\{(\w+)\}"), F.lit(1)))
    return F.array_sort(F.array_intersect(named, F.array(*map(F.lit, sorted(names_in(expression)))).cast("array<string>")))

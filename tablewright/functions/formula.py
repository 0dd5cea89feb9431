"""A user formula as a native column expression.

Python's own ``ast`` module reads the text; each allowed node maps to a column
operation, so the formula runs inside Catalyst and nothing is evaluated as code.
"""

from __future__ import annotations

import ast
import operator
import re

from pyspark.sql import Column, DataFrame, functions as F

from .columns import col, ieee_divide, natural_log

_COMPARE = {ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt,
            ast.GtE: operator.ge, ast.Eq: operator.eq, ast.NotEq: operator.ne}

# fixed values: functions a formula may call
_CALLS = {
    "abs": F.abs, "arccos": F.acos, "arccosh": F.acosh, "arcsin": F.asin, "arcsinh": F.asinh,
    "arctan": F.atan, "arctan2": F.atan2, "arctanh": F.atanh, "ceil": F.ceil, "cos": F.cos,
    "cosh": F.cosh, "exp": F.exp, "expm1": F.expm1, "floor": F.floor, "log": natural_log,
    "log10": lambda x: natural_log(x) / F.lit(2.302585092994046), "log1p": lambda x: natural_log(x + 1),
    "sin": F.sin, "sinh": F.sinh, "sqrt": F.sqrt, "tan": F.tan, "tanh": F.tanh,
}


def formula_column(df: DataFrame, formula: str) -> Column:
    """Column for ``formula``; backticks quote names with spaces, as in "`unit price` * 2"."""
    quoted: dict[str, str] = {}

    def stand_in(match):
        key = f"quoted_name_{len(quoted)}"
        quoted[key] = match.group(1)
        return key

    text = re.sub(r"`([^`]+)`", stand_in, formula.strip())
    try:
        tree = ast.parse(text, mode="eval")
    except SyntaxError as problem:
        raise ValueError(f"cannot read formula {formula!r}: {problem.msg}") from None
    return _column(df, tree.body, quoted)


def _column(df: DataFrame, node: ast.AST, quoted: dict[str, str]) -> Column:
    def go(n):
        return _column(df, n, quoted)

    match node:
        case ast.Constant(value=bool() | int() | float() | str() as value):
            return F.lit(value)
        case ast.Name(id=name):
            name = quoted.get(name, name)
            if name not in df.columns:
                raise ValueError(f"formula names an unknown column: {name!r}")
            return col(name)
        case ast.BinOp(left=a, op=op, right=b):
            return _binary(op, go(a), go(b))
        case ast.UnaryOp(op=ast.USub(), operand=a):
            return -go(a)
        case ast.UnaryOp(op=ast.UAdd(), operand=a):
            return go(a)
        case ast.UnaryOp(op=ast.Not() | ast.Invert(), operand=a):
            return ~go(a)
        case ast.BoolOp(op=op, values=values):
            joined = go(values[0])
            for v in values[1:]:
                joined = joined & go(v) if isinstance(op, ast.And) else joined | go(v)
            return joined
        case ast.Compare(left=left, ops=ops, comparators=rights):
            chain, joined = [left, *rights], None
            for i, op in enumerate(ops):
                test = _compare(df, op, chain[i], chain[i + 1], go)
                joined = test if joined is None else joined & test
            return joined
        case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in _CALLS:
            return _CALLS[name](*[go(a) for a in args])
    raise ValueError(f"formula uses something not allowed: {ast.unparse(node)!r}")


def _binary(op: ast.operator, a: Column, b: Column) -> Column:
    match op:
        case ast.Add():
            return a + b
        case ast.Sub():
            return a - b
        case ast.Mult():
            return a * b
        case ast.Div():
            return ieee_divide(a, b)
        case ast.FloorDiv():
            return F.floor(ieee_divide(a, b))
        case ast.Mod():
            return a - F.floor(F.try_divide(a.cast("double"), b)) * b
        case ast.Pow():
            return F.pow(a, b)
        case ast.BitAnd():
            return a & b
        case ast.BitOr():
            return a | b
    raise ValueError(f"formula uses an operator that is not allowed: {type(op).__name__}")


def _compare(df: DataFrame, op: ast.cmpop, left: ast.AST, right: ast.AST, go) -> Column:
    if isinstance(op, (ast.In, ast.NotIn)) and isinstance(right, (ast.List, ast.Tuple)):
        found = go(left).isin([ast.literal_eval(e) for e in right.elts])
        return ~found if isinstance(op, ast.NotIn) else found
    if type(op) not in _COMPARE:
        raise ValueError(f"formula uses a comparison that is not allowed: {type(op).__name__}")
    return _COMPARE[type(op)](go(left), go(right))

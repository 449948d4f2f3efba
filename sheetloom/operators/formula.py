"""Users' indicator formulas, compiled to column expressions.

A formula has numbers, names, + - * /, signs and min, max, round and abs. Anything else is refused, as are formulas of
over LENGTH characters, NODES parts or DEPTH levels. A null anywhere makes the result null, also within min and max,
as does a division by zero; round goes to the even neighbour.
"""

from __future__ import annotations

import ast

from pyspark.sql import Column
from pyspark.sql import functions as F

LENGTH, NODES, DEPTH = 200, 60, 15


class FormulaError(ValueError):
    pass


def compiled(formula: str, names: dict[str, Column]) -> Column:
    """The formula over named columns."""
    if len(formula) > LENGTH:
        raise FormulaError("too long")
    try:
        tree = ast.parse(formula.strip(), mode="eval").body
    except SyntaxError as e:
        raise FormulaError(f"not a formula: {e.msg}") from None
    if sum(1 for _ in ast.walk(tree)) > NODES:
        raise FormulaError("too many parts")
    return build(tree, names, 1)


def build(node: ast.expr, names: dict[str, Column], depth: int) -> Column:
    if depth > DEPTH:
        raise FormulaError("too deep")
    below = lambda n: build(n, names, depth + 1)
    match node:
        case ast.Constant(value=bool()):
            raise FormulaError("truth values aren't numbers")
        case ast.Constant(value=int() | float() as value):
            return F.lit(float(value))
        case ast.Name(id=name):
            if name not in names:
                raise FormulaError(f"unknown name {name}")
            return names[name].cast("double")
        case ast.UnaryOp(op=ast.UAdd(), operand=x):
            return below(x)
        case ast.UnaryOp(op=ast.USub(), operand=x):
            return -below(x)
        case ast.BinOp(left=a, op=ast.Add(), right=b):
            return below(a) + below(b)
        case ast.BinOp(left=a, op=ast.Sub(), right=b):
            return below(a) - below(b)
        case ast.BinOp(left=a, op=ast.Mult(), right=b):
            return below(a) * below(b)
        case ast.BinOp(left=a, op=ast.Div(), right=b):
            return F.try_divide(below(a), below(b))
        case ast.Call(func=ast.Name(id="abs"), args=[x], keywords=[]):
            return F.abs(below(x))
        case ast.Call(func=ast.Name(id="round"), args=[x], keywords=[]):
            return F.bround(below(x), 0)
        case ast.Call(func=ast.Name(id="round"), args=[x, ast.Constant(value=int() as places)], keywords=[]):
            return F.bround(below(x), places)
        case ast.Call(func=ast.Name(id="min" | "max" as name), args=args, keywords=[]) if args:
            parts = [below(x) for x in args]
            if len(parts) == 1:
                return F.lit(None).cast("double")
            any_null = parts[0].isNull()
            for p in parts[1:]:
                any_null = any_null | p.isNull()
            return F.when(~any_null, (F.least if name == "min" else F.greatest)(*parts))
    raise FormulaError(f"not allowed: {type(node).__name__}")


def finished(value: Column, places: int | None = 2, hide_zero: bool = False, fallback: float | None = None) -> Column:
    """A value as it is shown: rounded, 0 hidden or put in place of null; places=0 gives whole numbers."""
    v = value if fallback is None else F.coalesce(value, F.lit(fallback))
    v = F.bround(v, places) if places is not None else v
    v = F.when(v != 0, v) if hide_zero else v
    return v.cast("bigint") if places == 0 else v

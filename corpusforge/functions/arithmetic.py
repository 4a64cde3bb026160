"""Values of equations: numbers, brackets and the operators of a word problem, never evaluated as code."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|(\*\*|//|[-+*/%()]))")
#: How tightly an operator binds; ``~`` is a minus before a value.
_BINDS = {"+": 1, "-": 1, "*": 2, "/": 2, "//": 2, "%": 2, "~": 3, "**": 4}
#: Bits of the largest whole number; beyond it a value counts as none.
_MAX_BITS = 4096


def _apply(op: str, values: list) -> None:
    b = values.pop()
    if op == "~":
        values.append(-b)
        return
    a = values.pop()
    if op == "**":
        if isinstance(a, int) and isinstance(b, int) and b >= 0 and a.bit_length() * b > _MAX_BITS:
            raise OverflowError
        out = a**b
        if isinstance(out, complex):
            raise ValueError
    else:
        out = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "//": lambda: a // b, "%": lambda: a % b}[op]()
    if isinstance(out, int) and out.bit_length() > _MAX_BITS:
        raise OverflowError
    values.append(out)


def value(expression: str):
    """The number that an expression stands for. Two stacks instead of recursion, so nesting has no limit."""
    values, ops, at, wants_value = [], [], 0, True
    end = len(expression.rstrip())
    while at < end:
        m = _TOKEN.match(expression, at)
        if not m:
            raise ValueError(f"no number or operator at {at}")
        number, op = m.groups()
        at = m.end()
        if number is not None:
            if not wants_value:
                raise ValueError("two values in a row")
            values.append(int(number) if number.isdigit() else float(number))
            wants_value = False
        elif op == "(":
            if not wants_value:
                raise ValueError("a bracket after a value")
            ops.append(op)
        elif op == ")":
            if wants_value:
                raise ValueError("a bracket closes without a value")
            while ops and ops[-1] != "(":
                _apply(ops.pop(), values)
            if not ops:
                raise ValueError("a bracket closes that none opened")
            ops.pop()
        elif wants_value:
            if op == "-":
                ops.append("~")
            elif op != "+":
                raise ValueError("an operator without a value")
        else:
            while ops and ops[-1] != "(" and (_BINDS[ops[-1]] > _BINDS[op] or (_BINDS[ops[-1]] == _BINDS[op] and op != "**")):
                _apply(ops.pop(), values)
            ops.append(op)
            wants_value = True
    if wants_value or "(" in ops:
        raise ValueError("the expression ends early")
    while ops:
        _apply(ops.pop(), values)
    return values[0]


def right_side(equation: str | None) -> str | None:
    """The value after the first ``=`` of an equation, up to a second one, rounded to 4 places; null if it has none."""
    sides = (equation or "").split("=")
    if len(sides) < 2:
        return None
    try:
        return str(round(value(sides[1]), 4))
    except (ArithmeticError, ValueError):
        return None


def _equations(t: pd.Series) -> pd.Series:
    return t.map(right_side)


def equation_value(t: Column) -> Column:
    """The value of the right side of an equation as text: whole numbers without a point, others at 4 places.

    Null for a null or empty text, no ``=``, anything that isn't arithmetic, a division by
    zero and values out of range.
    """
    return F.pandas_udf(_equations, StringType())(t)

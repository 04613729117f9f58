"""Row-wise operators. Comparisons give 0 or 1; a null condition counts as true in if_else, and, or."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def divide(a, b):
    return F.when(F.abs(b) >= 1e-8, a / b)


def _compare(f, null: float):
    return lambda a, b: F.coalesce(f(a, b).cast("double"), F.lit(null))


def truthy(x):
    return F.coalesce(x != 0, F.lit(True))


def number(c: Column) -> Column:
    return c.cast("double")


BINARY = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": divide,
    ">": _compare(lambda a, b: a > b, 0.0),
    "<": _compare(lambda a, b: a < b, 0.0),
    ">=": _compare(lambda a, b: a >= b, 0.0),
    "<=": _compare(lambda a, b: a <= b, 0.0),
    "==": _compare(lambda a, b: a == b, 0.0),
    "!=": _compare(lambda a, b: a != b, 1.0),
    "&&": lambda a, b: number(truthy(a) & truthy(b)),
    "||": lambda a, b: number(truthy(a) | truthy(b)),
}


def _no_nan(x):
    return F.when(~F.isnan(x), x)


def weighted_sum(*args):
    return sum((v * w for v, w in zip(args[::2], args[1::2], strict=True)), F.lit(0.0))


CALLS = {
    "log": lambda x: F.when(x > 0, F.ln(x)),
    "abs": F.abs,
    "sign": F.signum,
    "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)),
    "signed_power": lambda x, p: F.signum(x) * F.pow(F.abs(x), p),
    "if_else": lambda c, a, b: F.when(truthy(c), a).otherwise(b),
    "where": lambda c, a, b: F.when(truthy(c), a).otherwise(b),
    "trade_when": lambda c, x: F.when(truthy(c), x).otherwise(0.0),
    "and": BINARY["&&"],
    "or": BINARY["||"],
    "not": lambda x: number(~truthy(x)),
    "pow": lambda a, b: _no_nan(F.pow(a, b)),
    "max": lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b)),
    "min": lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)),
    "weighted_sum": weighted_sum,
}
UNARY = {"-": lambda x: -x, "!": CALLS["not"]}

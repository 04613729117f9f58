"""Compiles expressions to one layered plan over a long panel.

Equal subtrees of all expressions are one column. Every window node has a class, T (rows of a ticker) or C (rows of a ts, maybe of a group in it), and a phase: the number of T-C changes below it. Nodes of a phase share one exchange, since their windows partition by the same keys; a node that needs another of its own phase is one sub-level later, which costs no exchange. So a plan has as many exchanges as its deepest change of class, however many expressions it holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import crosssection as cs
from ..functions import scalar as sc
from ..functions import timeseries as ts
from .ast import Node
from .parser import parse, validate

def register_operator(name: str, build: Callable[..., Column]) -> None:
    """Adds a row-wise function to the language: build(*columns) -> Column."""
    from . import ast

    ast.SCALAR_OPS.setdefault(name, build.__code__.co_argcount)
    sc.CALLS[name] = build


class Compiler:
    def __init__(self, keys: tuple[str, ...] = (), ticker: str = "ticker", time: str = "ts"):
        self.by_ticker = Window.partitionBy(*keys, ticker).orderBy(time)
        self.by_time = Window.partitionBy(*keys, time)
        self.by_group = lambda g: Window.partitionBy(*keys, time, g)
        self.order: dict[Node, tuple[int, int, str]] = {}

    def place(self, n: Node) -> tuple[int, int, str]:
        """(phase, sub-level, class) of the windows in n; (0, 0, '') without windows."""
        if n in self.order:
            return self.order[n]
        below = [p for p in map(self.place, n.args) if p[2]]
        if n.kind not in ("ts", "cs", "group"):
            out = max(below, default=(0, 0, ""))
        else:
            own = "T" if n.kind == "ts" else "C"
            phase = max((p + (c != own) for p, _, c in below), default=0)
            sub = 1 + max((s for p, s, c in below if p == phase and c == own), default=0)
            out = (phase, sub, own)
        self.order[n] = out
        return out

    def column(self, n: Node, made: dict[Node, str]) -> Column:
        """n from the columns made so far."""
        if n in made:
            return F.col(made[n])
        if n.kind == "number":
            return F.lit(float(n.value))
        if n.kind == "field":
            return F.col(n.name)
        args = [self.column(a, made) for a in n.args if a.kind != "text"]
        if n.kind == "binary":
            return sc.BINARY[n.name](*args)
        if n.kind == "unary":
            return sc.UNARY[n.name](*args)
        if n.kind == "scalar":
            return sc.CALLS[n.name](*args)
        if n.kind == "ts":
            return ts.OPS[n.name](*args[:-1], int(n.args[-1].value), self.by_ticker)
        if n.kind == "group":
            spec = self.by_group(F.col(n.args[1].name))
            f = {"group_rank": cs.rank, "group_zscore": cs.zscore, "group_mean": cs.group_mean, "group_neutralize": cs.demean}[n.name]
            return f(args[0], spec)
        if n.name in ("ind_neutralize", "sector_neutral"):
            if len(n.args) == 2:
                return cs.demean(args[0], self.by_group(F.col(n.args[1].name)))
            return (cs.zscore if n.name == "ind_neutralize" else cs.demean)(args[0], self.by_time)
        if n.name == "winsorize":
            return cs.winsorize(args[0], self.by_time, float(n.args[1].value) if len(n.args) == 2 else 3.0)
        return getattr(cs, n.name)(args[0], self.by_time)

    def add(self, df: DataFrame, named: dict[str, Node], keep: list[str]) -> DataFrame:
        """df's columns in keep, and a column for each expression."""
        windows: dict[Node, None] = {}
        for root in named.values():
            for n in root.walk():
                if n.kind in ("ts", "cs", "group"):
                    windows.setdefault(n)
        made: dict[Node, str] = {}
        # arguments of windows become columns first, so that equal windows are one expression
        for where in sorted({self.place(n) for n in windows}):
            level = [n for n in windows if self.place(n) == where]
            inner = {a: f"_a{len(made)}_{i}" for i, a in enumerate(dict.fromkeys(a for n in level for a in n.args if a.kind in ("binary", "unary", "scalar") and a not in made))}
            if inner:
                df = df.withColumns({c: self.column(a, made) for a, c in inner.items()})
                made |= inner
            fresh = {n: f"_w{len(made)}_{i}" for i, n in enumerate(level)}
            df = df.withColumns({c: self.column(n, made) for n, c in fresh.items()})
            made |= fresh
        return df.select(*keep, *(self.column(n, made).cast("double").alias(c) for c, n in named.items()))


def signals(panel: DataFrame, expressions: dict[str, str] | str, keys: tuple[str, ...] = (), keep: tuple[str, ...] = ("ts", "ticker")) -> DataFrame:
    """The panel's keep columns and a column for each expression ('signal' for a single one), all in one plan. Unknown fields are an error before anything runs."""
    named = {"signal": expressions} if isinstance(expressions, str) else expressions
    trees = {k: parse(e) for k, e in named.items()}
    for t in trees.values():
        validate(t, set(panel.columns))
    used = sorted(set().union(*(t.fields() for t in trees.values())) - {*keys, *keep})
    return Compiler(keys).add(panel.select(*keys, *keep, *used), trees, [*keys, *keep])

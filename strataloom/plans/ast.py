"""Typed tree of the expression language. Nodes are immutable and equal by content, so a set of them is a DAG with shared parts."""

from __future__ import annotations

from dataclasses import dataclass, field

TS_OPS = {"ts_mean": 1, "ts_std": 1, "ts_var": 1, "ts_sum": 1, "ts_max": 1, "ts_min": 1, "ts_rank": 1, "ts_decay_linear": 1, "ts_delta": 1, "ts_delay": 1, "ts_argmax": 1, "ts_argmin": 1, "ts_zscore": 1, "ts_skew": 1, "ts_kurt": 1, "ts_entropy": 1, "ts_corr": 2, "ts_cov": 2, "ts_momentum_decay": 1}
CS_OPS = ("rank", "zscore", "scale", "ind_neutralize", "sector_neutral", "winsorize", "normalize", "demean")
GROUP_OPS = ("group_rank", "group_zscore", "group_mean", "group_neutralize")
SCALAR_OPS = {"log": 1, "abs": 1, "sign": 1, "sqrt": 1, "signed_power": 2, "if_else": 3, "where": 3, "trade_when": 2, "and": 2, "or": 2, "not": 1, "pow": 2, "max": 2, "min": 2, "weighted_sum": None}
#: Binary operators and their binding power.
BINARY = {"||": 1, "&&": 2, ">": 3, "<": 3, ">=": 3, "<=": 3, "==": 3, "!=": 3, "+": 4, "-": 4, "*": 5, "/": 5}


@dataclass(frozen=True)
class Node:
    """kind: number, text, field, ts, cs, group, scalar, binary or unary."""

    kind: str
    name: str
    args: tuple[Node, ...] = ()
    value: float | str | None = field(default=None)

    def __str__(self) -> str:
        if self.kind == "number":
            v = float(self.value)
            return str(int(v)) if v.is_integer() and abs(v) < 1e15 else repr(v)
        if self.kind == "text":
            return f"'{self.value}'"
        if self.kind == "field":
            return self.name
        if self.kind == "unary":
            return f"({self.name}{self.args[0]})"
        if self.kind == "binary":
            return f"({self.args[0]} {self.name} {self.args[1]})"
        return f"{self.name}({', '.join(map(str, self.args))})"

    def walk(self):
        yield self
        for a in self.args:
            yield from a.walk()

    def depth(self) -> int:
        return 1 + max((a.depth() for a in self.args), default=0)

    def fields(self) -> set[str]:
        return {n.name for n in self.walk() if n.kind == "field"}

    def result_type(self) -> str:
        """GROUP > CS > TS > DATA > SCALAR over the whole tree."""
        order = ["number", "text", "field", "ts", "cs", "group"]
        top = max((order.index(n.kind) for n in self.walk() if n.kind in order), default=0)
        return ("SCALAR", "SCALAR", "DATA", "TS", "CS", "GROUP")[top]


def number(v: float) -> Node:
    return Node("number", "", (), float(v))


def data(name: str) -> Node:
    return Node("field", name)


def call(name: str, *args: Node) -> Node:
    kind = "ts" if name in TS_OPS else "cs" if name in CS_OPS else "group" if name in GROUP_OPS else "scalar" if name in SCALAR_OPS else None
    if kind is None:
        raise SyntaxError(f"unknown function {name!r}")
    return Node(kind, name, tuple(args))


def to_dict(node: Node) -> dict:
    return {"kind": node.kind, "name": node.name, "value": node.value, "args": [to_dict(a) for a in node.args]}


def from_dict(d: dict) -> Node:
    return Node(d["kind"], d["name"], tuple(from_dict(a) for a in d["args"]), d["value"])

"""Expression nodes as Catalyst columns.

Parsing is where a program's expression becomes data; compiling is the way back
to something that runs: each node becomes one built-in column expression, so a whole
expression stays inside code generation.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rungwise.operators.parser import Node, Parser

#: Calls that may be compiled; all others are refused.
CALLS: dict[str, Callable[..., Column]] = {"abs": F.abs, "sqrt": F.sqrt, "min": F.least, "max": F.greatest, "round": F.round, "trunc": lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))}
_BINARY = {"+": Column.__add__, "-": Column.__sub__, "*": Column.__mul__, "/": Column.__truediv__, "<": Column.__lt__, ">": Column.__gt__, "<=": Column.__le__, ">=": Column.__ge__, "==": Column.__eq__, "<>": Column.__ne__}


def expression(text: str) -> Node:
    parser = Parser(text)
    node = parser.expression()
    if parser.here() < len(text):
        raise parser.fault("end of text")
    return node


def compiled(n: Node, names: Callable[[str], Column] = F.col) -> Column:
    kids = [compiled(k, names) for k in n.kids] if n.kind != "TernaryOp" else []
    match n.kind:
        case "Literal":
            return F.lit({"integer": int, "real": float, "boolean": lambda t: t == "True", "string": str}[n.props["type"]](n.literal))
        case "VarRef":
            if n.props.get("state"):
                raise ValueError(f"{n.name}:{n.props['state']} needs the scan before")
            return names(n.name)
        case "BinOp" | "Compare":
            return _BINARY[n.name](*kids)
        case "UnaryOp":
            return -kids[0] if n.name == "-" else kids[0]
        case "NotOp":
            return ~kids[0]
        case "BoolOp":
            return reduce(Column.__and__ if n.name == "AND" else Column.__or__, kids)
        case "FuncCall":
            if n.name.lower() not in CALLS:
                raise ValueError(f"{n.name} is not a call that can be compiled")
            return CALLS[n.name.lower()](*kids)
        case "TernaryOp":
            out, k = F, 0
            while condition := n.of(f"condition:{k}"):
                out = out.when(compiled(condition[0], names), compiled(n.of(f"value:{k}")[0], names))
                k += 1
            return out.otherwise(compiled(n.of("else")[0], names))
    raise ValueError(f"{n.kind} can't be compiled")


def column(text: str, names: Callable[[str], Column] = F.col) -> Column:
    return compiled(expression(text), names)

"""Assignments of a shape that was met before: one match in place of a descent.

Where an assignment holds nothing but names, unsigned numbers, + - * / between operands and brackets, the
kinds of its words decide its tree. The parser reads one such assignment word by word; those after it that have
the same kinds of words in the same order are matched by a pattern and keep the match. Their nodes are made
for who asks for them, and their rows come from a table of the shape's nodes.
"""

from __future__ import annotations

import re
from functools import cache
from operator import itemgetter

from rungwise.functions import render
from rungwise.operators.tree import Node

#: Words that are no names in code.
KEYWORDS = frozenset("IF THEN ELSE ELSIF ENDIF AND OR NOT True False".split())
#: Words of a shape at most.
MOST = 80
_SPACE = r"[ \t\f\r\n]*"
# Every word below is followed by white space or a mark, so none can go on beyond its pattern.
_KINDS = {"name": "[A-Za-z_][A-Za-z0-9_]{0,19}", "real": r"[0-9]+\.[0-9]+(?:[eE][+-]?[0-9]+)?|[0-9]+[eE][+-]?[0-9]+", "integer": "[0-9]+", "mark": "[-+*/()=;]"}
_WORD = re.compile(_SPACE + "(?:" + "|".join(f"(?P<{k}>{p})" for k, p in _KINDS.items()) + ")")


class Shape:
    """A shape's pattern, and for each of its nodes in pre-order: kind, role, steps below the assignment, ordinal, parent (-1: the assignment's own), last node below, which words give name and literal, the words it starts and ends with, props."""

    __slots__ = ("match", "names", "nodes", "consts", "shown", "picks", "tail")

    def __init__(self, words: list[tuple[str, int, int, str]], node: Node):
        self.match = re.compile(_SPACE + _SPACE.join(f"({_KINDS[k]})" if k != "mark" else "(" + re.escape(t) + ")" for k, _, _, t in words)).match
        starts, ends = {w[1]: k for k, w in enumerate(words)}, {w[2]: k for k, w in enumerate(words)}
        named = [k for k, w in enumerate(words) if w[0] == "name"]
        self.names = itemgetter(*named) if len(named) > 1 else lambda groups, k=named[0]: (groups[k],)
        self.nodes: list[tuple] = []
        self.consts: list[str | None] = [None]
        at = len(words)

        def word(n: Node, text: str | None) -> int:
            """The word that gives a text; the ones that never change come after all words."""
            if text is None:
                return at
            if n.kind in ("Assignment", "VarRef", "FuncCall", "Literal"):
                return starts[n.start]
            self.consts.append(text)
            return at + len(self.consts) - 1

        def visit(n: Node, depth: int, ordinal: int, parent: int) -> Node:
            me = len(self.nodes)
            self.nodes.append(())
            own = {"own_end": ends[n.kids[1].end]} if n.kind == "BinOp" else None
            slots = Node("VarRef", n.role, name=f"\0{starts[n.start]}\0", state=None) if n.kind in ("VarRef", "Literal") else Node(n.kind, n.role, n.name if n.kind == "BinOp" else f"\0{starts[n.start]}\0", **n.props)
            for k, kid in enumerate(n.kids):
                slots.kids.append(visit(kid, depth + 1, k, me))
            self.nodes[me] = n.kind, n.role, depth, ordinal, parent, len(self.nodes) - 1, word(n, n.name), word(n, n.literal), starts[n.start], ends[n.end], own["own_end"] if own else dict(n.props)
            return slots

        parts = render.expression(visit(node, 0, -1, -1)).split("\0")
        read = {"integer": lambda t: str(int(t)), "real": lambda t: str(float(t)), "name": str}
        self.shown = [(parts[k], int(parts[k + 1]), read[words[int(parts[k + 1])][0]]) for k in range(0, len(parts) - 1, 2)]
        self.tail = parts[-1]
        self.consts = tuple(self.consts)
        self.picks: dict = {}

    def rendered(self, m: re.Match) -> str:
        """What render.published() gives of the assignment."""
        return "".join([x for text, k, read in self.shown for x in (text, read(m[k + 1]))]) + self.tail

    def picked(self, kinds: frozenset[str] | None) -> list[int]:
        """Nodes of these kinds."""
        if kinds not in self.picks:
            self.picks[kinds] = [k for k, n in enumerate(self.nodes) if kinds is None or n[0] in kinds]
        return self.picks[kinds]


class Flat(Node):
    """An assignment of a shape; its nodes are made when they are first asked for."""

    __slots__ = ("shape", "found", "made")
    kind = "Assignment"
    literal = None

    def __init__(self, shape: Shape, found: re.Match, role: str):
        self.shape, self.found, self.role, self.made = shape, found, role, None

    @property
    def name(self) -> str:
        return self.found[1]

    @property
    def start(self) -> int:
        return self.found.start(1)

    @property
    def end(self) -> int:
        return self._all()[0].end

    @property
    def props(self) -> dict:
        return self._all()[0].props

    @property
    def kids(self) -> list[Node]:
        return self._all()[0].kids

    def _all(self) -> list[Node]:
        if self.made is None:
            m, self.made = self.found, []
            texts = m.groups() + self.shape.consts
            for kind, role, _, _, parent, _, name, literal, start, end, props in self.shape.nodes:
                n = Node(kind, role, texts[name], texts[literal], m.start(start + 1), m.end(end + 1), **(props if isinstance(props, dict) else {}))
                if parent >= 0:
                    self.made[parent].kids.append(n)
                self.made.append(n)
        return self.made


def words_of(text: str) -> list[tuple[str, int, int, str]] | None:
    """Kind, start, end and text of the words of an assignment up to its semicolon; None if it holds anything else, a sign before an operand, or a mark of a comment."""
    out: list[tuple[str, int, int, str]] = []
    at = 0
    while at < len(text):
        m = _WORD.match(text, at)
        if m is None or len(out) == MOST or (m.lastgroup == "name" and m["name"] in KEYWORDS):
            return None
        kind, (start, at) = m.lastgroup, m.span(m.lastgroup)
        if m["mark"] in ("+", "-") and not (out and (out[-1][0] != "mark" or out[-1][3] == ")")):
            return None
        out.append((kind, start, at, text[start:at]))
    return out if "(*" not in text and "*)" not in text else None


@cache
def _known() -> dict[tuple, Shape]:
    return {}


def learned(text: str, start: int, end: int, node: Node) -> Shape | None:
    """The shape of an assignment that was read from text[start:end], its semicolon included; None if it has none."""
    words = words_of(text[start:end])
    if words is None:
        return None
    key = tuple(w[3] if w[0] == "mark" else w[0] for w in words)
    known = _known()
    if key not in known:
        if len(known) >= 1000:
            known.clear()
        known[key] = Shape([(k, start + a, start + b, t) for k, a, b, t in words], node)
    return known[key]

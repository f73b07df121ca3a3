"""The nodes of a program's tree."""

from __future__ import annotations

from collections.abc import Iterator


class Node:
    __slots__ = ("kind", "role", "name", "literal", "start", "end", "props", "kids")

    def __init__(self, kind: str, role: str = "", name: str | None = None, literal: str | None = None, start: int = 0, end: int = 0, **props):
        self.kind, self.role, self.name, self.literal, self.start, self.end, self.props, self.kids = kind, role, name, literal, start, end, props, []

    def add(self, node: Node | None, role: str | None = None) -> Node | None:
        if node is not None:
            if role is not None:
                node.role = role
            self.kids.append(node)
        return node

    def of(self, role: str) -> list[Node]:
        return [k for k in self.kids if k.role == role]

    def walk(self) -> Iterator[Node]:
        yield self
        for k in self.kids:
            yield from k.walk()

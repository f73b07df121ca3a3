"""Positions of a normalized text in its original.

A map is a table of pieces: runs of characters that stand next to each other in both
texts, and runs that were made up. Its size is that of the changes, not of the text, and
every question is a binary search.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np

GENERATED = -1


def line_starts(text: str) -> np.ndarray:
    """Offsets at which lines start; only LF ends a line."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate([[0], np.flatnonzero(points == 10) + 1])


class Pieces:
    """Runs of a text: where each starts, and the original offset of its first character or GENERATED."""

    __slots__ = ("places", "offsets", "size")

    def __init__(self, runs: Iterable[tuple[int, int]] = ()):
        """runs: (length, offset) in order; neighbours that go on from each other become one."""
        self.places: list[int] = []
        self.offsets: list[int] = []
        self.size = 0
        for length, offset in runs:
            self.add(length, offset)

    def add(self, length: int, offset: int) -> None:
        if length <= 0:
            return
        if self.places:
            last = self.offsets[-1]
            goes_on = last + self.size - self.places[-1] if last >= 0 else GENERATED
            if goes_on == offset:
                self.size += length
                return
        self.places.append(self.size)
        self.offsets.append(offset)
        self.size += length

    def at(self, place: int) -> int:
        """The original offset of a character, or GENERATED."""
        k = bisect_right(self.places, place) - 1
        return self.offsets[k] + place - self.places[k] if self.offsets[k] >= 0 else GENERATED

    def between(self, start: int, end: int) -> Iterator[tuple[int, int]]:
        """The runs of a stretch."""
        k = bisect_right(self.places, start) - 1
        while start < end:
            stop = min(end, self.places[k + 1] if k + 1 < len(self.places) else self.size)
            yield stop - start, self.offsets[k] + start - self.places[k] if self.offsets[k] >= 0 else GENERATED
            start, k = stop, k + 1

    def spread(self) -> np.ndarray:
        """An offset for each character."""
        lengths = np.diff([*self.places, self.size])
        first = np.repeat(np.array(self.offsets, np.int64), lengths)
        inside = np.arange(self.size) - np.repeat(np.array(self.places, np.int64), lengths)
        return np.where(first >= 0, first + inside, GENERATED)


class SourceMap:
    def __init__(self, original: str, normalized: str, offsets: Pieces | Iterable[int] | Callable[[], Pieces] | None = None):
        """offsets: pieces, or what makes them when first asked for, or an offset for each character; None where the texts are the same."""
        self.original, self.normalized = original, normalized
        self.identity = offsets is None
        if callable(offsets):
            self._make = offsets
        elif offsets is not None:
            self._hold(offsets if isinstance(offsets, Pieces) else Pieces((1, int(x)) for x in offsets))

    def __getattr__(self, name: str):
        """Tables that are made when first asked for."""
        if name == "starts":
            self.starts = line_starts(self.original).tolist()
        elif name in ("pieces", "before", "after", "last", "final") and "_make" in self.__dict__:
            self._hold(self.__dict__.pop("_make")())
        else:
            raise AttributeError(name)
        return self.__dict__[name]

    def _hold(self, pieces: Pieces) -> None:
        self.pieces = pieces
        if pieces.size != len(self.normalized):
            raise ValueError("the map and the normalized text differ in length")
        n = len(pieces.places)
        ends = [*pieces.places[1:], pieces.size]
        #: Of each piece the original offset of the last real character before it, of the first at or after it, and the end of the last real piece before it.
        self.before, self.after, self.last = [-1] * n, [-1] * (n + 1), [-1] * n
        seen = place = -1
        for k in range(n):
            self.before[k], self.last[k] = seen, place
            if pieces.offsets[k] >= 0:
                seen, place = pieces.offsets[k] + ends[k] - pieces.places[k] - 1, ends[k]
        self.final = seen
        for k in range(n - 1, -1, -1):
            self.after[k] = pieces.offsets[k] if pieces.offsets[k] >= 0 else self.after[k + 1]

    @property
    def offsets(self) -> np.ndarray:
        return self.pieces.spread()

    def _piece(self, at: int) -> int:
        return bisect_right(self.pieces.places, at) - 1

    def _anchor(self, at: int) -> int:
        """The original offset of a character or, if it was made up, of the last real one before it, else -1."""
        k = self._piece(at)
        first = self.pieces.offsets[k]
        return first + at - self.pieces.places[k] if first >= 0 else self.before[k]

    def position(self, at: int) -> int | None:
        """The original offset of a normalized one: of a made-up character, that of the last real one before it; past the end, one after the last real one."""
        if at < 0:
            return None
        if self.identity:
            return min(at, len(self.original))
        return self.final + 1 if at >= self.pieces.size else max(0, self._anchor(at))

    def range(self, start: int, end: int) -> tuple[int, int]:
        """The smallest original range over the real characters of a normalized one; an empty range has no width."""
        if start >= end:
            at = self.position(start) or 0
            return at, at
        first = self.position(start) or 0
        if self.identity:
            return first, min(end, len(self.original))
        if inside := min(end, self.pieces.size):
            k = self._piece(inside - 1)
            if self.pieces.offsets[k] >= 0 or self.last[k] > start:  # a real character lies between
                if inside > start:
                    return first, self._anchor(inside - 1) + 1
        if end < self.pieces.size:
            k = self._piece(end)
            if self.pieces.offsets[k] >= 0:
                return first, self.pieces.offsets[k] + end - self.pieces.places[k] + 1
            if self.after[k] >= 0:
                return first, self.after[k] + 1
        return first, len(self.original)

    def node(self, start: int, end: int) -> tuple[int, int]:
        """A node's range: its last character's position and one, so a node that ends in made-up text ends at its anchor."""
        first = self.position(start) or 0
        return (first, first) if end <= start else (first, (self.position(end - 1) or 0) + 1)

    def spans(self, n) -> tuple[int, int, int, int]:
        """A node's start, end, line and column in the original."""
        start, end = self.node(n.start, n.end)
        return (start, end, *self.line_col(start))

    def line_col(self, at: int) -> tuple[int, int]:
        """1-based line and column of an original offset, held within the text."""
        at = min(max(at, 0), len(self.original))
        line = bisect_right(self.starts, at)
        return line, at - self.starts[line - 1] + 1

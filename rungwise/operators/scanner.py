"""Lexical rules: a cursor over program text that reads one expected thing at a time.

Keywords are reserved only where the grammar can take them, so the parser asks
for the words it can take at a place and the cursor answers; there is no token
list made beforehand.
"""

from __future__ import annotations

import re

import regex

from rungwise.functions.limits import BudgetFault


class SyntaxFault(Exception):
    """The text is no program. offset is in the normalized text; expected lists what could have stood there."""

    def __init__(self, offset: int, expected: set[str], found: str):
        self.offset, self.expected, self.found = offset, sorted(expected), found
        shown = ", ".join(self.expected[:12]) + (", ..." if len(self.expected) > 12 else "")
        super().__init__(f"unexpected {found}; expected {shown}")


# The lexical patterns of the language.
SPACE = re.compile(r"[ \t\f\r\n]*")
NAME = regex.compile(
    r"'[^']{1,20}'|(?!(?:IF|THEN|ELSE|ELSIF|ENDIF|AND|OR|NOT|True|False)(?![\p{L}\p{Nl}\p{M}\p{Nd}_'�]))"
    r"[\p{L}\p{Nl}_�][\p{L}\p{Nl}\p{M}\p{Nd}_'�]{0,19}(?![\p{L}\p{Nl}\p{M}\p{Nd}_'�])"
)
INT = re.compile(r"[+-]?\d+")
REAL = re.compile(r"[+-]?(?:\d+\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)")
BOOL = re.compile(r"(?:True|False)\b")
STRING = re.compile(r'"(?:[^\n"]|"")*"')
OPEN_STRING = re.compile(r'"(?:[^\n"]|"")*\n')
DIGITS = re.compile(r"\d+")
STATE = re.compile(r":\s*(New|Old)\b")
#: Words that end only where a word ends; all other keywords may run into what follows.
WHOLE = frozenset("IF THEN ELSE ELSIF ENDIF AND OR NOT Enable_".split())
#: Words that may stand at a place and yet not be seen there.
OPEN = WHOLE | {"("}
_EDGE = re.compile(r"\(\*|\*\)")


class Cursor:
    def __init__(self, text: str, budget: int | None = None):
        self.text, self.at = text, 0
        self.budget, self.steps = budget, 0  # a step for each place that is looked at, again after going back
        self.solid = -1  # where no white space stands, as was last found
        self.ended = 0  # where the last thing read ended
        self.far, self.wanted = 0, set()

    # where things are

    def here(self) -> int:
        at = self.at
        if at != self.solid:
            self.steps += 1
            if self.budget is not None and self.steps > self.budget:
                raise BudgetFault(self.budget)
            if self.text[at : at + 1] in " \t\f\r\n":
                self.at = at = SPACE.match(self.text, at).end()
            self.solid = at
        return at

    def miss(self, what: str) -> None:
        if self.at == self.far:
            self.wanted.add(what)
        elif self.at > self.far:
            self.far, self.wanted = self.at, {what}

    def misses(self, words: tuple[str, ...]) -> None:
        if self.at == self.far:
            self.wanted.update(words)
        elif self.at > self.far:
            self.far, self.wanted = self.at, set(words)

    def fault(self, *what: str) -> SyntaxFault:
        at = self.here()
        for w in what:
            self.miss(w)
        self.far = max(self.far, at)
        if self.far < len(self.text):
            word = NAME.match(self.text, self.far) or REAL.match(self.text, self.far) or INT.match(self.text, self.far)
            found = repr(word[0] if word else self.text[self.far])
        else:
            found = "the end of the text"
        return SyntaxFault(self.far, self.wanted or {"something else"}, found)

    # words and marks

    def sees(self, word: str) -> bool:
        at = self.at if self.at == self.solid else self.here()
        if not self.text.startswith(word, at):
            return False
        if word in WHOLE:
            after = self.text[at + len(word) : at + len(word) + 1]
            return not (after == "_" or after.isalnum())
        return not (word == "(" and self.text.startswith("(*", at))

    def sees_any(self, words: tuple[str, ...]) -> str | None:
        at = self.at if self.at == self.solid else self.here()
        if not self.text.startswith(words, at):
            return None
        return next((w for w in words if self.sees(w)), None)

    def take(self, word: str) -> bool:
        at = self.at if self.at == self.solid else self.here()
        if self.text.startswith(word, at) and (word not in OPEN or self.sees(word)):
            self.at = self.ended = at + len(word)
            return True
        if at == self.far:
            self.wanted.add(word)
        elif at > self.far:
            self.far, self.wanted = at, {word}
        return False

    def take_any(self, words: tuple[str, ...]) -> str | None:
        """The first of the words that can be taken; all are looked for at once where none stands."""
        at = self.at if self.at == self.solid else self.here()
        if self.text.startswith(words, at):
            for w in words:
                if self.take(w):
                    return w
            return None
        self.misses(words)
        return None

    def need(self, *words: str) -> str:
        for w in words:
            if self.take(w):
                return w
        raise self.fault(*words)

    # literals and names

    def read(self, pattern, what: str):
        m = pattern.match(self.text, self.at if self.at == self.solid else self.here())
        if not m:
            self.miss(what)
            return None
        self.at = self.ended = m.end()
        return m

    def must(self, pattern, what: str):
        m = self.read(pattern, what)
        if not m:
            raise self.fault(what)
        return m

    def name(self) -> str:
        return self.must(NAME, "NAME")[0]

    def real(self) -> float:
        return float(self.must(REAL, "REAL")[0])

    def comment(self) -> tuple[int, int] | None:
        """A comment, which may hold others, or None if none stands here."""
        start = self.at if self.at == self.solid else self.here()
        if not self.text.startswith("(*", start):
            return None
        depth, at = 1, start + 2
        while depth:
            m = _EDGE.search(self.text, at)
            if not m:
                self.at = len(self.text)
                raise self.fault("*)")
            depth += 1 if m[0] == "(*" else -1
            at = m.end()
        self.at = self.ended = at
        return start, at

    def opens_module_type(self) -> bool:
        """Whether a name here is the head of a module type: only comments stand between it, `=`, perhaps PRIVATE_, and MODULEDEFINITION."""
        back = self.at
        try:
            m = NAME.match(self.text, self.here())
            if not m:
                return False
            self.at = m.end()
            self.comments()
            if not self.text.startswith("=", self.here()):
                return False
            self.at += 1
            self.comments()
            if self.text.startswith("PRIVATE_", self.at):
                self.at += len("PRIVATE_")
                self.comments()
            end = self.at + len("MODULEDEFINITION")
            return self.text.startswith("MODULEDEFINITION", self.at) and self.text[end : end + 1] in ("", " ", "\t", "\f", "\r", "\n")
        except SyntaxFault:
            return False
        finally:
            self.at = back

    def comments(self) -> None:
        while self.comment():
            pass
        self.here()


def unquoted(literal: str) -> str:
    """The text a string literal stands for; an unclosed one ends before its line feed."""
    body = literal.rstrip("\n")
    return body[1 : -1 if len(body) > 1 and body.endswith('"') and literal == body else None].replace('""', '"')

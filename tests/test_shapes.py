"""Assignments read by their shape against the same ones read word by word."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rungwise.functions.markers import compress
from rungwise.operators import parser, shapes
from rungwise.operators.scanner import SyntaxFault
from rungwise.operators.stage import parse_columns, parse_source

from tests.test_parser import code

WORDS = ["A", "b_1", "True", "Truth", "IF", "IFX", "NOT", "SEQUENCE1", "ENDDEF", "a'b", "Ünit", "x" * 21, "1", "007", "2.5", "1e3", "2.50E-7", "1.", "+", "-", "*", "/", "(", ")", "(*", "*)", "(* c *)", '"s"', ",", ".", ":New", "=", "==", "AND", ";"]
FLAT = st.tuples(st.sampled_from(["A", "b_1", "Wide"]), st.recursive(st.sampled_from(["A", "F(b)", "1", "2.5", "-3", "1e3", "- 4"]), lambda e: st.one_of(st.tuples(e, st.sampled_from([" + ", "-", " * ", "/", " -"]), e).map("".join), e.map("({})".format), e.map("( {} )".format)), max_leaves=5)).map(" = ".join)
TEXT = st.lists(st.one_of(FLAT, FLAT, st.lists(st.sampled_from(WORDS), min_size=3, max_size=8).map(" ".join), st.sampled_from(["IF A THEN B = 1; ELSE C = 2; ENDIF", "(* c *)", "F(1)"])), min_size=1, max_size=6).map(lambda x: ";\n".join([y for s in x for y in (s, s)]) + ";")


def outcome(text, **how):
    return parse_source("s", text, **how)


def slowly(text, **how):
    before = parser.learned
    parser.learned, parser.Parser.shapes = lambda *_: None, ()
    try:
        return parse_source("s", text, **how)
    finally:
        parser.learned = before


@given(TEXT)
@settings(max_examples=1500, deadline=None)
def test_rows_are_those_of_a_descent(text):
    assert outcome(code(text)) == slowly(code(text))


@pytest.mark.parametrize("kinds", [None, frozenset({"Assignment"}), frozenset({"VarRef", "Literal"}), frozenset({"BinOp"}), frozenset({"Comment"})])
@pytest.mark.parametrize("form", [str, compress])
def test_kinds_columns_and_forms(kinds, form):
    text = form(code("".join(f"A{i} = B * (1.5 - {i}) / F(c);\n" for i in range(9)) + "IF A THEN B = 1; C = 2; ELSE D = 3; ENDIF;\nE = 4;" * 3))
    whole = slowly(text, kinds=kinds)
    assert outcome(text, kinds=kinds) == whole and outcome(text, kinds=kinds, rendered=False) == slowly(text, kinds=kinds, rendered=False)
    some = parse_columns("s", text, kinds=kinds, wanted=("node_id", "kind", "props"))
    assert list(zip(*some.values(), strict=True)) == [(r[1], r[7], r[15]) for r in whole]


def test_nodes_and_faults_are_those_of_a_descent(monkeypatch):
    text = code("".join(f"A{i} = 1 + {i};\n" for i in range(5)) + "A = ;")
    good = text.replace("A = ;", "")
    monkeypatch.setattr(parser.Parser, "shapes", ())
    with pytest.raises(SyntaxFault) as quick:
        parser.parse(text)
    tree = parser.parse(good)
    seen = [(n.kind, n.role, n.name, n.literal, n.start, n.end, n.props) for n in tree.walk()]
    assert sum(isinstance(n, shapes.Flat) for n in tree.walk()) == 5
    monkeypatch.setattr(parser, "learned", lambda *_: None)
    monkeypatch.setattr(parser.Parser, "shapes", ())
    assert seen == [(n.kind, n.role, n.name, n.literal, n.start, n.end, n.props) for n in parser.parse(good).walk()]
    with pytest.raises(SyntaxFault) as slow:
        parser.parse(text)
    assert (quick.value.offset, quick.value.expected, str(quick.value)) == (slow.value.offset, slow.value.expected, str(slow.value))


def test_most_assignments_of_lineitem_take_no_descent(monkeypatch):
    calls = []
    monkeypatch.setattr(parser.Parser, "sums", lambda self, real=parser.Parser.sums: calls.append(1) or real(self))
    rows = outcome(code("".join(f"L{i} = {i}.25 * (1 - 0.0{i % 9});\n" for i in range(200))), kinds=frozenset({"Assignment"}))
    assert len(rows) == 200 and len(calls) < 10 and all(re.fullmatch(r"L\d+ = \([\d.]+ \* \(1 - [\d.]+\)\)", r[16]) for r in rows)


def test_shapes_outlast_a_text_but_not_a_budget(monkeypatch):
    outcome(code("A = 1;"))
    calls = []
    monkeypatch.setattr(parser.Parser, "sums", lambda self, real=parser.Parser.sums: calls.append(1) or real(self))
    assert outcome(code("B = 27;")) and not calls
    assert outcome(code("B = 27;"), budget=10_000) == outcome(code("B = 27;")) and calls

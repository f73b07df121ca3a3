"""Tables of pieces against a model with an offset for each character."""

import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from rungwise.functions import markers
from rungwise.functions.coded import FormatError
from rungwise.functions.provenance import GENERATED, Pieces, SourceMap

MAP = st.lists(st.one_of(st.just(GENERATED), st.integers(0, 30)), max_size=25)


@given(MAP)
@settings(max_examples=300, deadline=None)
def test_pieces_hold_every_offset(offsets):
    p = Pieces((1, x) for x in offsets)
    assert p.spread().tolist() == offsets and [p.at(k) for k in range(len(offsets))] == offsets
    for a in range(len(offsets)):
        for b in range(a, len(offsets) + 1):
            assert [o + k if o >= 0 else o for n, o in p.between(a, b) for k in range(n)] == offsets[a:b]


@given(MAP, st.integers(0, 27), st.integers(0, 27))
@settings(max_examples=500, deadline=None)
def test_positions_by_definition(offsets, a, b):
    s = SourceMap("x" * 31, "y" * len(offsets), offsets)
    real = [(k, o) for k, o in enumerate(offsets) if o >= 0]

    def position(at):
        before = [o for k, o in real if k <= at]
        if at >= len(offsets):
            return real[-1][1] + 1 if real else 0
        return before[-1] if before else 0

    assert s.position(a) == position(a)
    start, end = min(a, b), max(a, b)
    inside = [o for k, o in real if start <= k < end]
    after = [o for k, o in real if k >= end]
    want = position(start) if start == end else inside[-1] + 1 if inside else after[0] + 1 if after else 31
    assert s.range(start, end) == (position(start), want)
    assert s.node(start, end) == (position(start), position(start) if start == end else position(end - 1) + 1)


def test_memory_is_that_of_the_edits():
    text = 'ModuleCode "a string" ' + "word " * 20_000 + "ENDIF" + " word" * 20_000
    source, used = markers.expand(text)
    assert used == ["endif_no_terminator"] and len(source.pieces.places) == 3 and source.normalized == text.replace("ENDIF", "ENDIF;")


def test_rewrites_keep_what_they_keep():
    r = random.Random(1)
    for _ in range(200):
        text = "".join(r.choice(["ab", " ", '"s ""x"" "', "(* c (* d *) *)", "", "", "q"]) for _ in range(r.randrange(12)))
        draft = markers.Draft(text)
        draft.rewrite(re.compile("a"), lambda m: "_a_")
        draft.rewrite(re.compile("q"), lambda m: "")
        draft.finish()
        want = "".join(x if x[0] in '"(' else x.replace("a", "_a_").replace("q", "") for x in re.split(r'("(?:[^"]|"")*"|\(\* c \(\* d \*\) \*\))', text) if x)
        assert draft.text == want
        offsets = draft.pieces.spread().tolist()
        assert len(offsets) == len(want) and all(o == GENERATED or text[o] == c for o, c in zip(offsets, want, strict=True))
        assert [o for o in offsets if o >= 0] == [k for k, c in enumerate(text) if c != "q"]


def test_blocks_cost_linear_time():
    def took(n):
        text = 'ModuleCode ' + 'EQUATIONBLOCK E COORD 0.0 A = "x"; (* c *) ENDDEF ' * n
        began = time.process_time()
        markers.expand(text)
        return time.process_time() - began

    took(10)
    assert took(8000) < 20 * took(1000) + 0.3


def test_pieces_are_made_for_who_asks(monkeypatch):
    made = []
    monkeypatch.setattr(markers, "Pieces", lambda *a, real=markers.Pieces: made.append(1) or real(*a))
    text = 'A #81 1 #85 ;\n"s" (* c *) B #8; "2s"; duration := "5s"; F(x, ) ENDIF A'
    source, used = markers.expand(text)
    assert source.normalized and used and not made
    assert source.position(len(source.normalized) - 1) == len(text) - 1 and made
    draft, again = markers._expanded(text, markers.MARKERS)
    assert (draft.text, again) == (source.normalized, used)


@given(st.lists(st.sampled_from(['"', '""', "(*", "*)", "#81 ", "#85 ;", ":= ;", "; :=", "ENDIF ", "ENDIF; )", 'time := "x"', '=> "2025-10-11-12:13:14.150"', "F(x, )", "integer enddef", "EQUATIONBLOCK ", "ModuleCode ", "\n", "é", "#zz ", "#01Ab ", "#0<3 "]), max_size=12).map("".join))
@settings(max_examples=500, deadline=None)
def test_expansion_is_the_same_with_and_without_pieces(text):
    outcomes = []
    for tracked in (True, False):
        try:
            draft, used = markers._expanded(text, markers.MARKERS, tracked)
            outcomes.append((draft.text, used))
        except FormatError as fault:
            outcomes.append(str(fault))
    assert all(x == outcomes[0] for x in outcomes)

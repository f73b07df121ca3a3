"""Wire formats and positions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rungwise.functions import coded, markers
from rungwise.functions.coded import FormatError
from rungwise.functions.provenance import GENERATED, SourceMap
from rungwise.plans import positions


@given(st.text(st.characters(min_codepoint=1, max_codepoint=127, exclude_characters="\r"), max_size=500))
@settings(max_examples=60, deadline=None)
def test_coded_round_trip(text):
    assert coded.decode(coded.encode(text)) == text


def test_coded_framing_faults():
    data = coded.encode("hello")
    for bad in (b"x" + data, data + b"z", data[:-1] + b"z"):
        with pytest.raises(FormatError):
            coded.decode(bad)
    assert coded.decode(coded.MARK + b"\r\n") == ""


def test_coded_drops_what_follows_the_last_carriage_return():
    assert coded.decode(coded.encode("a\rb")) == "a\rb"
    stream = coded.encode("one")
    assert "\r" not in coded.decode(stream)


@pytest.mark.parametrize(
    ("raw", "text"),
    [
        ("A := ;", "A := Default;"),
        ("A := Max(b, )", "A := Max(b, 0)"),
        ("EQUATIONBLOCK E", "ModuleCode EQUATIONBLOCK E"),
        ("ModuleCode EQUATIONBLOCK E", "ModuleCode EQUATIONBLOCK E"),
        ('Duration OpSave := "2s";', 'Duration OpSave := Duration_Value "2s";'),
        ('time := "now"', 'time := Time_Value "now"'),
        ('p => "2025-10-11-12:13:14.150"', 'p => Time_Value "2025-10-11-12:13:14.150"'),
        ('p => "2025"', 'p => "2025"'),
        ("ENDDEF ;", "ENDDEF"),
        ("A; := 2", "A := 2"),
        ("ENDIF; )", "ENDIF)"),
        ("ENDIF", "ENDIF;"),
        ("real ENDDEF", "real ; ENDDEF"),
        ("Enable_ = T : OutVar_ x", "Enable_ = T : InVar_ x"),
        ("b := TrueVar", "b := TTrueVar"),
        ("#01Last", "(Last"),
        ("a #0< b #0<c", "a * b * c"),
        ('#71 "#71" (* #71 (* #72 *) *)', 'MODULEDEFINITION "#71" (* #71 (* #72 *) *)'),
    ],
)
def test_expansion(raw, text):
    source, _ = markers.expand(raw)
    assert source.normalized == text
    for k, at in enumerate(source.offsets):
        assert at == GENERATED or source.normalized[k] in raw


def test_unknown_markers_are_refused():
    with pytest.raises(FormatError):
        markers.expand("#16Stop")


def test_detection():
    assert not markers.is_compressed("plain text, no marks")
    assert not markers.is_compressed('"' + "#71 " * 90 + '"')
    assert not markers.is_compressed("(* " + "#71 " * 90 + "*)")
    assert markers.is_compressed("#01X " * 10)
    assert not markers.is_compressed("#01X " + "word " * 500)


def test_positions():
    s = SourceMap("abcdef", "aXbcYf", [0, GENERATED, 1, 2, GENERATED, 5])
    assert [s.position(k) for k in range(-1, 8)] == [None, 0, 0, 1, 2, 2, 5, 6, 6]
    assert s.range(0, 6) == (0, 6)
    assert s.range(1, 2) == (0, 2)  # made-up text only: up to the next real character
    assert s.range(3, 3) == (2, 2)
    assert s.node(3, 5) == (2, 3)
    plain = SourceMap("a\nbc\n", "a\nbc\n")
    assert [plain.line_col(k) for k in (0, 1, 2, 4, 5, 99, -3)] == [(1, 1), (1, 2), (2, 1), (2, 3), (3, 1), (3, 1), (1, 1)]


def test_compressing_and_expanding_gives_the_same_words():
    text = 'SUBMODULES A Invocation ( 0.0 ) : MODULEDEFINITION (* SUBMODULES *) "ModuleDef" ENDDEF (*x*);'
    source, _ = markers.expand(markers.compress(text))
    assert source.normalized.split() == text.split()


def test_what_is_kept_keeps_its_place():
    for new, old, want in (("TTrueVar", "TrueVar", [0, -1, 1, 2, 3, 4, 5, 6]), ("(Last", "#01Last", [-1, 3, 4, 5, 6]), ("a b c", "a x b y c", [0, 1, 4, 7, 8]), ("", "abc", []), ("abc", "", [-1, -1, -1])):
        assert markers.aligned(new, old, list(range(len(old)))) == want


def test_lines_of_long_texts(spark):
    texts = ["", "a\n", "\n\nb", "x" * 10 + "\n" + "line\n" * 20_000, None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(1, "twice\n")], "k long, text string")
    got = {}
    for r in positions.lines(df, "k").collect():
        got.setdefault(r.k, []).append((r.line, r.start, r.length))
    for k, t in enumerate(texts):
        want, at = [], 0
        for n, line in enumerate((t or "").split("\n"), 1):
            want.append((n, at, len(line)))
            at += len(line) + 1
        assert sorted(got[k])[: len(want)] == want or k == 1
    where = positions.line_of(spark.createDataFrame([(3, 0), (3, 11), (3, 50_000), (2, 2)], "k long, at int"), df, "k").collect()
    assert {(r.k, r.at, r.line, r.col) for r in where} == {(3, 0, 1, 1), (3, 11, 2, 1), (3, 50_000, 9999, 5), (2, 2, 3, 1)}


def test_folded_names_meet(spark):
    from rungwise.operators.stage import parse_sources
    from rungwise.plans import roundtrip as rt
    from rungwise.plans import views

    text = rt.HEAD + "T" + rt.ROOT + "TYPEDEFINITIONS\nGRÖSSE = MODULEDEFINITION DateCode_ 1\n" + rt.LAYOUT + "ENDDEF;\nLOCALVARIABLES\nMaß: integer Const;\nSUBMODULES\nI" + rt.INVOKE + "Größe;\n" + rt.LAYOUT + "ModuleCode\nEQUATIONBLOCK E" + rt.PLACE + ":\nMASS = 1;\n" + rt.END
    nodes = parse_sources(spark.createDataFrame([("s", text)], "source_id string, content string"))
    assert [r.type_node_id is not None for r in views.resolved_instances(nodes).collect()] == [True]
    assert [r.name for r in views.constant_writes(nodes).collect()] == ["MASS"]


def test_trunc_goes_towards_zero(spark):
    from rungwise.plans.compiled import column

    assert [r.x for r in spark.createDataFrame([(-1.5,), (1.5,), (0.0,)], "v double").select(column("trunc(v)").alias("x")).collect()] == [-1, 1, 0]

"""The parser and the node rows it gives."""

import json
import re

import pytest

from rungwise.functions import render
from rungwise.functions.markers import compress
from rungwise.functions.provenance import SourceMap
from rungwise.operators import parser
from rungwise.operators.parser import parse, program_name
from rungwise.operators.scanner import SyntaxFault
from rungwise.operators.stage import _NAMES, parse_source
from rungwise.plans.compiled import expression
from rungwise.plans.roundtrip import END, HEAD, LAYOUT, PLACE, ROOT


def program(sections="", layout=LAYOUT, code=""):
    return HEAD + "Test" + ROOT + sections + layout + code + END


def code(body):
    return program(code="ModuleCode\nEQUATIONBLOCK Main" + PLACE + ":\n" + body)


def rows(text):
    names = "source_id node_id subtree_end parent_id depth ordinal role kind name name_key literal start end line col props rendered".split()
    return [dict(zip(names, r, strict=True)) for r in parse_source("s", text)]


def of(text, *kinds):
    return [r for r in rows(text) if r["kind"] in kinds]


def test_smallest_program():
    tree = parse(program())
    assert tree.name == "Test" and tree.kids[0].kind == "BasePicture"
    assert tree.kids[0].of("layout")[0].props["clipping_bounds"] == [[-1.0, -1.0], [1.0, 1.0]]


def test_numbering_is_pre_order_and_every_span_is_the_original_text():
    text = code('IF A == 1 THEN B = "x""y"; ELSE Call(C:Old, -2); ENDIF;')
    got = rows(text)
    assert [r["node_id"] for r in got] == list(range(len(got)))
    for r in got:
        assert r["subtree_end"] >= r["node_id"]
        if r["parent_id"] is not None:
            up = got[r["parent_id"]]
            assert up["node_id"] < r["node_id"] <= up["subtree_end"] and up["start"] <= r["start"] <= r["end"] <= up["end"]
        if r["kind"] == "VarRef":
            assert text[r["start"] : r["end"]].split(":")[0] == r["name"]


def test_variable_groups():
    text = program('LOCALVARIABLES\nA "first", B: GLOBAL integer Const OpSave := 5;\nC: Rec;\n(* c *)\nD: time := Time_Value "t"; E: duration := Duration_Value "1s"; F: boolean := Default;\n')
    got = of(text, "Variable")
    p = [json.loads(r["props"]) for r in got]
    assert [r["name"] for r in got] == list("ABCDEF")
    assert (p[0]["description"], p[1]["description"]) == ("first", None)
    assert p[1]["global"] and p[1]["const"] and p[1]["opsave"] and not p[1]["state"]
    assert [x["init"] for x in p] == ["integer", "integer", "absent", "time", "string", "default"]
    assert got[1]["literal"] == "5" and p[4]["duration"]


def test_unclosed_description_ends_at_the_line_end():
    got = of(program('LOCALVARIABLES\nA "open\n: integer;\n'), "Variable")
    assert json.loads(got[0]["props"])["description"] == "open"


@pytest.mark.parametrize(
    ("text", "shown"),
    [
        ("a + b * c", "(a + (b * c))"),
        ("a - b - c", "((a - b) - c)"),
        ("- a", "-a"),
        ("-1", "-1"),
        ("a -1", "(a - 1)"),
        ("NOT a AND b OR c", "NOT(a) AND \nb OR \nc"),
        ("(a OR b) AND c", "a OR \nb AND \nc"),
        ("a <> 1.50", "a <> 1.5"),
        ('F(x.y:New, "q""r")', "F(x.y:new, 'q\"r')"),
        ("IF a THEN 1 ELSIF b THEN 2 ELSE 3 ENDIF", "IF a\nTHEN\n    1\nELSIF b\nTHEN\n    2\nELSE\n    3\nENDIF"),
        ("ORder + NOTe", "(ORder + NOTe)"),
        ("'quoted name'", "'quoted name'"),
    ],
)
def test_expressions(text, shown):
    assert render.expression(expression(text)) == shown


@pytest.mark.parametrize("text", ["a +", "a < b < c", "F(a,)", "a (* c *) + b", "IF a THEN 1 ENDIF", "Abcdefghijklmnopqrstu", "1 2"])
def test_what_is_no_expression(text):
    with pytest.raises(SyntaxFault):
        expression(text)


def test_chains_share_a_span():
    node = expression("a + b + c")
    assert (node.start, node.end) == (node.kids[0].start, node.kids[0].end) == (0, 9)


def test_comments_by_role():
    text = HEAD + "T" + ROOT.replace("BasePicture ", "BasePicture (* d *) ", 1).replace('"\nBase', '"\n(* change *)\nBase') + LAYOUT + "ModuleCode (* c (* in *) *)\nEQUATIONBLOCK E" + PLACE + ": (* x *); (* y *)\n" + END
    assert [(r["role"], r["literal"]) for r in of(text, "Comment")] == [("change", "(* change *)"), ("description", "(* d *)"), ("code", "(* c (* in *) *)"), ("statement", "(* x *)"), ("statement", "(* y *)"), ("end", "(*BasePicture*)")]


def test_modules_and_mappings():
    text = program(
        "TYPEDEFINITIONS\nR \"d\" = RECORD DateCode_ 3 A, B: real; ENDDEF;\nTYPEDEFINITIONS\nT (* t *) = PRIVATE_ MODULEDEFINITION DateCode_ 2\nMODULEPARAMETERS P: R;\n" + LAYOUT + "ENDDEF;\n"
        "SUBMODULES\nI1 Invocation ( 0.0 , 0.0 : InVar_ x , 0.0 , 1.0 , 1.0 LayerModule Layer_ = 3 Enable_ = False : ( a > 1 ) ) : T ( P => GLOBAL g.h, Q => Duration_Value \"1s\", S => Time_Value );\n"
        "F Invocation ( 0.0 , 0.0 , 0.0 , 1.0 , 1.0 ) : MODULEDEFINITION DateCode_ 1 ( Frame_Module ) ( GroupConn = Scan )\nSUBMODULES I2 Invocation ( 0.0 , 0.0 , 0.0 , 1.0 , 1.0 ) : T;\nENDDEF (*F*);\n"
    )
    tree = parse(text).kids[0]
    assert [(k.kind, k.name) for k in tree.kids if k.role in ("data_type", "module_type", "submodule")] == [("DataType", "R"), ("ModuleTypeDef", "T"), ("ModuleTypeInstance", "I1"), ("FrameModule", "F")]
    first = tree.of("submodule")[0]
    assert first.props["layer"] == 3 and first.props["enable"] is False and first.props["flags"] == ["LayerModule"]
    assert [(m.name, m.props["source"], m.props["global"], m.props["duration"]) for m in first.of("mapping")] == [("P", "variable", True, False), ("Q", "value", False, True), ("S", "time", False, False)]
    assert tree.of("submodule")[1].of("submodule")[0].name == "I2"
    assert "ModuleTypeName" in render.module(tree, SourceMap(text, text).spans)


def test_sequences():
    body = (
        "ModuleCode\nOPENSEQUENCE Main (SeqControl, SeqTimer) COORD 0.0, 0.5 OBJSIZE 1.0, 0.5 Layer_ = 2\nSEQINITSTEP Init ENTERCODE A = 1; EXITCODE B = 2;\nSEQTRANSITION WAIT_FOR (* why *) A > 0\n"
        "ALTERNATIVESEQ SEQTRANSITION T1 WAIT_FOR True SEQSTEP ALTERNATIVEBRANCH SEQTRANSITION T2 WAIT_FOR B SEQFORK Init, Far SEQBREAK ALTERNATIVEBRANCH ENDALTERNATIVE\n"
        "SUBSEQUENCE Sub SEQSTEP In ENDSUBSEQUENCE SUBSEQTRANSITION ST SEQSTEP X ENDSUBSEQTRANSITION PARALLELSEQ SEQSTEP P1 PARALLELBRANCH SEQSTEP P2 ENDPARALLEL\nENDOPENSEQUENCE\n"
    )
    tree = parse(program(code=body))
    s = next(n for n in tree.walk() if n.kind == "Sequence")
    assert s.props["control"] and s.props["timer"] and s.props["layer"] == 2
    assert [n.kind for n in s.of("element")] == ["InitStep", "Transition", "Alternative", "Subsequence", "TransitionSub", "Parallel"]
    assert s.of("element")[2].props["branches"] == 3
    shown = render.chart(s.of("element"))
    assert shown.startswith("InitStep Init\n    Enter:\n        A = 1\n    Exit:\n        B = 2\nTransition WAIT_FOR A > 0\nAlternative:")
    assert "Fork to Init, Far" in shown
    with pytest.raises(SyntaxFault):
        parse(program(code="ModuleCode SEQUENCE" + PLACE + "ALTERNATIVESEQ SEQBREAK ENDALTERNATIVE ENDSEQUENCE\n"))
    with pytest.raises(SyntaxFault):
        parse(program(code="ModuleCode SEQUENCE" + PLACE + "SEQSTEP S EXITCODE A = 1; ENTERCODE B = 2; ENDSEQUENCE\n"))


def test_layout():
    graphics = (
        "Two_Layers_ LayerLimit_ = 0.5 Zoomable Grid = 0.1 ZoomLimits = 0.1 2.0\nGraphObjects : Layer_ = 4\n"
        'TextObject ( 0.0 , 0.0 ) ( 1.0 , 1.0 ) "Lbl" VarName Width_ = 8 : InVar_ w ValueFraction = 2 LeftAligned Enable_ = True : InVar_ "e" OutlineColour : Colour0 = 1 : ( x > 2 ) Colour1 = -3\n'
        "PolygonObject Polyline Connection ( 0.0 , 0.0 ) ( 1.0 : InVar_ q , 1.0 ) Layer_ = 2 FillColour : ColourStyle = True\nSegmentObject ( 0.0 , 0.0 ) ( 1.0 , 1.0 ) ( 2.0 , 2.0 )\nCompositeObject\n"
        "InteractObjects :\nComButProc_ ( 0.0 , 0.0 ) ( 1.0 , 1.0 ) Toggle \"\" : InVar_ LitString \"p\" False 0.0 : InVar_ 0.5 Variable = 0.0\nTextBox_ ( 0.0 , 0.0 ) ( 1.0 , 1.0 ) Int_Value Variable = 0 : OutVar_ \"v\" Abs_\n"
    )
    tree = parse(program(layout=LAYOUT + graphics))
    layout = next(n for n in tree.walk() if n.kind == "ModuleDef")
    assert (layout.props["layer_limit"], layout.props["grid"], layout.props["zoomable"], layout.props["zoom_limits"]) == (0.5, 0.1, True, [0.1, 2.0])
    shapes = layout.of("graph")
    assert [(s.name, s.props["layer"]) for s in shapes] == [("TextObject", 4), ("PolygonObject", 2), ("SegmentObject", 4), ("CompositeObject", 4)]
    assert shapes[0].props["text_vars"] == ["Lbl"] and shapes[1].props["types"] == ["Polyline", "Connection"]
    buttons = layout.of("interact")
    assert buttons[0].of("procedure")[0].name == "Toggle" and buttons[1].props["flags"] == ["Int_Value", "Abs_"]
    with pytest.raises(SyntaxFault):
        parse(program(layout=LAYOUT + "GraphObjects : Layer_ = 1 Layer_ = 2 CompositeObject\n"))


def test_repeated_blocks_stay_in_order():
    block = LAYOUT + "ModuleCode\nEQUATIONBLOCK {}" + PLACE + ": A = 1;\nENDDEF\n"
    tree = parse(HEAD + "T" + ROOT + block.format("Lower") + block.format("Upper"))
    assert [n.name for n in tree.walk() if n.kind == "Equation"] == ["Lower", "Upper"]


def test_program_name():
    assert program_name("Program date: 1, NAME : x ") == "x"
    assert program_name("Program date: 1") is None and program_name("name:") is None


def test_faults_point_into_the_original():
    (error,) = rows(code("A = ;\n"))
    p = json.loads(error["props"])
    assert (error["kind"], p["stage"], error["line"], error["col"]) == ("ParseError", "parse", 9, 5)
    assert p["context"] == "A = ;" and p["caret"] == 4
    (error,) = rows("(* never closed")
    assert json.loads(error["props"])["error_class"] == "SyntaxFault"
    (error,) = rows("#01A " * 20 + "#zz")
    assert json.loads(error["props"])["stage"] == "decode"
    with pytest.raises(SyntaxFault):
        parse_source("s", "nothing", failfast=True)
    assert len(rows(None)) == 1


def test_compressed_program_gives_the_same_tree_and_original_positions():
    text = program("LOCALVARIABLES\nA: integer := 1; B: boolean;\n", code="ModuleCode\nSEQUENCE Main" + PLACE + "\nSEQINITSTEP S0\nENTERCODE A = A + 1;\nSEQTRANSITION T WAIT_FOR True\nENDSEQUENCE\n")
    packed = compress(text)
    plain, other = rows(text), rows(packed)
    assert json.loads(other[0]["props"])["format"] == "compressed"
    keep = ("kind", "role", "name", "literal", "rendered")
    assert [[r[k] for k in keep] for r in plain] == [[r[k] for k in keep] for r in other]
    for r in other:
        if r["kind"] == "VarRef":
            assert packed[r["start"] : r["end"]] == r["name"]


def test_encodings():
    text = code("Åke = 1;")
    assert [r["name"] for r in of(text.encode("cp1252"), "Assignment")] == ["Åke"]
    assert [r["name"] for r in of(text.replace("\n", "\r\n").encode("utf-8"), "Assignment")] == ["Åke"]


def test_deep_brackets_parse():
    text = code("A = " + "(1 + " * 3000 + "2" + ")" * 3000 + ";\n")
    assert len(of(text, "BinOp")) == 3000 and not of(text, "ParseError")


def test_only_some_kinds_leave_the_stage():
    text = code("A = B + 1;\n")
    whole = {r["node_id"]: r for r in rows(text)}
    few = [dict(zip(_NAMES, r, strict=True)) for r in parse_source("s", text, kinds=frozenset({"VarRef"}), rendered=False)]
    assert [r["name"] for r in few] == ["A", "B"] and all(whole[r["node_id"]] | {"rendered": None} == r for r in few)


def test_numbers_read_at_once_are_those_read_one_by_one(monkeypatch):
    plain = code("X = 1;").replace("0.0 , 0.0", "1.5e3,-0.5", 1)
    texts = [plain, *(plain.replace("0.0", x, 1) for x in ("0.0 : InVar_ 2.0", "0.0 (*c*)", "0", "1.", "")), plain.replace("1.0 )", "1.0 Zoomable )", 1), plain.replace("1.0 )", "1.0 : InVar_ 2.0 )", 1), plain.replace("1.0 )", "1.0", 1)]

    def read(text):
        p = parser.Parser(text)
        try:
            return [(n.kind, n.name, n.start, n.end, n.props) for n in p.program().walk()], p.steps
        except SyntaxFault as fault:
            return fault.offset, fault.expected, p.steps

    got = [read(t) for t in texts]
    monkeypatch.setattr(parser, "LISTED", dict.fromkeys(parser.LISTED, re.compile("(?!)")))
    assert got == [read(t) for t in texts]

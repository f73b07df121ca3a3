"""Recursive descent over program text, straight to a tree of plain nodes.

Every choice is settled by the words at the cursor. A node has a kind, the role
it plays in its parent, a name, a literal and further properties; `nodes()`
numbers a tree in pre-order for the relation the engine publishes.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from rungwise.operators.scanner import BOOL, DIGITS, INT, NAME, OPEN_STRING, REAL, SPACE, STATE, STRING, Cursor, SyntaxFault, unquoted
from rungwise.operators.shapes import KEYWORDS, Flat, Shape, learned
from rungwise.operators.tree import Node


# Keywords by the place at which the grammar takes them.
COMPARISONS = ("<>", "<=", ">=", "==", "<", ">")
VALUES = ("boolean", "real", "string", "integer")
MODIFIERS = ("Const", "State", "OpSave", "Secure")
SECTIONS = ("TYPEDEFINITIONS", "MODULEPARAMETERS", "LOCALVARIABLES", "SUBMODULES", "ModuleDef", "ENDDEF")
SEQUENCE_WORDS = (
    "SEQINITSTEP", "SEQSTEP", "SEQTRANSITION", "SUBSEQTRANSITION", "SUBSEQUENCE", "SEQFORK", "SEQBREAK", "ALTERNATIVESEQ", "PARALLELSEQ",
    "ENDSEQUENCE", "ENDOPENSEQUENCE", "ALTERNATIVEBRANCH", "ENDALTERNATIVE", "PARALLELBRANCH", "ENDPARALLEL", "ENDSUBSEQTRANSITION", "ENDSUBSEQUENCE",
)
STEP_WORDS = ("ENTERCODE", "ACTIVECODE", "EXITCODE")
ELEMENTS = {"SEQINITSTEP": "InitStep", "SEQSTEP": "Step", "SEQTRANSITION": "Transition", "SUBSEQTRANSITION": "TransitionSub", "SUBSEQUENCE": "Subsequence", "SEQFORK": "Fork", "SEQBREAK": "Break", "ALTERNATIVESEQ": "Alternative", "PARALLELSEQ": "Parallel"}
ELEMENT_WORDS, AFTER_STEP = SEQUENCE_WORDS[:9], STEP_WORDS + SEQUENCE_WORDS
BLOCK_WORDS = ("EQUATIONBLOCK", "SEQUENCE", "OPENSEQUENCE", "ENDDEF")
SHAPES = ("TextObject", "RectangleObject", "LineObject", "OvalObject", "PolygonObject", "SegmentObject", "CompositeObject")
INTERACTORS = ("ComButProc_", "ComBut_", "OptBut_", "ProcedureInteract", "CheckBox_", "TextBox_", "MenuInteract", "SimpleInteract")
POLYGON_TYPES = ("Polyline", "Spline", "Connection")
COLOURS = {"OutlineColour": "outline", "FillColour": "fill"}
DEFAULT_GRID = 0.2
#: So many numbers with nothing but commas between them, and a bracket after them.
LISTED = {n: re.compile(rf"{SPACE.pattern}{REAL.pattern}(?:{SPACE.pattern},{SPACE.pattern}{REAL.pattern}){{{n - 1}}}(?={SPACE.pattern}\))") for n in (2, 5)}


class Parser(Cursor):
    def done(self, node: Node) -> Node:
        node.end = self.ended
        return node

    def note(self, role: str) -> Node | None:
        if found := self.comment():
            return Node("Comment", role, literal=self.text[found[0] : found[1]], start=found[0], end=found[1])
        return None

    def notes(self, parent: Node, role: str = "discarded") -> None:
        while note := self.note(role):
            parent.add(note)

    def string(self, role: str = "") -> str:
        return unquoted(self.must(STRING, "STRING")[0])

    # program and modules

    def program(self) -> Node:
        node = Node("Program", start=self.here())
        node.props["header"] = [self.string() for _ in range(3)]
        node.add(self.note("change"))
        node.name = program_name(node.props["header"][2])
        root = self.module_head("BasePicture")
        self.need(":")
        self.need("MODULEDEFINITION")
        self.datecode(root)
        root.props["is_frame"] = self.frame()
        self.scan_group(root)
        while self.sees("TYPEDEFINITIONS"):
            back = self.at
            self.take("TYPEDEFINITIONS")
            if self.opens_module_type():
                while self.opens_module_type():
                    self.module_type(root)
                break
            if root.of("data_type"):
                self.at = back
                break
            self.record(root)
            while not self.sees_any(SECTIONS) and self.sees_record():
                self.record(root)
        self.body(root)
        node.add(self.done(root), "root")
        if self.here() < len(self.text):
            raise self.fault("end of text")
        return self.done(node)

    def module_head(self, kind: str) -> Node:
        node = Node(kind, start=self.here(), name=self.name())
        node.add(self.note("description"))
        self.need("Invocation")
        node.add(self.note("description"))
        self.need("(")
        node.props |= {"coords": self.reals(node, 5), "flags": [], "enable": True, "zoomable": False, "zoom_limits": None, "layer": None}
        while not self.take(")"):
            self.argument(node)
        node.props["head_end"] = self.ended
        return node

    def argument(self, node: Node) -> None:
        props = node.props
        if self.take("Zoomable"):
            props["zoomable"] = True
        elif word := next((w for w in ("IgnoreMaxModule", "LayerModule", "SymbolModule", "Non_Zoomable") if self.take(w)), None):
            props["flags"].append(word)
        elif self.sees("Layer_"):
            layer = self.layer()
            props["layer"] = props["layer"] if props["layer"] is not None else layer
        elif self.sees("Enable_"):
            props["enable"] = self.enable(node)
        elif self.sees("ZoomLimits"):
            props["zoom_limits"] = self.zoom_limits()
        elif self.sees("TextObject") or NAME.match(self.text, self.here()):
            self.assignment_line(node, "argument")
        else:
            raise self.fault("NAME", "Enable_")

    def datecode(self, node: Node) -> None:
        self.name()
        node.props["datecode"] = int(self.must(DIGITS, "SL_DATECODE")[0])

    def frame(self) -> bool:
        back = self.at
        if self.take("("):
            if self.take("Frame_Module"):
                self.need(")")
                return True
            self.at = back
        return False

    def scan_group(self, node: Node) -> None:
        back = self.at
        if self.take("("):
            if not self.take("GroupConn"):
                self.at = back
                raise self.fault("GroupConn", "Frame_Module")
            self.need("=")
            node.props["scan_group_global"] = self.take("GLOBAL")
            node.add(self.variable(), "scan_group")
            self.need(")")

    def body(self, node: Node) -> None:
        """Parameters, variables, submodules and layout blocks, and the module's own ENDDEF."""
        if self.take("MODULEPARAMETERS"):
            self.variables(node, "parameter")
        if self.take("LOCALVARIABLES"):
            self.variables(node, "local")
        if self.take("SUBMODULES"):
            self.submodules(node)
        while self.sees("ModuleDef"):
            self.block(node)
        back = self.at
        if self.take("ENDDEF"):
            note = self.note("end")
            if note is None:
                self.at = back
                return
            node.add(note)
            self.take(";")

    def block(self, node: Node) -> None:
        node.add(self.layout())
        if self.sees("ModuleCode"):
            node.add(self.code())
        self.need("ENDDEF")
        node.add(self.note("end"))
        if not self.take(";") and self.take("("):
            self.mappings(node)
            self.need(";")

    def submodules(self, node: Node) -> None:
        first = True
        while True:
            if note := self.note("discarded"):
                node.add(note)
                first = False
                continue
            if self.sees_any(("ModuleDef", "ENDDEF", "TYPEDEFINITIONS")) or not NAME.match(self.text, self.here()) or self.opens_module_type():
                break
            first = False
            head = self.module_head("SingleModule")
            self.need(":")
            if self.take("MODULEDEFINITION"):
                self.datecode(head)
                if self.frame():
                    head.kind = "FrameModule"
                self.scan_group(head)
                self.body(head)
            else:
                head.kind = "ModuleTypeInstance"
                head.props["type"] = self.name()
                self.notes(head)
                if self.take("("):
                    self.mappings(head)
                    self.need(";")
                else:
                    self.take(";")
            node.add(self.done(head), "submodule")
        if first:
            raise self.fault("NAME")

    def module_type(self, root: Node) -> None:
        node = Node("ModuleTypeDef", start=self.here(), name=self.name())
        node.add(self.note("description"))
        self.need("=")
        self.notes(node)
        node.props["private"] = self.take("PRIVATE_")
        self.notes(node)
        self.need("MODULEDEFINITION")
        self.datecode(node)
        self.scan_group(node)
        self.body(node)
        root.add(self.done(node), "module_type")

    def mappings(self, node: Node) -> None:
        while True:
            row = Node("ParameterMapping", "mapping", start=self.here())
            target = self.variable()
            row.name = target.name
            row.add(target, "target")
            self.need("=>")
            row.props["global"] = self.take("GLOBAL")
            row.props["duration"] = self.take("Duration_Value")
            if self.take("Time_Value"):
                row.props["source"] = "time"
                text = self.read(STRING, "STRING")
                row.literal = unquoted(text[0]) if text else None
            elif (value := self.value("source")) is not None:
                row.props["source"] = "value"
                row.literal = value.literal
                row.add(value)
            else:
                row.props["source"] = "variable"
                row.add(self.variable(), "source")
            node.add(self.done(row))
            if not self.take(","):
                break
        self.need(")")

    # records and variables

    def sees_record(self) -> bool:
        return bool(NAME.match(self.text, self.here()))

    def record(self, root: Node) -> None:
        node = Node("DataType", start=self.here(), name=self.name(), description=None)
        if text := self.read(STRING, "STRING"):
            node.props["description"] = unquoted(text[0])
        self.need("=")
        self.need("RECORD")
        self.datecode(node)
        if not self.sees("ENDDEF"):
            self.variables(node, "field")
        self.need("ENDDEF")
        node.add(self.note("end"))
        self.take(";")
        root.add(self.done(node), "data_type")

    def variables(self, parent: Node, scope: str) -> None:
        found = False
        while True:
            if note := self.note("discarded"):
                parent.add(note)
            elif not self.sees_any(SECTIONS) and NAME.match(self.text, self.here()):
                self.variable_group(parent, scope)
            else:
                break
            found = True
        if not found:
            raise self.fault("NAME")

    def variable_group(self, parent: Node, scope: str) -> None:
        """Names that share a type, modifiers and an initial value: one node for each name."""
        group = []
        while True:
            node = Node("Variable", scope, start=self.here(), name=self.name(), description=None)
            node.end = self.ended
            if text := self.read(STRING, "STRING") or self.read(OPEN_STRING, "STRING"):
                node.props["description"] = unquoted(text[0])
            group.append(node)
            if not self.take(","):
                break
        self.need(":")
        shared: dict = {"global": self.take("GLOBAL"), "type": self.name()}
        words = set()
        while word := next((w for w in MODIFIERS if self.take(w)), None):
            words.add(word)
        shared |= {w.lower(): w in words for w in MODIFIERS}
        shared |= {"init": "absent", "duration": False}
        literal = None
        if self.take(":="):
            shared["duration"] = self.take("Duration_Value")
            if self.take("Default"):
                shared["init"] = "default"
            elif self.take("Time_Value"):
                shared["init"] = "time"
                text = self.read(STRING, "STRING")
                literal = unquoted(text[0]) if text else None
            elif (value := self.value("init")) is not None:
                shared["init"] = value.props["type"]
                literal = value.literal
            else:
                raise self.fault("value", "Default", "Time_Value")
        self.need(";")
        for node in group:
            node.literal = literal
            node.props |= shared
            parent.add(node)

    def value(self, role: str) -> Node | None:
        at = self.here()
        first = self.text[at : at + 1]
        if first in ("(", "_", "'") or first.isalpha() and first not in "TF":
            self.misses(VALUES)
            return None
        for kind, pattern in (("boolean", BOOL), ("real", REAL), ("string", STRING), ("integer", INT)):
            if m := self.read(pattern, kind):
                return Node("Literal", role, literal=unquoted(m[0]) if kind == "string" else m[0], start=at, end=self.ended, type=kind)
        return None

    def variable(self) -> Node:
        node = Node("VarRef", start=self.here(), name=self.name(), state=None)
        while self.take("."):
            node.name += "." + self.name()
        if m := self.read(STATE, "STATE_SUFFIX"):
            node.props["state"] = m[1].lower()
        return self.done(node)

    # expressions

    def expression(self) -> Node:
        if self.sees("IF"):
            node = Node("TernaryOp", start=self.here())
            self.branches(node, lambda k: node.add(self.expression(), f"value:{k}"))
            self.need("ELSE")
            node.add(self.expression(), "else")
            self.need("ENDIF")
            return self.done(node)
        return self.chain("BoolOp", "OR", self.conjunction)

    def conjunction(self) -> Node:
        return self.chain("BoolOp", "AND", self.negation)

    def branches(self, node: Node, content: Callable[[int], object]) -> None:
        k = 0
        while self.take("IF" if k == 0 else "ELSIF"):
            node.add(self.expression(), f"condition:{k}")
            self.need("THEN")
            content(k)
            k += 1

    def chain(self, kind: str, word: str, operand: Callable[[], Node]) -> Node:
        first = operand()
        if not self.sees(word):
            return first
        node = Node(kind, name=word, start=first.start)
        node.add(first, "operand")
        while self.take(word):
            node.add(operand(), "operand")
        return self.done(node)

    def negation(self) -> Node:
        at = self.here()
        if self.take("NOT"):
            node = Node("NotOp", name="NOT", start=at)
            node.add(self.negation(), "operand")
            return self.done(node)
        left = self.sums()
        if op := self.take_any(COMPARISONS):
            node = Node("Compare", name=op, start=left.start)
            node.add(left, "left")
            node.add(self.sums(), "right")
            return self.done(node)
        return left

    def folded(self, words: tuple[str, ...], operand: Callable[[], Node]) -> Node:
        """A left fold; each nested operation gets the whole chain's span."""
        node, made = operand(), []
        start = node.start
        if not self.text.startswith(words, self.here()):
            self.misses(words)
            return node
        while op := self.take_any(words[1:] if words[0] == "*" and self.text.startswith("*)", self.here()) else words):
            outer = Node("BinOp", name=op, start=start)
            outer.add(node, "left")
            outer.add(operand(), "right")
            made.append(outer)
            node = outer
        for outer in made:
            outer.end = self.ended
        return node

    def sums(self) -> Node:
        return self.folded(("+", "-"), self.products)

    def products(self) -> Node:
        return self.folded(("*", "/"), self.signed)

    def signed(self) -> Node:
        at = self.here()
        if (value := self.value("")) is not None:
            return value
        if op := self.take_any(("+", "-")):
            node = Node("UnaryOp", name=op, start=at)
            node.add(self.signed(), "operand")
            return self.done(node)
        if self.take("("):
            node = self.expression()
            self.need(")")
            return node
        name = self.read(NAME, "NAME")
        if not name:
            raise self.fault("NAME", "(")
        if self.sees("("):
            return self.call(at, name[0])
        self.at = at
        return self.variable()

    def call(self, at: int, name: str) -> Node:
        node = Node("FuncCall", name=name, start=at)
        self.need("(")
        if not self.take(")"):
            node.add(self.expression(), "argument")
            while self.take(","):
                node.add(self.expression(), "argument")
            self.need(")")
        return self.done(node)

    # statements

    #: Shapes of the assignments met last, in whatever text, and how many of them are tried.
    shapes: tuple[Shape, ...] = ()
    TRIED = 4

    def alike(self, parent: Node, role: str, stops: tuple[str, ...]) -> bool:
        """Reads the assignments here that have a shape met before, as far as they go; False if none does."""
        for shape in self.shapes if self.budget is None else ():
            text, at, match, names = self.text, self.at, shape.match, shape.names
            while (m := match(text, at)) and KEYWORDS.isdisjoint(names(m.groups())) and not text.startswith(stops, m.start(1)):
                parent.kids.append(Flat(shape, m, role))
                at = m.end()
            if at > self.at:
                self.at = self.ended = at
                return True
        return False

    def statements(self, parent: Node, role: str, stops: tuple[str, ...]) -> None:
        while True:
            if self.shapes and self.alike(parent, role, stops):
                continue
            at = self.here()
            if note := self.note(role):
                note.props["statement"] = self.take(";")
                parent.add(note)
            elif self.sees("IF"):
                node = Node("IfStmt", role, start=at)
                self.branches(node, lambda k, node=node: self.statements(node, f"then:{k}", ()))
                if self.take("ELSE"):
                    node.props["has_else"] = True
                    self.statements(node, "else", ())
                self.need("ENDIF")
                parent.add(self.done(node))
                self.need(";")
            elif self.sees_any(stops) or not NAME.match(self.text, at):
                return
            else:
                name = self.name()
                if self.sees("("):
                    node = Node("FuncCallStmt", role, start=at, name=name)
                    node.add(self.call(at, name), "call")
                else:
                    self.at = at
                    node = Node("Assignment", role, start=at)
                    target = self.variable()
                    node.name = target.name
                    node.add(target, "target")
                    if self.sees("=="):
                        raise self.fault("=")
                    self.need("=")
                    node.add(self.expression(), "value")
                parent.add(self.done(node))
                self.need(";")
                if node.kind == "Assignment" and self.budget is None:
                    shape = learned(self.text, at, self.ended, node)
                    if shape and shape not in self.shapes:
                        Parser.shapes = (shape, *self.shapes)[: self.TRIED]

    # code: sequences and equations

    def code(self) -> Node:
        node = Node("ModuleCode", "code", start=self.here())
        self.need("ModuleCode")
        while True:
            if note := self.note("code"):
                node.add(note)
            elif self.sees("SEQUENCE") or self.sees("OPENSEQUENCE"):
                node.add(self.sequence())
            elif self.sees("EQUATIONBLOCK"):
                node.add(self.equations())
            elif not node.kids:
                raise self.fault("EQUATIONBLOCK", "SEQUENCE", "OPENSEQUENCE")
            else:
                return self.done(node)

    def placed(self, node: Node) -> None:
        self.need("COORD")
        node.props["position"] = self.pair()
        self.need("OBJSIZE")
        node.props["size"] = self.pair()
        node.props["layer"] = self.layer() if self.sees("Layer_") else None

    def pair(self) -> list[float]:
        x = self.real()
        self.need(",")
        return [x, self.real()]

    def equations(self) -> Node:
        node = Node("Equation", "equation", start=self.here())
        self.need("EQUATIONBLOCK")
        node.name = self.name()
        self.placed(node)
        self.need(":")
        self.statements(node, "statement", BLOCK_WORDS)
        return self.done(node)

    def sequence(self) -> Node:
        node = Node("Sequence", "sequence", start=self.here())
        node.props["type"] = self.need("SEQUENCE", "OPENSEQUENCE")
        if not self.sees("COORD") and not self.sees("("):
            node.name = self.name()
        node.props |= {"control": False, "timer": False}
        if self.take("("):
            node.props["control"] = self.take("SeqControl")
            self.take(",")
            node.props["timer"] = self.take("SeqTimer")
            self.need(")")
        self.placed(node)
        self.elements(node, "element")
        self.need("ENDSEQUENCE", "ENDOPENSEQUENCE")
        return self.done(node)

    def elements(self, parent: Node, role: str) -> None:
        while True:
            at = self.here()
            if note := self.note(role):
                parent.add(note)
                continue
            word = self.take_any(ELEMENT_WORDS)
            if word is None:
                return
            node = Node(ELEMENTS[word], role, start=at)
            if word in ("SEQINITSTEP", "SEQSTEP"):
                self.optional_name(node, AFTER_STEP)
                for part, kind in zip(STEP_WORDS, ("enter", "active", "exit"), strict=True):
                    if self.take(part):
                        self.statements(node, kind, AFTER_STEP)
            elif word == "SEQTRANSITION":
                self.optional_name(node, ("WAIT_FOR",))
                self.need("WAIT_FOR")
                self.notes(node)
                node.add(self.expression(), "condition")
            elif word in ("SUBSEQTRANSITION", "SUBSEQUENCE"):
                node.name = self.name()
                self.elements(node, "element")
                self.need("END" + word)
            elif word == "SEQFORK":
                targets = [self.name()]
                while self.take(","):
                    targets.append(self.name())
                node.props["targets"] = targets
            elif word in ("ALTERNATIVESEQ", "PARALLELSEQ"):
                stem = word.removesuffix("SEQ")
                self.elements(node, "branch:0")
                self.need(stem + "BRANCH")
                self.elements(node, "branch:1")
                k = 2
                while self.take(stem + "BRANCH"):
                    self.elements(node, f"branch:{k}")
                    k += 1
                node.props["branches"] = k
                self.need("END" + stem)
            parent.add(self.done(node))

    def optional_name(self, node: Node, stops: tuple[str, ...]) -> None:
        if not self.sees_any(stops) and NAME.match(self.text, self.here()):
            node.name = self.name()

    # layout

    def layout(self) -> Node:
        node = Node("ModuleDef", "layout", start=self.here(), grid=DEFAULT_GRID, zoomable=False, zoom_limits=None, layer_limit=None)
        self.need("ModuleDef")
        self.need("ClippingBounds")
        self.need("=")
        node.props["clipping_bounds"] = self.box(node)
        while True:
            if note := self.note("discarded"):
                node.add(note)
            elif self.take("Two_Layers_"):
                self.need("LayerLimit_")
                self.need("=")
                node.props["layer_limit"] = self.real()
            elif self.sees("ZoomLimits"):
                node.props["zoom_limits"] = self.zoom_limits()
            elif self.take("Zoomable"):
                node.props["zoomable"] = True
            elif self.take("Grid"):
                self.need("=")
                node.props["grid"] = self.real()
            else:
                break
        if self.take("GraphObjects"):
            self.need(":")
            shared = self.layer() if self.sees("Layer_") else None
            self.listed(node, lambda: self.shape(shared) if self.sees_any(SHAPES) else None, SHAPES)
        self.notes(node)
        if self.take("InteractObjects"):
            self.need(":")
            self.listed(node, lambda: self.interactor() if self.sees_any(INTERACTORS) else None, INTERACTORS)
        return self.done(node)

    def listed(self, parent: Node, item: Callable[[], Node | None], expected: tuple[str, ...]) -> None:
        found = False
        while True:
            if note := self.note("discarded"):
                parent.add(note)
            elif (node := item()) is not None:
                parent.add(node)
            elif found:
                return
            else:
                raise self.fault(*expected)
            found = True

    def coordinates(self, node: Node) -> list[float]:
        self.need("(")
        out = self.reals(node, 2)
        self.need(")")
        return out

    def reals(self, node: Node, n: int) -> list[float]:
        """2 or 5 numbers, each with its tails, up to a bracket; where no tail stands they are read at once."""
        if m := LISTED[n].match(self.text, self.at):
            self.at = self.ended = m.end()
            self.steps += 2 * n - 1
            self.coordinate_tails(node)
            return [float(x) for x in m[0].split(",")]
        out = []
        for k in range(n):
            if k:
                self.need(",")
            out.append(self.real())
            self.coordinate_tails(node)
        return out

    def box(self, node: Node) -> list[list[float]]:
        return [self.coordinates(node), self.coordinates(node)]

    def coordinate_tails(self, node: Node) -> None:
        while True:
            if self.sees(":"):
                self.coordinate_tail(node)
            elif self.take("ClippingBounds"):
                self.need("=")
                self.must(REAL, "REAL")
                while True:
                    if self.sees(":"):
                        self.coordinate_tail(node)
                    if not self.read(REAL, "REAL"):
                        break
            else:
                return

    def coordinate_tail(self, node: Node) -> None:
        self.need(":")
        if (bound := self.binding("tail")) is not None:
            node.add(bound)
        else:
            node.add(self.expression(), "tail")

    def binding(self, role: str, literal_text: bool = False) -> Node | None:
        """InVar_ or OutVar_ and what it binds."""
        at = self.here()
        word = next((w for w in ("InVar_", "OutVar_") if self.take(w)), None)
        if word is None:
            return None
        node = Node("Binding", role, start=at, direction=word.removesuffix("Var_").lower())
        if literal_text and self.take("LitString"):
            node.props["litstring"] = True
            node.literal = self.string()
        elif (value := self.value("bound")) is not None:
            node.literal = value.literal
            node.add(value)
        else:
            node.name = node.add(self.variable(), "bound").name
        return self.done(node)

    def tail(self, node: Node, role: str = "tail", out: bool = False) -> bool:
        """`: InVar_ x` (with `out` also OutVar_ and LitString) or `: ( expression )`, if one stands here."""
        back = self.at
        if not self.take(":"):
            return False
        if self.sees("("):
            self.take("(")
            node.add(self.expression(), role)
            self.need(")")
            return True
        if not out and self.sees("OutVar_"):
            raise self.fault("InVar_", "(")
        if (bound := self.binding(role, literal_text=out)) is not None:
            node.add(bound)
            return True
        self.at = back
        raise self.fault("InVar_", "(")

    def layer(self) -> int:
        self.need("Layer_")
        self.need("=")
        return int(self.must(INT, "SIGNED_INT")[0])

    def zoom_limits(self) -> list[float]:
        self.need("ZoomLimits")
        self.need("=")
        return [self.real(), self.real()]

    def enable(self, node: Node) -> bool:
        self.need("Enable_")
        self.need("=")
        value = self.must(BOOL, "BOOL")[0] == "True"
        if not self.tail(node, "enable"):
            raise self.fault(":")
        return value

    def counted(self, word: str, node: Node) -> int:
        self.need(word)
        self.need("=")
        number = int(self.must(INT, "SIGNED_INT")[0])
        self.tail(node)
        return number

    def colour(self, owner: Node) -> Node:
        at = self.here()
        word = self.need(*COLOURS)
        node = Node("Colour", "colour", name=COLOURS[word], start=at)
        self.need(":")
        if word == "OutlineColour" and self.sees("Width_"):
            node.props["width"] = self.counted("Width_", node)
        while True:
            if self.note("discarded"):
                continue
            word = self.sees_any(("Colour0", "Colour1"))
            if not word:
                break
            node.props[word.lower()] = self.counted(word, node)
        if self.take("ColourStyle"):
            self.need("=")
            m = self.read(REAL, "REAL") or self.must(BOOL, "BOOL")
            node.props["style"] = m[0]
            self.tail(node)
        return self.done(node)

    def common(self, node: Node) -> None:
        """Layer, enable and colours of a shape; comments between them are dropped."""
        while True:
            if note := self.note("discarded"):
                node.add(note)
            elif self.sees("Layer_"):
                node.props["layer"] = self.layer()
            elif self.sees("Enable_"):
                node.props["enable"] = self.enable(node)
            elif self.sees_any(tuple(COLOURS)):
                node.add(self.colour(node))
            else:
                return

    def shape(self, shared_layer: int | None) -> Node:
        at = self.here()
        kind = next(s for s in SHAPES if self.take(s))
        node = Node("GraphObject", "graph", name=kind, start=at)
        if kind == "PolygonObject":
            node.props["types"] = []
            while word := next((w for w in POLYGON_TYPES if self.take(w)), None):
                node.props["types"].append(word)
            points = [self.coordinates(node)]
            while self.sees("("):
                points.append(self.coordinates(node))
            node.props["points"] = points
        elif kind == "SegmentObject":
            node.props["coords"] = self.box(node)
            node.props["points"] = [self.coordinates(node)]
        elif kind != "CompositeObject":
            node.props["coords"] = self.box(node)
        if kind == "TextObject":
            self.text_content(node)
        self.common(node)
        if "layer" not in node.props and shared_layer is not None:
            node.props["layer"] = shared_layer
        return self.done(node)

    def text_content(self, node: Node) -> None:
        texts: list[str] = []
        bound: list[str] = []
        found = False
        while True:
            if text := self.read(STRING, "STRING") or self.read(OPEN_STRING, "STRING"):
                texts.append(unquoted(text[0]))
            elif self.take("VarName"):
                bound += texts[-1:]
            elif self.sees("ValueFraction"):
                node.props["fraction"] = self.counted("ValueFraction", node)
            elif self.sees("Width_"):
                node.props["width"] = self.counted("Width_", node)
            elif word := next((w for w in ("LeftAligned", "RightAligned") if self.take(w)), None):
                node.props["alignment"] = word
            elif self.take("ConnectionNode"):
                self.need("(")
                node.props["connection"] = self.pair()
                self.need(")")
            elif self.sees("Format_String_"):
                node.props["format"] = self.format_string(node)
            elif found:
                break
            else:
                raise self.fault("STRING", "VarName")
            found = True
        node.props["texts"] = texts
        node.props["text_vars"] = bound

    def format_string(self, node: Node) -> str:
        self.need("Format_String_")
        self.need("=")
        value = self.value("format")
        if value is None:
            raise self.fault("value")
        self.tail(node, out=True)
        return value.literal

    def interactor(self) -> Node:
        at = self.here()
        kind = next(w for w in INTERACTORS if self.take(w))
        node = Node("InteractObject", "interact", name=kind, start=at)
        node.props["coords"] = [self.box(node)]
        while self.sees("("):
            node.props["coords"].append(self.box(node))
        if kind == "ComButProc_":
            call = Node("Procedure", "procedure", start=self.here(), name=self.name())
            while self.atom(call):
                pass
            node.add(self.done(call))
        found = kind == "ComButProc_"
        while self.interact_line(node, kind != "ComButProc_"):
            found = True
        if not found:
            raise self.fault("NAME", "value")
        return self.done(node)

    def atom(self, node: Node, role: str = "argument") -> bool:
        if (value := self.value(role)) is not None:
            node.add(value)
            return True
        return self.tail(node, role, out=True)

    def interact_line(self, node: Node, simple: bool) -> bool:
        if note := self.note("discarded"):
            node.add(note)
        elif self.sees("Layer_"):
            node.props.setdefault("layers", []).append(self.layer())
        elif self.sees("Enable_"):
            node.props.setdefault("enables", []).append(self.enable(node))
        elif self.sees_any(tuple(COLOURS)):
            node.add(self.colour(node))
        elif self.sees_any(INTERACTORS) or self.sees_any(("ModuleCode", "ENDDEF")):
            return False
        elif simple and (word := next((w for w in ("LeftAligned", "RightAligned") if self.take(w)), None)):
            node.props["alignment"] = word
        elif simple and self.sees("Format_String_"):
            node.props["format"] = self.format_string(node)
        elif NAME.match(self.text, self.here()):
            self.flag_or_assignment(node)
        elif simple and (self.sees(":") or self.value_ahead()):
            return self.atom(node, "value")
        else:
            return False
        return True

    def value_ahead(self) -> bool:
        at = self.here()
        return any(p.match(self.text, at) for p in (BOOL, REAL, STRING, INT))

    def flag_or_assignment(self, node: Node) -> None:
        back, name = self.at, self.name()
        if self.sees("=") and not self.sees("=>"):
            self.at = back
            self.assignment_line(node, "assign")
        else:
            node.props.setdefault("flags", []).append(name)

    def assignment_line(self, node: Node, role: str) -> None:
        row = Node("Property", role, start=self.here(), name=self.name())
        self.need("=")
        value = self.value("value")
        if value is None:
            raise self.fault("value")
        row.literal = value.literal
        row.props["type"] = value.props["type"]
        self.tail(row, out=True)
        node.add(self.done(row))


def program_name(line: str) -> str | None:
    """The `name:` field of the third header line."""
    for part in line.split(","):
        key, mark, value = part.partition(":")
        if mark and key.strip().casefold() == "name" and value.strip():
            return value.strip()
    return None


def parse(text: str, budget: int | None = None) -> Node:
    """The tree of a whole program text; raises SyntaxFault, or BudgetFault after `budget` steps of the cursor. Positions are offsets in this text."""
    return Parser(text, budget).program()


__all__ = ["SPACE", "Node", "Parser", "SyntaxFault", "parse", "program_name"]

"""Nodes as text for people: expressions, statements, charts and module summaries."""

from __future__ import annotations

from collections.abc import Callable
from textwrap import indent

from rungwise.operators.tree import Node

STEP = "    "


def literal(node: Node) -> str:
    kind, text = node.props["type"], node.literal
    return {"string": repr, "integer": lambda t: str(int(t)), "real": lambda t: str(float(t))}.get(kind, str)(text)


def expression(n: Node) -> str:
    """An expression or statement on one or more lines."""
    kids = [expression(k) for k in n.kids] if n.kind not in ("IfStmt", "TernaryOp") else []
    match n.kind:
        case "Literal":
            return literal(n)
        case "VarRef":
            return f"{n.name}:{n.props['state']}" if n.props.get("state") else n.name
        case "Assignment":
            return f"{kids[0]} = {kids[1]}"
        case "FuncCallStmt":
            return kids[0]
        case "FuncCall":
            return f"{n.name}({', '.join(kids)})"
        case "BoolOp":
            return f" {n.name} \n".join(kids)
        case "NotOp":
            return f"NOT({kids[0]})"
        case "Compare":
            return f"{kids[0]} {n.name} {kids[1]}"
        case "BinOp":
            return f"({kids[0]} {n.name} {kids[1]})"
        case "UnaryOp":
            return n.name + kids[0]
        case "Comment":
            return n.literal
        case "Binding":
            return f"{'In' if n.props['direction'] == 'in' else 'Out'}Var_ {n.name if n.name is not None else repr(n.literal)}"
    return branching(n)


def branching(n: Node) -> str:
    """IF as a statement or as an expression: each branch's content set in under its condition."""
    lines, k = [], 0
    while conditions := n.of(f"condition:{k}"):
        lines += [f"{'ELSIF' if k else 'IF'} {expression(conditions[0])}", "THEN"]
        lines += [indent(expression(x), STEP) for x in n.of(f"then:{k}") + n.of(f"value:{k}")]
        k += 1
    if n.of("else") or n.props.get("has_else"):
        lines += ["ELSE", *[indent(expression(x), STEP) for x in n.of("else")]]
    return "\n".join([*lines, "ENDIF"])


def branch_lines(n: Node) -> list[str]:
    out = []
    for k in range(n.props["branches"]):
        out += [f"{STEP}Branch {k + 1}:", *(STEP * 2 + line for line in chart(n.of(f"branch:{k}")).splitlines())]
    return out


def chart(nodes: list[Node]) -> str:
    """Sequence elements, one line each, nested ones set in."""
    out: list[str] = []
    for n in nodes:
        inner = [STEP + line for line in chart(n.of("element")).splitlines()]
        match n.kind:
            case "InitStep" | "Step":
                out.append(f"{n.kind} {n.name}")
                for part in ("enter", "active", "exit"):
                    if code := n.of(part):
                        out += [f"{STEP}{part.capitalize()}:", *(STEP * 2 + expression(x) for x in code)]
            case "Transition":
                out.append(f"Transition{' ' + n.name if n.name else ''} WAIT_FOR {expression(n.of('condition')[0])}")
            case "Alternative" | "Parallel":
                out += [f"{n.kind}:", *branch_lines(n), f"End{n.kind}"]
            case "Subsequence" | "TransitionSub":
                out += [f"{n.kind} {n.name}:", *inner, f"End{n.kind}"]
            case "Fork":
                out.append(f"Fork to {', '.join(n.props['targets'])}")
            case "Break":
                out.append("Break")
            case _:
                out.append(expression(n))
    return "\n".join(out)


def value_of(kind: str | None, text: str | None):
    """What a literal of a kind stands for. A point in time is a mapping of its own, `Default` and no value are None."""
    if kind == "time":
        return {"Time_Value": text}
    read = {"integer": int, "real": float, "boolean": lambda t: t == "True"}.get(kind, str)
    return read(text) if text is not None else None


# The built-in types, of which a declaration's type is shown as a member.
BUILT_IN = ("string", "boolean", "integer", "identstring", "tagstring", "time", "duration", "linestring", "maxstring", "real")


def type_text(name: str) -> str:
    return f"<Simple_DataType.{name.upper()}: {name.lower()!r}>" if name.lower() in BUILT_IN else repr(name)


def variable(n: Node) -> str:
    """A variable on one line."""
    return "Name: {}, Datatype: {}, Global: {}, Const: {}, State: {}, Init_value : {}, Description: {}".format(*cells_of(n))


def cells_of(n: Node) -> list[str]:
    return [repr(n.name), type_text(n.props["type"]), str(n.props["global"]), str(n.props["const"]), str(n.props["state"]), repr(value_of(n.props.get("init"), n.literal)), repr(n.props["description"])]


def variable_table(nodes: list[Node]) -> str:
    """Variables as aligned columns, every column as wide as its widest cell; [] for none."""
    if not nodes:
        return "[]"
    cells = [cells_of(n) for n in nodes]
    wide = [max(map(len, column)) for column in zip(*cells, strict=True)]
    heads = ("Name: ", " , Datatype: ", ", Global: ", ", Const: ", ", State: ", ", Init_value : ", ", Description: ")
    return "[\n" + "\n".join(STEP + "".join(f"{h}{c:<{w}}" for h, c, w in zip(heads, row, wide, strict=True)) for row in cells) + "]"


def code(n: Node) -> str:
    """A code section: its sequences, then its equation blocks."""
    sequences = [f"Sequence {s.name!r} at {tuple(s.props['position'])} with size {tuple(s.props['size'])} (type={s.props['type']})\n    Code:\n" + indent(chart(s.of("element")), STEP * 2) for s in n.of("sequence")]
    equations = [f"EquationBlock name={e.name!r} at {tuple(e.props['position'])} with size {tuple(e.props['size'])}\n    Code:\n" + indent("\n".join(expression(x) for x in e.of("statement")), STEP * 2) for e in n.of("equation")]
    parts = [head + "\n" + indent("\n\n".join(body), STEP) for head, body in (("Sequences:", sequences or ["No sequences"]), ("Equations:", equations))]
    return "ModuleCode{\n" + "\n\n".join(indent(p, STEP) for p in parts) + "\n}"


def mapping(n: Node) -> str:
    if n.props["global"]:
        return f"{n.name} => GLOBAL"
    source = n.of("source")
    if n.props["source"] == "variable":
        return f"{n.name} => {source[0].name}"
    if n.props["source"] == "time":
        return f"{n.name} => {value_of('time', n.literal)!r}"
    return f"{n.name} => {literal(source[0]) if source else '<None>'}"


def listing(items: list[str]) -> str:
    return "[\n" + "\n".join(indent(x, STEP) for x in items) + "]" if items else "[]"


def record(n: Node) -> str:
    """A record type: what it is declared as, and its fields as a table. Sources tell neither file nor library."""
    rows = [("Name", repr(n.name)), ("Description", repr(n.props["description"])), ("Datecode", repr(n.props["datecode"])), ("OriginFile", "None"), ("OriginLib", "None")]
    return "Datatype{\n" + indent("\n".join([*(f"{k:<11}: {v}" for k, v in rows), f"Variables in datatype   : {variable_table(n.of('field'))}"]), STEP) + "}"


def layout(n: Node) -> str:
    """A module's layout options."""
    box = tuple(tuple(p) for p in n.props["clipping_bounds"])
    zoom = n.props["zoom_limits"]
    rows = [("ClippingBounds", box), ("ZoomLimits", tuple(zoom) if zoom else None), ("SeqLayers", n.props["layer_limit"]), ("Grid", n.props["grid"]), ("Zoomable", n.props["zoomable"])]
    return "\n" + indent("\n".join(f"{k:<15}: {v}" for k, v in rows), STEP)


Spans = Callable[[Node], tuple[int, int, int, int]]


def structure(n: Node, spans: Spans) -> str:
    """A node of code in full: its class, and every field by name, spans included."""
    start, end, line, column = spans(n)
    span = f"span=SourceSpan(start={start}, end={end}, line={line}, column={column})"

    def one(role: str) -> str:
        return structure(n.of(role)[0], spans)

    def several(role: str, around: str = "[]") -> str:
        held = [structure(k, spans) for k in n.of(role)]
        return around[0] + ", ".join(held) + ("," if around == "()" and len(held) == 1 else "") + around[1]

    def pairs(many: bool) -> str:
        held = []
        for k in range(len({x.role for x in n.kids if x.role.startswith("condition:")})):
            held.append(f"({one(f'condition:{k}')}, {several(f'then:{k}', '()') if many else one(f'value:{k}')})")
        return "(" + ", ".join(held) + ("," if len(held) == 1 else "") + ")"

    match n.kind:
        case "Literal":
            return repr(value_of(n.props["type"], n.literal))
        case "Comment":
            return f"CodeComment(text={n.literal!r}, {span})"
        case "VarRef":
            return f"VarRef(name={n.name!r}, state={n.props['state']!r}, {span})"
        case "BoolOp":
            return f"BoolOp(op={n.name!r}, operands={several('operand', '()')}, {span})"
        case "NotOp":
            return f"NotOp(operand={one('operand')}, {span})"
        case "UnaryOp":
            return f"UnaryOp(op={n.name!r}, operand={one('operand')}, {span})"
        case "Compare" | "BinOp":
            return f"{n.kind}(left={one('left')}, op={n.name!r}, right={one('right')}, {span})"
        case "FuncCall":
            return f"FuncCall(name={n.name!r}, args={several('argument', '()')}, {span})"
        case "FuncCallStmt":
            return f"FuncCallStmt(call={one('call')}, {span})"
        case "Assignment":
            return f"Assignment(target={one('target')}, value={one('value')}, {span})"
        case "TernaryOp":
            return f"TernaryOp(branches={pairs(False)}, else_expr={one('else')}, {span})"
        case "IfStmt":
            return f"IfStmt(branches={pairs(True)}, else_block={several('else', '()') if n.props.get('has_else') else None}, {span})"
        case "InitStep" | "Step":
            parts = ", ".join(f"{x}={several(x)}" for x in ("enter", "active", "exit"))
            return f"SFCStep(kind={('init' if n.kind == 'InitStep' else 'step')!r}, name={n.name!r}, code=SFCCodeBlocks({parts}))"
        case "Transition":
            return f"SFCTransition(name={n.name!r}, condition={one('condition')})"
        case "Alternative" | "Parallel":
            return f"SFC{n.kind}(branches=[{', '.join(several(f'branch:{k}') for k in range(n.props['branches']))}])"
        case "Subsequence" | "TransitionSub":
            return f"SFC{n.kind}(name={n.name!r}, body={several('element')})"
        case "Fork":
            return f"SFCFork(targets={tuple(n.props['targets'])!r})"
        case _:
            return "SFCBreak()"


def block(n: Node, spans: Spans) -> str:
    """A sequence or an equation block: its head, and its code in full, comments as they stand."""
    body = listing([k.literal if k.kind == "Comment" else structure(k, spans) for k in n.kids])
    head = f"name={n.name}, pos={tuple(n.props['position'])},"
    if n.kind == "Equation":
        return f"Equation({head}\n    code={body})"
    return f"Sequence({head} type={n.props['type']}, control={n.props['control']}, timer={n.props['timer']},\n    code={body})"


def told(n: Node, spans: Spans) -> str | None:
    """The text of a node that has one of its own: variables, records, mappings, layouts, sequences and equation blocks."""
    match n.kind:
        case "Variable":
            return variable(n)
        case "DataType":
            return record(n)
        case "ParameterMapping":
            return mapping(n)
        case "ModuleDef":
            return layout(n)
        case "Sequence" | "Equation":
            return block(n, spans)
    return None


def bound(n: Node, spans: Spans) -> str:
    """What an enable hangs on: a variable or expression in full; a literal as itself."""
    if n.kind == "Binding":
        return structure(n.kids[0], spans) if n.kids else str(n.literal)
    return str(value_of(n.props["type"], n.literal)) if n.kind == "Literal" else structure(n, spans)


#: Heads of a summary by kind, and how wide heads are.
SUMMARIES = {
    "SingleModule": ("SingleModule", 16),
    "ModuleTypeDef": ("ModulType", 16),
    "ModuleTypeInstance": ("ModuleTypeInstance", 17),
    "FrameModule": ("FrameModule", 13),
}


def module(n: Node, spans: Spans) -> str:
    """A module's summary: what it declares, and how many blocks it has."""
    last_code = n.of("code")[-1:]
    section = code(last_code[0]) if last_code else "None"
    inner = listing([module(k, spans) for k in n.of("submodule")])
    if n.kind == "BasePicture":
        types = f"TYPEDEFINITIONS (Records): {listing([record(k) for k in n.of('data_type')])}\n\nTYPEDEFINITIONS (Modules): {listing([module(k, spans) for k in n.of('module_type')])}\n"
        body = f"Name: {n.name!r}\nPosition: {tuple(n.props['coords'])!r}\n\n{types}Localvariables: {variable_table(n.of('local'))}\n\nSubmodules: {inner}\n\nModuleCode: {section}\n\nModuleDefBlocks: {len(n.of('layout'))}\n\n"
        return "BasePicture{\n" + indent(body, STEP) + "}"
    head, wide = SUMMARIES[n.kind]
    rows = [("Name", repr(n.name), wide)]
    if n.kind != "ModuleTypeDef":
        rows.append(("Enable", str(n.props["enable"]), wide))
        if n.kind == "ModuleTypeInstance":
            tail = n.of("enable")
            rows.append(("Enable_tail", bound(tail[0], spans) if tail else "None", wide))
        rows.append(("Invoke_coord", repr(tuple(n.props["coords"])), wide))
    mappings = ("ParameterMappings", listing([mapping(k) for k in n.of("mapping")]), 17)
    if n.kind == "ModuleTypeInstance":
        rows += [("ModuleTypeName", repr(n.props["type"]), wide), mappings]
    else:
        rows.append(("Datecode", repr(n.props.get("datecode")), wide))
        if n.kind == "ModuleTypeDef":
            rows += [("OriginFile", "None", wide), ("OriginLib", "None", wide)]
        if n.kind != "FrameModule":
            rows += [("Moduleparameters", variable_table(n.of("parameter")), wide), ("Localvariables", variable_table(n.of("local")), wide)]
        rows += [("Submodules", inner, wide), ("ModuleCode", section, wide), ("ModuleDefBlocks", str(len(n.of("layout"))), 16), ("ModuleCodeBlocks", str(len(n.of("code"))), 16)]
        if n.kind != "FrameModule":
            rows.append(mappings)
    return head + "{\n" + indent("\n".join(f"{k:<{w}}: {v}" for k, v, w in rows), STEP) + "}"


#: Roles under which a node's rendering is published; nodes inside an expression are part of their root's.
ROOTS = ("statement", "enter", "active", "exit", "condition", "tail", "enable", "scan_group")


def published(n: Node) -> str | None:
    if n.kind in ("Assignment", "FuncCallStmt", "IfStmt", "TernaryOp") or n.role in ROOTS:
        return expression(n)
    if n.kind == "ParameterMapping":
        return mapping(n)
    if n.kind == "Sequence":
        return chart(n.of("element"))
    return None

"""The one Python stage: source bytes or text to node rows.

A file crosses into Python once; it is decoded, parsed, numbered and rendered
there, and everything after is Catalyst's. Errors are rows, too, unless mode is
FAILFAST.
"""

from __future__ import annotations

import gc
import json
import re
import sys
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import islice, takewhile
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rungwise.functions import coded, markers, render
from rungwise.functions.coded import FormatError
from rungwise.functions.limits import BudgetFault, limited
from rungwise.functions.provenance import SourceMap
from rungwise.operators.parser import parse
from rungwise.operators.scanner import SyntaxFault
from rungwise.operators.shapes import Flat
from rungwise.operators.tree import Node
from rungwise.schema import NODES
from rungwise.session import ship

_NAMES = NODES.fieldNames()
_STRINGS = {"source_id", "role", "kind", "name", "name_key", "literal", "props", "rendered"}
ARROW = pa.schema([(f, pa.string() if f in _STRINGS else pa.int32()) for f in _NAMES])
JSON = json.JSONEncoder(ensure_ascii=False).encode
AROUND = 40
#: New objects after which Python looks for cycles; trees have none, and to look over them again and again is a fifth of the time.
GARBAGE = 100_000
#: Calls that may be open at once: expressions and modules may nest some ten thousand deep.
DEEP = 200_000


@contextmanager
def deep() -> Iterator[None]:
    """Room for texts that nest deeply; beyond it they are an error row."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, DEEP))
    try:
        yield
    finally:
        sys.setrecursionlimit(before)


def text_of(content: bytes) -> str:
    """UTF-8, else code page 1252, else Latin-1; line ends become LF."""
    for encoding in ("utf-8", "cp1252", "latin-1"):
        try:
            return re.sub("\r\n?", "\n", content.decode(encoding))
        except UnicodeDecodeError:
            continue
    raise AssertionError("Latin-1 decodes everything")


def error_row(source_id: str, stage: str, fault: Exception, source: SourceMap | None) -> tuple:
    props: dict = {"stage": stage, "error_class": type(fault).__name__, "message": str(fault)}
    at = line = col = None
    if source is not None and isinstance(fault, SyntaxFault):
        at = source.position(fault.offset) or 0
        line, col = source.line_col(at)
        start = max(source.original.rfind("\n", 0, at) + 1, at - AROUND)
        end = source.original.find("\n", at)
        end = min(end if end >= 0 else len(source.original), at + AROUND)
        props |= {"expected": fault.expected[:12], "context": source.original[start:end], "caret": at - start}
    return (source_id, 0, 0, None, 0, 0, "error", "ParseError", None, None, None, at, at, line, col, json.dumps(props), None)


#: The kind that no node of a tree has.
ERRORS = frozenset(("ParseError",))
#: Kinds that have a path of module names, and kinds of a chart's elements.
MODULES = frozenset(("BasePicture", "SingleModule", "FrameModule", "ModuleTypeInstance"))
CHART = frozenset(("InitStep", "Step", "Transition", "TransitionSub", "Subsequence", "Alternative", "Parallel", "Fork", "Break"))


def facts_of(n: Node, path: tuple[str, ...], module: int | None, owner: str | None, within: int | None) -> dict:
    """A node's own facts, and what views would have to join for: a module's path and the module type it stands in, the kind of module that declares a variable or maps a parameter, the module whose code holds an element, the folded spelling of names that others are found by."""
    more: dict = {}
    if n.kind in MODULES:
        more["path"] = path
        if within is not None:
            more["within"] = within
    if n.kind == "ModuleTypeInstance":
        more["type_key"] = n.props["type"].casefold()
    elif n.kind in CHART:
        more["module"] = module
        if n.kind == "Fork":
            more["target_keys"] = [x.casefold() for x in n.props["targets"]]
    elif n.kind == "Variable":
        more["owner"] = owner
        if (key := n.props["type"].casefold()) not in render.BUILT_IN:
            more["type_key"] = key
    elif n.kind == "ParameterMapping":
        more["owner"] = owner
        if (source := n.of("source")) and source[0].kind == "VarRef":
            more["source_name"] = source[0].name
    return n.props | more


def columns_of(source_id: str, tree: Node, source: SourceMap, kinds: frozenset[str] | None = None, rendered: bool = True, wanted: Iterable[str] = _NAMES) -> dict[str, list]:
    """The tree in pre-order, positions in the original text, as columns; with `kinds`, rows of these only, numbered as in the whole tree."""
    out: dict[str, list] = {c: [] for c in wanted}
    puts = [(out[c].append, _NAMES.index(c)) for c in out]
    ends = out.get("subtree_end")
    seen = 0

    def visit(n: Node, parent: int | None, depth: int, ordinal: int, path: tuple[str, ...], module: int | None, owner: str | None, within: int | None) -> None:
        nonlocal seen
        me, place = seen, None
        seen += 1
        if n.kind in MODULES:
            path = (*path, n.name)
        elif n.kind == "ModuleCode":
            module = parent
        elif n.kind == "ModuleTypeDef":
            within = me
        if kinds is None or n.kind in kinds:
            start, end = source.node(n.start, n.end)
            line, col = source.line_col(start)
            facts = facts_of(n, path, module, owner, within)
            if n.kind == "BinOp":
                facts["own_end"] = source.node(n.start, n.kids[1].end)[1]  # end is that of the whole chain
            props = JSON(facts) if facts else None
            row = (source_id, me, me, parent, depth, ordinal, n.role, n.kind, n.name, n.name.casefold() if n.name is not None else None, n.literal, start, end, line, col, props, render.published(n) if rendered else None)
            place = len(ends) if ends is not None else None
            for put, k in puts:
                put(row[k])
        kids = n.kids
        k = 0
        while k < len(kids):
            kid = kids[k]
            if type(kid) is Flat:
                run = [kid]
                run += takewhile(lambda x: type(x) is Flat and x.shape is kid.shape and x.role == kid.role, islice(kids, k + 1, None))  # noqa: B023
                flat_rows(out, source_id, run, source, kinds, rendered, (seen, me, depth + 1, k))
                seen += len(run) * len(kid.shape.nodes)
                k += len(run)
            else:
                visit(kid, me, depth + 1, k, path, module, n.kind, within)
                k += 1
        if place is not None:
            ends[place] = seen - 1

    visit(tree, None, 0, 0, (), None, None, None)
    return out


def flat_rows(out: dict[str, list], source_id: str, run: list[Flat], source: SourceMap, kinds: frozenset[str] | None, rendered: bool, at: tuple[int, int, int, int]) -> None:
    """Adds the rows of assignments that follow each other and have one shape; `at` is the first one's number, its parent, depth and ordinal."""
    shape, (first, parent, depth, ordinal) = run[0].shape, at
    picked = shape.picked(kinds)
    if not picked:
        return
    nodes, size, times = [shape.nodes[k] for k in picked], len(shape.nodes), len(run)
    found = [x.found for x in run]
    numbers = range(first, first + times * size, size)

    def texts(which: int) -> list[str | None]:
        words = [n[which] for n in nodes]
        of = itemgetter(*words) if len(words) > 1 else lambda x: (x[words[0]],)
        return [t for m in found for t in of(m.groups() + shape.consts)]

    def spans() -> list[tuple[int, int]]:
        words = [(n[8] + 1, n[9] + 1) for n in nodes]
        if source.identity:
            return [(m.start(a), m.end(b)) for m in found for a, b in words]
        return [source.node(m.start(a), m.end(b)) for m in found for a, b in words]

    def props() -> list[str | None]:
        if all(isinstance(n[10], dict) for n in nodes):
            return [JSON(n[10]) if n[10] else None for n in nodes] * times
        held = [(None if not n[10] else JSON(n[10])) if isinstance(n[10], dict) else (n[8] + 1, n[10] + 1) for n in nodes]
        end = (lambda m, a, b: m.end(b)) if source.identity else lambda m, a, b: source.node(m.start(a), m.end(b))[1]
        return [f'{{"own_end": {end(m, *h)}}}' if type(h) is tuple else h for m in found for h in held]

    names = texts(6) if "name" in out or "name_key" in out else None
    places = spans() if not out.keys().isdisjoint(("start", "end", "line", "col")) else None
    lines = [source.line_col(a) for a, _ in places] if "line" in out or "col" in out else None
    make = {
        "source_id": lambda: [source_id] * (times * len(nodes)),
        "node_id": lambda: [b + k for b in numbers for k in picked],
        "subtree_end": lambda: [b + n[5] for b in numbers for n in nodes],
        "parent_id": lambda: [b + n[4] if n[4] >= 0 else parent for b in numbers for n in nodes],
        "depth": lambda: [depth + n[2] for n in nodes] * times,
        "ordinal": lambda: [n[3] if n[4] >= 0 else ordinal + k for k in range(times) for n in nodes],
        "role": lambda: [n[1] if n[4] >= 0 else run[0].role for n in nodes] * times,
        "kind": lambda: [n[0] for n in nodes] * times,
        "name": lambda: names,
        "name_key": lambda: [x.casefold() if x is not None else None for x in names],
        "literal": lambda: texts(7),
        "start": lambda: [a for a, _ in places],
        "end": lambda: [b for _, b in places],
        "line": lambda: [x for x, _ in lines],
        "col": lambda: [x for _, x in lines],
        "props": props,
        "rendered": lambda: [shape.rendered(m) if rendered and n[4] < 0 else None for m in found for n in nodes],
    }
    for c, values in out.items():
        values.extend(make[c]())


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


Decode = Callable[[str], tuple[SourceMap, list[str], bool]]
Read = Callable[[str], Node]


def built(source_id: str, content: bytes | str | None, build: Callable[[str, Node, SourceMap], Iterable[tuple]], decode: Decode = markers.prepared, read: Read = parse) -> Iterable[tuple]:
    """The rows that a tree-builder gives for a source's tree, none if it can't be decoded or parsed."""
    try:
        text = coded.decode(content) if isinstance(content, bytes) and content.startswith(coded.MARK) else text_of(content) if isinstance(content, bytes) else content or ""
        source, _, _ = decode(text)
        with deep():
            return list(build(source_id, read(source.normalized), source))
    except (SyntaxFault, FormatError, RecursionError, BudgetFault):
        return []


def parse_source(source_id: str, content: bytes | str | None, decode: Decode = markers.prepared, failfast: bool = False, kinds: frozenset[str] | None = None, rendered: bool = True, budget: int | None = None, read: Read | None = None) -> list[tuple]:
    """All rows of one source: its nodes, or one error row. Null content is an empty text. `budget` is the steps a source may take, decoding and parsing each."""
    return list(zip(*parse_columns(source_id, content, decode, failfast, kinds, rendered, budget, read).values(), strict=True))


def parse_columns(source_id: str, content: bytes | str | None, decode: Decode = markers.prepared, failfast: bool = False, kinds: frozenset[str] | None = None, rendered: bool = True, budget: int | None = None, read: Read | None = None, wanted: Iterable[str] = _NAMES) -> dict[str, list]:
    """What parse_source() gives, by column."""
    stage, source = "decode", None
    try:
        form = "plain"
        if isinstance(content, bytes) and content.startswith(coded.MARK):
            form, text = "coded", coded.decode(content)
        else:
            text = text_of(content) if isinstance(content, bytes) else content or ""
        with limited(budget):
            source, repairs, compressed = decode(text)
        stage = "parse"
        with deep():
            tree = read(source.normalized) if read else parse(source.normalized, budget)
            tree.props |= {"format": "compressed" if compressed else form, "repairs": repairs, "repair_kinds": [markers.KINDS.get(r) for r in repairs]}
            return {c: [] for c in wanted} if kinds == ERRORS else columns_of(source_id, tree, source, kinds, rendered, wanted)
    except (SyntaxFault, FormatError, RecursionError, BudgetFault) as fault:
        if failfast:
            raise
        row = dict(zip(_NAMES, error_row(source_id, stage, fault, source), strict=True))
        return {c: [row[c]] for c in wanted}


def parse_sources(sources: DataFrame, source_id: str = "source_id", content: str = "content", mode: str = "PERMISSIVE", batch_rows: int = 20_000, kinds: Iterable[str] | None = None, rendered: bool = True, decode: Decode = markers.prepared, budget: int | None = None, read: Read | None = None, keep: Iterable[str] = (), columns: Iterable[str] | None = None) -> DataFrame:
    """The node relation of a table of sources, `content` being binary or text.

    No shuffle: partitions are the scan's. A batch leaves the stage as soon as it
    holds `batch_rows` rows, so memory is bounded by the largest single file.
    With `kinds`, only nodes of these kinds (and errors) leave the stage; without `rendered`,
    no text for people is made. `decode` is another preparation of texts, `read` another parser. A source
    that takes more than `budget` steps is an error row of class BudgetFault, and the next one goes on.
    Columns of `sources` named in `keep` stand in each of a source's rows, so that few rows need no join with their sources.
    Of the node relation only `columns` are made, all if None.
    """
    ship(sources.sparkSession)
    keep, wanted = tuple(keep), [c for c in _NAMES if columns is None or c in columns]
    out = T.StructType([*(NODES[c] for c in wanted), *(sources.schema[c] for c in keep)])
    schema = to_arrow_schema(out)
    kinds = None if kinds is None else frozenset(kinds)
    failfast = mode.upper() == "FAILFAST"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in schema]
        gc.set_threshold(GARBAGE)

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(held, schema, strict=True)], schema=schema)
            for c in held:
                c.clear()
            return made

        for batch in batches:
            for key, data, *more in zip(*batch.columns, strict=True):
                found = parse_columns(key.as_py(), data.as_py(), decode, failfast, kinds, rendered, budget, read, wanted)
                for c, values in zip(held, found.values(), strict=False):
                    c.extend(values)
                for c, value in zip(held[len(wanted) :], more, strict=True):
                    c.extend([value.as_py()] * (len(held[0]) - len(c)))
                if len(held[0]) >= batch_rows:
                    yield batch_of()
        if held[0]:
            yield batch_of()

    named = sources.select(F.coalesce(F.col(source_id).cast("string"), F.lit("")).alias("source_id"), F.col(content).alias("content"), *(F.col(c).alias(f"kept_{k}") for k, c in enumerate(keep)))
    return named.mapInArrow(run, out)

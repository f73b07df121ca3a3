"""Names followed through types, records and charts, against walks of the same trees."""

import random
from collections import Counter

from pyspark.sql import functions as F

from rungwise.operators.stage import parse_sources
from rungwise.plans import compat, resolve, roundtrip
from rungwise.plans.roundtrip import INVOKE, LAYOUT, PLACE
from tests.test_parser import code, program

INSTANCE = "source_id string, content string"


def nodes_of(spark, texts):
    return parse_sources(spark.createDataFrame(list(texts.items()), INSTANCE), rendered=False)


def types_text(held, roots):
    """held: the types that each type's body holds an instance of."""
    types = "".join(f"T{t} = MODULEDEFINITION DateCode_ 1\n" + ("SUBMODULES\n" + "".join(f"I{n}{INVOKE}t{u};\n" for n, u in enumerate(us)) if us else "") + LAYOUT + "ENDDEF;\n" for t, us in held.items())
    return program("TYPEDEFINITIONS\n" + types + "SUBMODULES\n" + "".join(f"R{n}{INVOKE}T{u};\n" for n, u in enumerate(roots)))


def walk(held, path, depth, t, around):
    cycle = t in around
    yield (tuple(path), depth, t in held, cycle)
    if t in held and not cycle:
        for n, u in enumerate(held[t]):
            yield from walk(held, [*path, f"I{n}"], depth + 1, u, {*around, t})


def test_instances_inside_types(spark):
    r = random.Random(3)
    texts, want = {}, Counter()
    for k in range(8):
        held = {t: [r.randrange(6) for _ in range(r.randrange(3))] for t in range(5)}  # type 5 is nowhere
        roots = [r.randrange(6) for _ in range(2)]
        texts[str(k)] = types_text(held, roots)
        for n, t in enumerate(roots):
            want.update((str(k), *x) for x in walk(held, ["BasePicture", f"R{n}"], 0, t, set()))
    got = Counter((x.source_id, tuple(x.path), x.depth, x.type_node_id is not None, x.cycle) for x in resolve.instance_tree(nodes_of(spark, texts)).collect())
    assert got == want
    assert resolve.instance_tree(nodes_of(spark, {})).count() == 0


def test_modules_between_types(spark):
    """An instance inside a module inside a type has the module in its path."""
    inner = f"SUBMODULES\nM{INVOKE}MODULEDEFINITION DateCode_ 1\nSUBMODULES\nDeep{INVOKE}Leaf;\nENDDEF (*M*);\n"
    text = program(f"TYPEDEFINITIONS\nOuter = MODULEDEFINITION DateCode_ 1\n{inner}{LAYOUT}ENDDEF;\nLeaf = MODULEDEFINITION DateCode_ 1\n{LAYOUT}ENDDEF;\nSUBMODULES\nTop{INVOKE}Outer;\n")
    assert {"/".join(x.path) for x in resolve.instance_tree(nodes_of(spark, {"a": text})).collect()} == {"BasePicture/Top", "BasePicture/Top/M/Deep"}


def test_paths_through_records(spark):
    text = program(
        "TYPEDEFINITIONS\nÄußeres = RECORD DateCode_ 1\nNext: ÄUSSERES;\nLeaf: real;\nENDDEF;\nLOCALVARIABLES\nA: äusseres;\nB: integer;\n",
        code="ModuleCode\nEQUATIONBLOCK E" + PLACE + ":\nA.Next.NEXT.leaf = B + A.Leaf.More + C.x + B.y + A.next.Gone;\n",
    )
    got = {x.name: (x.levels, x.found, x.datatype, x.missing) for x in resolve.dotted_paths(nodes_of(spark, {"a": text})).collect()}
    assert got == {
        "A.Next.NEXT.leaf": (4, 4, "real", None), "B": (1, 1, "integer", None), "A.Leaf.More": (3, 2, "real", "more"), "C.x": (2, 0, None, "c"), "B.y": (2, 1, "integer", "y"), "A.next.Gone": (3, 2, "ÄUSSERES", "gone"),
    }
    assert resolve.dotted_paths(nodes_of(spark, {})).count() == 0


class Chart:
    """A random chart: its text, and its elements as (kind, name, bodies, targets)."""

    def __init__(self, seed):
        self.r, self.n, self.names = random.Random(seed), 0, [f"S{k}" for k in range(12)]
        self.body = self.make(0)

    def make(self, depth):
        return [self.element(depth) for _ in range(self.r.randrange(1 if depth == 0 else 0, 5))]

    def element(self, depth):
        kind = self.r.choice(["Step"] * 5 + ["Transition", "Fork", "Break"] + ["Alternative", "Parallel", "Subsequence", "TransitionSub"] * (depth < 3))
        self.n += 1
        if kind in ("Alternative", "Parallel"):
            return kind, None, [self.make(depth + 1) for _ in range(self.r.choice((2, 3)))], ()
        if kind in ("Subsequence", "TransitionSub"):
            return kind, f"C{self.n}", [self.make(depth + 1)], ()
        if kind == "Fork":
            return kind, None, [], tuple(self.r.sample([f"S{k}" for k in range(12)], 2))
        if kind == "Break":
            return kind, None, [], ()
        return kind, self.names.pop() if kind == "Step" and self.names and self.r.random() < 0.5 else f"N{self.n}", [], ()

    def text(self, body):
        out = []
        for kind, name, bodies, targets in body:
            if kind in ("Alternative", "Parallel"):
                word = kind.upper()
                out.append(f"{word}SEQ {f' {word}BRANCH '.join(self.text(b) for b in bodies)} END{word}")
            elif kind in ("Subsequence", "TransitionSub"):
                word = "SUBSEQUENCE" if kind == "Subsequence" else "SUBSEQTRANSITION"
                out.append(f"{word} {name} {self.text(bodies[0])} END{word}")
            else:
                out.append({"Step": f"SEQSTEP {name}", "Transition": f"SEQTRANSITION {name} WAIT_FOR A", "Fork": f"SEQFORK {', '.join(t.lower() for t in targets)}", "Break": "SEQBREAK"}[kind])
        return "\n".join(out)

    def flow(self):
        """Reached elements and left containers by going round until nothing is new."""
        reached, left, entered = set(), set(), {id(self.body[0])}
        steps = {}

        def index(body):
            for e in body:
                if e[0] == "Step":
                    steps.setdefault(e[1], []).append(e)
                for b in e[2]:
                    index(b)

        index(self.body)

        def leaves(e):
            if e[0] in ("Fork", "Break"):
                return False
            return id(e) in left if e[2] else True

        def run(body):
            live = False
            for e in body:
                live = live or id(e) in entered
                if live:
                    reached.add(id(e))
                    entered.update(id(b[0]) for b in e[2] if b)
                    if e[0] == "Fork":
                        entered.update(id(s) for t in e[3] for s in steps.get(t, []))
                ends = [run(b) if b else id(e) in reached for b in e[2]]
                if e[2] and (all(ends) if e[0] == "Parallel" else any(ends)):
                    left.add(id(e))
                    live = True
                live = live and leaves(e)
            return live

        before = -1
        while before != len(reached) + len(left) + len(entered):
            before = len(reached) + len(left) + len(entered)
            run(self.body)
        return reached

    def named(self, body, reached):
        for e in body:
            if e[1]:
                yield e[1], id(e) in reached
            for b in e[2]:
                yield from self.named(b, reached)


def test_reach_in_random_charts(spark):
    charts = {str(k): Chart(k) for k in (5, 11)}
    texts = {k: code(f"X{k} = 1;").replace("EQUATIONBLOCK", f"SEQUENCE Main{PLACE}\n{c.text(c.body)}\nENDSEQUENCE\nEQUATIONBLOCK", 1) for k, c in charts.items()}
    nodes = nodes_of(spark, texts)
    assert nodes.filter("kind = 'ParseError'").count() == 0
    got = Counter((x.source_id, x.name, x.reached) for x in resolve.reached(nodes).filter("name IS NOT NULL").collect())
    want = Counter((k, *x) for k, c in charts.items() for x in c.named(c.body, c.flow()))
    assert got == want
    assert resolve.reached(nodes_of(spark, {})).count() == 0


def test_rounds_leave_out_modules_that_are_done(spark, monkeypatch):
    chart = "SEQUENCE Main{}\n{}\nENDSEQUENCE\n"
    forked = "SEQFORK A1 SEQSTEP A0 SEQFORK A2 SEQSTEP A1 SEQFORK A0 SEQSTEP A2"
    texts = {str(k): code("X = 1;").replace("EQUATIONBLOCK", chart.format(PLACE, forked if k == 3 else "SEQSTEP A SEQSTEP B") + "EQUATIONBLOCK", 1) for k in range(20)}
    nodes, written = nodes_of(spark, texts).persist(), []
    monkeypatch.setattr(resolve, "checkpointed", lambda df, real=resolve.checkpointed: (lambda out: (written.append(out.count()), out)[1])(real(df)))
    got = {(x.source_id, x.name) for x in resolve.reached(nodes).filter("reached AND kind = 'Step'").collect()}
    assert got == {(str(k), x) for k in range(20) if k != 3 for x in "AB"} | {("3", f"A{x}") for x in range(3)}
    assert written[0] >= 19 * 2 + 6 and len(written) > 2 and max(written[1:]) < 12  # the charts without a fork are done after one round


def test_done_charts_are_gathered(spark, monkeypatch):
    monkeypatch.setattr(resolve, "GATHER", 2)
    jumps = "\n".join(f"SEQSTEP A{k} SEQFORK A{k + 1}" for k in range(0, 6))
    texts = {str(n): code("X = 1;").replace("EQUATIONBLOCK", f"SEQUENCE Main{PLACE}\n" + jumps.replace(f"SEQFORK A{n}", "SEQBREAK") + "\nENDSEQUENCE\nEQUATIONBLOCK", 1) for n in (1, 3, 5)}
    got = {(x.source_id, x.name) for x in resolve.reached(nodes_of(spark, texts)).filter("reached AND kind = 'Step'").collect()}
    assert got == {(str(n), f"A{k}") for n in (1, 3, 5) for k in range(n)}


def test_programs_are_dealt_over_all_cores(spark):
    rows = spark.range(3000).selectExpr("id", "id div 10 AS part")
    made = roundtrip.sources(rows, ["part"], "id", F.concat(F.lit("V"), F.col("id").cast("string"), F.lit(": integer;")), ("LOCALVARIABLES\n", "\n"))
    parsed = parse_sources(made, kinds=("Variable",), rendered=False)
    assert parsed.groupBy(F.spark_partition_id()).count().count() >= 3 * spark.sparkContext.defaultParallelism
    assert parsed.count() == 3000


def test_compat_of_errors_and_empty_tables(spark):
    found = compat.compat(nodes_of(spark, {"a": "no program"})).collect()
    assert [(x.kind, x.kept) for x in found] == [("ParseError", True)]
    assert compat.losses(compat.compat(nodes_of(spark, {}))).count() == 0

"""Texts over many tasks against scans of the whole text."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rungwise.functions import markers
from rungwise.plans import huge, positions

ALPHABET = ["(*", "*)", '"', '""', "(", "*", ")", "a", "\n", "é", "(*)", "𝄞"]
TEXT = st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join)


def state_after(text):
    state = huge.OPEN
    for _, mark in huge.marks(text, "", ""):
        state = huge.after(state, mark)
    return state


@given(TEXT, st.integers(1, 5))
@settings(max_examples=500, deadline=None)
def test_effects_compose_to_that_of_the_whole(text, size):
    chunks = [text[k : k + size] for k in range(0, len(text), size)]
    around = [("".join(chunks[:k])[-2:], (chunks[k + 1 : k + 2] or [""])[0][:1]) for k in range(len(chunks))]
    parts = [huge.effect(c, *a) for c, a in zip(chunks, around, strict=True)]
    total = [huge.OPEN, huge.STRING, 0]
    for e in parts:
        total = huge.composed(total, e)
    for start in range(-1, 6):
        one = start
        for e in parts:
            one = huge.applied(e, one)
        by_marks = start
        for _, mark in huge.marks(text, "", ""):
            by_marks = huge.after(by_marks, mark)
        assert huge.applied(total, start) == one == by_marks == huge.applied(huge.effect(text), start)


@given(st.lists(TEXT, min_size=3, max_size=3))
@settings(max_examples=200, deadline=None)
def test_composing_is_associative(texts):
    a, b, c = map(huge.effect, texts)
    left, right = huge.composed(huge.composed(a, b), c), huge.composed(a, huge.composed(b, c))
    assert all(huge.applied(left, s) == huge.applied(right, s) for s in range(-1, 30))


@pytest.fixture(scope="module")
def shared(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("huge")))
    return spark


@pytest.mark.parametrize(("size", "fan"), [(1, 3), (3, 2), (7, 256), (10**6, 256)])
def test_regions_and_lines_are_those_of_a_whole_scan(shared, monkeypatch, size, fan):
    monkeypatch.setattr(huge, "FAN", fan)
    r = random.Random(size)
    texts = {k: "".join(r.choice(ALPHABET) for _ in range(r.randrange(60))) for k in range(120)}
    texts |= {500: "", 501: None, 502: "\n", 503: '"', 504: '""', 505: "(*" * 30, 506: "x\n\ny", 507: '"a""', 508: '(* " *) "(* "'}
    df = shared.createDataFrame(list(texts.items()), "k long, text string").repartition(3)
    chunks = huge.chunks_of(df, "k", size=size)
    got = {}
    for x in huge.opaque(chunks, "k").collect():
        got.setdefault(x.k, []).append((x.kind, x.start, x.end))
    for k, t in texts.items():
        assert sorted(got.get(k, []), key=lambda x: x[1]) == list(markers.opaque(t or "")), t
    want = sorted(map(tuple, positions.lines(df, "k").collect()))
    assert sorted(map(tuple, huge.lines(chunks, "k").collect())) == want


def test_chunks_of_files(shared, tmp_path):
    body = "".join(f'line {i} "s {i}" (* {i}\n{i} *)\n' for i in range(3000))
    (tmp_path / "a.txt").write_text(body)
    (tmp_path / "b.txt").write_text("x\n")
    before = shared.conf.get("spark.sql.files.maxPartitionBytes")
    shared.conf.set("spark.sql.files.maxPartitionBytes", "9000b")
    try:
        chunks = huge.read_chunks(shared, str(tmp_path), size=1000).persist()
        assert chunks.count() > 100 and chunks.filter(F.col("source_id").endswith("a.txt")).select("part.block").distinct().count() > 5
        got = {(x.kind, x.start, x.end) for x in huge.opaque(chunks, "source_id").filter(F.col("source_id").endswith("a.txt")).collect()}
        assert got == set(markers.opaque(body))
        assert huge.lines(chunks, "source_id").count() == body.count("\n") + 1 + 2
    finally:
        shared.conf.set("spark.sql.files.maxPartitionBytes", before)


@given(TEXT, st.sampled_from(["", '"', "*", "(", "(*", "*)", "a*"]), st.sampled_from(["", '"', "*", ")", "a"]))
@settings(max_examples=500, deadline=None)
def test_thin_chunks_have_the_marks_of_whole_ones(text, before, following):
    thin, gaps = huge.thin(text)
    at = huge.places_in(thin, gaps)
    assert len(thin) <= len(text) == at[-1] and len(gaps) == thin.count(" ")
    assert [(at[k], mark) for k, mark in huge.marks(thin, before, following)] == list(huge.marks(text, before, following))
    for state in (huge.OPEN, huge.STRING, 1, 2):
        moved = [(kind, a if a is None else at[a], b if b is None else at[b - 1] + 1) for kind, a, b in huge.pieces(thin, before, following, state)]
        assert moved == list(huge.pieces(text, before, following, state))


def test_no_text_is_moved(shared):
    df = shared.createDataFrame([(1, "a" * 5000 + '"b" (* c *)'), (2, "x" * 3000)], "k long, text string")
    chunks = huge.chunks_of(df, "k", size=100)
    plan = huge.marked(chunks, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert sorted(tuple(x) for x in huge.marked(chunks, "k").select("k", "n", "start", "total").collect()) == [(1, 50, 5000, 5011)]
    assert sorted(tuple(x) for x in huge.opaque(chunks, "k").collect()) == [(1, "C", 5004, 5011), (1, "S", 5000, 5003)]

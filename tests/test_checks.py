"""Documents, summaries and robustness runs."""

import re

import pytest

from rungwise.functions.coded import encode
from rungwise.functions.markers import compress
from rungwise.operators import checks

from tests.test_parser import code, program


@pytest.fixture(scope="module")
def made(spark):
    text = program("LOCALVARIABLES\nA: integer := 1; Bee: boolean;\n")
    rows = [("plain", text.encode()), ("packed", compress(text).encode()), ("coded", encode(text.replace("\n", "\r"))), ("bad", encode("x")[:-1]), ("mark", ("#zz " * 60).encode()), ("broken", code("A = ;").encode()), ("null", None)]
    return spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in rows], "source_id string, content binary")


def test_documents(made):
    got = {r.source_id: r for r in checks.documents(made).collect()}
    assert {k: r.format for k, r in got.items() if not r.error} == {"plain": "plain", "packed": "compressed", "coded": "coded", "broken": "plain", "null": "plain"}
    assert {k for k, r in got.items() if r.error} == {"bad", "mark"} and got["plain"].char_map is None and got["null"].normalized == ""
    packed = got["packed"]
    assert packed.normalized.split() == got["plain"].normalized.split() and len(packed.char_map) == len(packed.normalized)
    assert all(at < 0 or packed.original[at] == c for at, c in zip(packed.char_map, packed.normalized, strict=True))
    own = checks.documents(made.filter("source_id = 'mark'"), table={"#zz": "zed"}).collect()[0]
    assert own.normalized.split() == ["zed"] * 60


def test_summaries(made):
    got = {r.source_id: r.summary for r in checks.summaries(made).collect()}
    spanless = {k: re.sub(r"SourceSpan\([^)]*\)", "", v) for k, v in got.items() if v}
    assert spanless["plain"] == spanless["packed"] == got["coded"] and got["broken"] is None
    assert "Name: 'A'   , Datatype: <Simple_DataType.INTEGER: 'integer'>, Global: False" in got["plain"] and "ModuleDefBlocks" in got["plain"]


def test_runs(made):
    found = checks.runs(made)
    assert {r.source_id: r.error_class for r in found.collect()} == {"plain": None, "packed": None, "coded": None, "bad": "FormatError", "mark": "FormatError", "broken": "SyntaxFault", "null": "SyntaxFault"}
    assert checks.crashes(found).count() == 0 and checks.slow(found).count() == 0


def test_random_texts_never_crash_the_engine(spark):
    texts = checks.random_sources(spark, 300, seed=0, length=400)
    assert [r.content for r in texts.orderBy("source_id").collect()] == [r.content for r in checks.random_sources(spark, 300, 0, 400).orderBy("source_id").collect()]
    assert all(len(r.content) == 400 for r in texts.collect())
    assert checks.crashes(checks.runs(texts)).count() == 0
    deep = spark.createDataFrame([("deep", code("A = " + "(" * 5000 + "1" + ")" * 5000 + ";"))], "source_id string, content string")
    assert [r.error_class for r in checks.runs(deep).collect()] == [None]

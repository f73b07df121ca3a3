"""The file format, the table function and budgets of steps."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from rungwise.functions import markers
from rungwise.functions.coded import encode
from rungwise.functions.limits import BudgetFault, limited
from rungwise.operators import checks
from rungwise.operators.parser import parse
from rungwise.operators.stage import parse_source, parse_sources
from rungwise.plans import forms
from rungwise.sources import format, sql
from tests.test_parser import code


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("programs")
    (out / "deep").mkdir()
    for k in range(40):
        text = forms.SHOWN.replace("{k}", str(k))
        where = out / "deep" if k % 2 else out
        (where / f"p{k}.s").write_bytes(encode(text.replace("\n", "\r")) if k % 5 == 0 else markers.compress(text).encode() if k % 5 == 1 else text.encode())
    (out / "broken.s").write_text("no program")
    (out / "notes.txt").write_text("no source")
    return str(out)


def load(spark, folder, **options):
    return spark.read.format("program").options(path=folder, **options).load()


def test_format_reads_all_files(spark, folder):
    format.register(spark)
    nodes = load(spark, folder, rendered="false")
    counts = Counter(r.kind for r in nodes.select("kind").collect())
    assert counts["Program"] == 40 and counts["ParseError"] == 1 and counts["Variable"] == 160
    few = load(spark, folder, kinds="Variable")
    assert Counter(r.kind for r in few.select("kind").collect()) == {"Variable": 160, "ParseError": 1}
    assert load(spark, folder, glob="p1*.s", kinds="Program").count() == 11
    # filtered and unfiltered queries of one load don't meet
    assert nodes.filter("kind = 'Program'").count() == 40 and nodes.filter("kind = 'Variable'").count() == 160


def test_filters_reach_the_reader(spark, folder, capsys):
    format.register(spark)
    found = load(spark, folder, pushdown="true").filter("kind = 'Variable' AND source_id LIKE '%7.s'")
    found.explain("formatted")
    assert "PushedFilters: [StringEndsWith(source_id,7.s)]" in capsys.readouterr().out
    assert {r.source_id.rsplit("/", 1)[1] for r in found.select("source_id").collect()} == {"p7.s", "p17.s", "p27.s", "p37.s"}


def test_small_files_share_a_partition():
    sizes = [("large", 100), *((f"s{k}", 1) for k in range(50))]
    out = format.packed(sizes, most=60 + 11 * format.OPENING)
    assert sorted(x for p in out for x in p) == sorted(x for x, _ in sizes) and out[0][0] == "large" and len(out) < 8
    assert format.packed([], 10) == []


def test_table_function(spark):
    rows = [(k, forms.SHOWN.replace("{k}", str(k))) for k in range(5)] + [(9, "no program"), (10, None)]
    spark.createDataFrame(rows, "id int, content string").createOrReplaceTempView("program_texts")
    sql.register(spark)
    got = spark.sql("SELECT source_id, kind, name, line, props FROM parse_program(TABLE(program_texts), kinds => 'Variable,DataType', source_id => 'id')")
    want = parse_sources(spark.table("program_texts"), source_id="id", kinds=("Variable", "DataType"), rendered=False).select(got.columns)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    with pytest.raises(Exception, match="no column source_id"):
        spark.sql("SELECT * FROM parse_program(TABLE(program_texts))").collect()


def names(source_id, tree, positions):
    return [(source_id, n.name, positions.spans(n)[2]) for n in tree.walk() if n.kind == "Variable"]


def test_a_tree_builder_of_ones_own(spark):
    spark.createDataFrame([("a", forms.SHOWN.replace("{k}", "4")), ("b", "broken")], "source_id string, content string").createOrReplaceTempView("built_texts")
    sql.register(spark, "variable_names", names, "source_id string, name string, line int")
    assert [tuple(r) for r in spark.sql("SELECT * FROM variable_names(TABLE(built_texts)) ORDER BY line").collect()] == [("a", "Part4", 7), ("a", "Whole", 8), ("a", "At4", 11), ("a", "None4", 12)]


def shouted(text):
    tree = parse(text)
    tree.name = tree.name.upper()
    return tree


def test_a_parser_of_ones_own(spark):
    made = spark.createDataFrame([("a", forms.SHOWN.replace("{k}", "4"))], "source_id string, content string")
    assert [r.name for r in parse_sources(made.withColumn("content", F.replace("content", F.lit("name: P"), F.lit("name: p"))), kinds=("Program",), read=shouted).collect()] == ["P4"]


def test_a_hostile_source_costs_its_budget_only(spark):
    long = code("A = " + " + ".join(["1"] * 3000) + ";")
    assert parse_source("s", long, budget=1000)[0][7] == "ParseError"
    assert len(parse_source("s", long, budget=100_000)) > 3000
    found = checks.runs(spark.createDataFrame([("ok", code("A = 1;")), ("long", long), ("also", code("B = 2;"))], "source_id string, content string"), budget=1000)
    assert {r.source_id: r.error_class for r in found.collect()} == {"ok": None, "long": "BudgetFault", "also": None}
    with pytest.raises(BudgetFault), limited(50):
        markers.expand("ENDIF " * 1000)
    markers.expand("ENDIF " * 1000)


@pytest.mark.parametrize(("raw", "text"), [("f(g(a, ), b, )", "f(g(a, 0), b, )"), ("f(a), g(b, )", "f(a), g(b, 0)"), ("f(a, b,)\n( ,)", "f(a, b, 0)\n( ,)"), ("é(a, )", "é(a, )"), ("x f(, ) (a, ) y(b,  \n)", "x f(, 0) (a, ) y(b, 0)")])
def test_trailing_arguments(raw, text):
    assert markers.expand(raw)[0].normalized == text
    assert markers.REPAIRS[-1].pattern.sub(r"\1(\2, 0)", raw) == text

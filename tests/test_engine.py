"""The engine on Spark: files in, relations out, every query against its SQL."""

import duckdb
import pytest

from rungwise.functions.coded import encode
from rungwise.functions.decoding import text_of
from rungwise.functions.markers import compress
from rungwise.operators.stage import parse_sources
from rungwise.plans import queries as q
from rungwise.plans import views
from rungwise.sources import program as files
from rungwise.streaming.watch import keep_nodes, stream_nodes

from tests.test_parser import code, program

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("programs")
    (top / "valid").mkdir()
    (top / "invalid").mkdir()
    text = program("LOCALVARIABLES\nA: integer;\n")
    (top / "valid/plain.s").write_text(text)
    (top / "valid/packed.s").write_text(compress(text))
    (top / "valid/coded.s").write_bytes(encode(text.replace("\n", "\r")))
    (top / "invalid/broken.s").write_text(code("A = ;"))
    (top / "notes.txt").write_text("no program")
    return str(top)


def test_files_of_all_formats(spark, folder):
    found = files.corpus(spark, folder)
    assert found.count() == 4 and found.filter("coded").count() == 1
    assert files.corpus(spark, folder, 2).count() == 2
    nodes = parse_sources(found)
    assert sorted(r["format"] for r in views.programs(nodes).collect()) == ["coded", "compressed", "plain"]
    assert views.variables(nodes).count() == 3
    assert [r["error_class"] for r in views.parse_errors(nodes).collect()] == ["SyntaxFault"]
    assert files.load_text(found).filter("text is not null").count() == 4


def test_failfast(spark, folder):
    with pytest.raises(Exception, match="expected"):
        parse_sources(files.corpus(spark, folder), mode="FAILFAST").count()


def test_nodes_as_parquet_and_as_a_stream(spark, folder, tmp_path):
    nodes = parse_sources(files.corpus(spark, folder))
    files.write_nodes(nodes, str(tmp_path / "nodes"))
    again = files.read_nodes(spark, str(tmp_path / "nodes"))
    assert again.count() == nodes.count()
    plan = again.filter("kind = 'Variable'").select("name")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan
    stream = keep_nodes(stream_nodes(spark, folder + "/valid"), str(tmp_path / "out"), str(tmp_path / "mark"))
    stream.awaitTermination(120)
    assert views.variables(spark.read.parquet(str(tmp_path / "out"))).count() == 3


def test_encodings_on_the_jvm(spark):
    cases = {"é\r\nx".encode(): "é\nx", "é€".encode("cp1252"): "é€", b"\x81\xe9\r": "\x81é\n", b"": ""}
    rows = spark.createDataFrame([(bytearray(k),) for k in cases], "content binary")
    assert [r[0] for r in rows.select(text_of(rows.content)).collect()] == list(cases.values())


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


def plain(rows):
    return sorted(repr([round(v, 6) if isinstance(v, float) else float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", [*q.queries()])
def test_query_gives_what_sql_gives(spark, tables, name):
    frame = q.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert plain(tuple(r) for r in frame.select(columns).collect()) == plain(tables.sql(f"SELECT {quoted} FROM ({q.oracle_sql()[name]})").fetchall())


def test_empty_tables(spark):
    none = spark.createDataFrame([], "source_id string, content string")
    nodes = parse_sources(none)
    assert nodes.count() == 0 and views.chart_edges(nodes).count() == 0 and views.module_paths(nodes).count() == 0


def test_entry():
    import __spark_entry__

    assert set(q.queries()) <= set(__spark_entry__.queries()) and set(q.queries()) == set(q.oracle_sql())

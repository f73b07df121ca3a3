"""Queries against their SQL on rows that the driver's small tables don't have."""

import re

import duckdb
import pytest

from rungwise.plans import huge, queries


def agrees(spark, folder, name: str, **tables: str) -> None:
    """The query's rows are its SQL's, each table being made by an SQL text."""
    db = duckdb.connect()
    for key, sql in tables.items():
        db.execute(f"COPY ({sql}) TO '{folder}/{key}.parquet' (FORMAT parquet)")
        db.execute(f"CREATE VIEW {key} AS FROM '{folder}/{key}.parquet'")
    frame = queries.queries()[name](spark, str(folder))
    columns = ", ".join(f'"{c}"' for c in frame.columns)
    wanted = db.execute(f"SELECT {columns} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, frame.collect()))) == sorted(map(str, wanted))


def test_corner_names_of_long_keys(spark, tmp_path):
    agrees(spark, tmp_path, "corner_names", supplier="SELECT unnest([7, 10, 60000, 12345678901])::BIGINT AS s_suppkey")


@pytest.mark.parametrize("rows", [1, 5, 150])
def test_compressed_lists_of_any_length(spark, tmp_path, rows):
    agrees(spark, tmp_path, "rt_compressed", customer=f"SELECT i::BIGINT AS c_custkey, 3::INT AS c_nationkey, 'Customer#' || i AS c_name, i * (-1.25)::DOUBLE AS c_acctbal FROM range({rows}) t(i)")


def test_small_tables_are_parsed_on_all_cores(spark, tmp_path):
    duckdb.connect().execute(f"COPY (SELECT i::BIGINT AS o_orderkey FROM range(40) t(i)) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    for name in ("rt_marker_errors", "parse_failures"):
        plan = queries.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan, name


def test_marker_errors(spark, tmp_path):
    agrees(spark, tmp_path, "rt_marker_errors", orders="SELECT i::BIGINT AS o_orderkey FROM range(40) t(i)")


def test_marker_positions_move_no_text_with_names(spark, tmp_path):
    agrees(spark, tmp_path, "rt_marker_positions", orders="SELECT i * 37::BIGINT AS o_orderkey FROM range(40) t(i)")
    plan = queries.queries()["rt_marker_positions"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"line#\d+ = line#\d+", plan)


def test_groups_of_chunks_take_no_call_each(spark):
    rows = spark.createDataFrame([(k, n) for k in (None, 1, 2) for n in range(300)], "k int, n long")
    found = huge._grouped(rows, "k", lambda group, held: {"n": [group], "size": [len(held["n"])], "sorted": [held["n"] == sorted(held["n"])]}, "n long, size int, sorted boolean")
    assert "FlatMapGroups" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [(k, n, size, True) for k in (None, 1, 2) for n, size in ((0, 256), (1, 44))]))


def test_marker_errors_make_their_programs_once(spark, tmp_path):
    duckdb.connect().execute(f"COPY (SELECT i::BIGINT AS o_orderkey FROM range(40) t(i)) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    plan = queries.queries()["rt_marker_errors"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("ArrowEvalPython") == 1


def test_statements_and_expressions_make_no_column_in_vain(spark, tmp_path):
    rows = "SELECT i // 7::BIGINT AS l_orderkey, i::BIGINT % 7 AS l_linenumber, i * 1.25::DOUBLE AS l_extendedprice, i % 11 / 100::DOUBLE AS l_discount FROM range(1500) t(i)"
    for name in ("rt_statements", "expression_shape"):
        agrees(spark, tmp_path, name, lineitem=rows)
        plan = queries.queries()[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert "name_key" not in plan and "JsonToStructs" not in plan and "from_json" not in plan, name

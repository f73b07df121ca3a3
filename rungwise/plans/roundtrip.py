"""Table rows as program text, in Spark SQL.

These programs feed the engine's own path (decode, parse, flatten, view), so a
query's answer can be compared with SQL over the table the text was made from.
A program holds a bounded number of rows, so no group grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.functions.coded import encode
from rungwise.functions.markers import compress

#: Rows in a program.
PER_PROGRAM = 200
HEAD = '"Syntax version 2.23, date: 2026-01-01-00:00:00.000 N"\n"Original file date: ---"\n"Program date: 2026-01-01-00:00:00.000, name: '
ROOT = '"\nBasePicture Invocation ( 0.0 , 0.0 , 0.0 , 1.0 , 1.0 ) : MODULEDEFINITION DateCode_ 1\n'
LAYOUT = "ModuleDef\nClippingBounds = ( -1.0 , -1.0 ) ( 1.0 , 1.0 )\n"
END = "ENDDEF (*BasePicture*);\n"
PLACE = " COORD 0.0, 0.0 OBJSIZE 1.0, 1.0 "
INVOKE = " Invocation ( 0.0 , 0.0 , 0.0 , 1.0 , 1.0 ) : "


def quoted(text: Column) -> Column:
    """A string literal: quotes doubled, line ends as spaces."""
    return F.concat(F.lit('"'), F.replace(F.regexp_replace(text, r"[\r\n]", " "), F.lit('"'), F.lit('""')), F.lit('"'))


def real(number: Column) -> Column:
    """A double in full, always with a point or exponent."""
    return number.cast("string")


def block(key: Column) -> Column:
    """The program a row goes into."""
    return F.floor(key / PER_PROGRAM).cast("long")


def tasks(spark: SparkSession) -> int:
    """Four tasks a core, or as many as the session's shuffles have."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows that become programs, over tasks(): to parse one costs far more than to move it, and a small file would be one task."""
    return rows.repartition(tasks(rows.sparkSession), *keys)


def joined(order: Column | str, line: Column, sep: str = "\n") -> Column:
    """Aggregate: the lines of a program in order."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o") if isinstance(order, str) else order.alias("o"), line.alias("x"))))
    return F.array_join(pairs["x"], sep)


def program(name: Column, sections: Column, layout: Column | None = None) -> Column:
    return F.concat(F.lit(HEAD), name, F.lit(ROOT), sections, F.lit(LAYOUT), layout if layout is not None else F.lit(""), F.lit(END))


def sources(rows: DataFrame, by: list[str], order: str, line: Column, around: tuple[str, str] = ("", ""), in_layout: bool = False) -> DataFrame:
    """source_id, content: one program for each value of `by`, their rows dealt as dealt() does: left to itself Spark joins tasks until each has rows enough, and rows are small against what it takes to parse them."""
    name = F.concat_ws("-", *by)
    grouped = dealt(rows, *by).groupBy(*by).agg(joined(order, line).alias("lines")).select(name.alias("source_id"), F.concat(F.lit(around[0]), "lines", F.lit(around[1])).alias("lines"))
    text = program(F.col("source_id"), F.lit(""), F.col("lines")) if in_layout else program(F.col("source_id"), F.col("lines"))
    return grouped.select("source_id", text.alias("content"))


def as_markers(made: DataFrame) -> DataFrame:
    """The same programs in marker text."""
    from rungwise.session import ship

    ship(made.sparkSession)
    squeeze = F.pandas_udf(lambda s: s.map(compress), "string")
    return made.select("source_id", squeeze("content").alias("content"))


def as_coded(made: DataFrame) -> DataFrame:
    """The same programs as coded streams; the text must be ASCII."""
    from rungwise.session import ship

    ship(made.sparkSession)
    code = F.pandas_udf(lambda s: s.str.replace("\n", "\r").map(encode), "binary")
    return made.select("source_id", code("content").alias("content"))

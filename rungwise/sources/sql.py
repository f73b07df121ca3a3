"""The parser as a table function in SQL.

    sql.register(spark)
    SELECT name, line FROM parse_program(TABLE(sources), kinds => 'Variable,DataType')

The table has a column `content`, text or binary, and one named source_id, or whichever is named by `source_id =>`. A
function of one's own takes another tree-builder: `register(spark, "names", build, "source_id string, name string")`, where build(source_id, tree, positions) gives rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BinaryType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from rungwise.operators.stage import built, parse_source
from rungwise.schema import NODES
from rungwise.session import ship

Build = Callable[..., Iterable[tuple]]


def function(build: Build | None = None, schema: StructType = NODES) -> type:
    """The table function's class, for nodes or for the rows a tree-builder gives."""

    class ParseProgram:
        @staticmethod
        def analyze(sources: AnalyzeArgument, kinds: AnalyzeArgument | None = None, source_id: AnalyzeArgument | None = None, rendered: AnalyzeArgument | None = None) -> AnalyzeResult:
            if not sources.isTable:
                raise ValueError("the first argument must be TABLE(...)")
            key = source_id.value if source_id is not None else "source_id"
            names = sources.dataType.fieldNames()
            for name in (key, "content"):
                if name not in names:
                    raise ValueError(f"the table has no column {name}; it has {', '.join(names)}")
            if not isinstance(sources.dataType["content"].dataType, StringType | BinaryType):
                raise ValueError("content must be text or binary")
            return AnalyzeResult(schema)

        def eval(self, sources: Row, kinds: str | None = None, source_id: str = "source_id", rendered: bool = False) -> Iterator[tuple]:
            key, content = sources[source_id], sources["content"]
            content = bytes(content) if isinstance(content, bytearray) else content
            name = "" if key is None else str(key)
            if build is not None:
                yield from built(name, content, build)
                return
            asked = frozenset(k.strip() for k in kinds.split(",")) if kinds else None
            yield from parse_source(name, content, kinds=asked, rendered=rendered)

    return ParseProgram


def register(spark: SparkSession, name: str = "parse_program", build: Build | None = None, schema: str | None = None) -> None:
    """Makes the function known to a session's SQL."""
    ship(spark)
    rows = NODES if schema is None else StructType.fromDDL(schema)
    spark.udtf.register(name, udtf(function(build, rows)))

"""`spark.read.format("program")`: files as node rows, of which only what is asked for is parsed and kept.

    format.register(spark)
    spark.read.format("program").option("path", "/data/programs").option("kinds", "Variable,DataType").load()

Files are packed into partitions by bytes, so many small ones share a task. Kinds that aren't asked for never leave the
parser. With the option `pushdown` filters on `kind` and on `source_id` reach the reader, too, so
other files are never opened; Spark 4.1 then holds on to the filters of a loaded DataFrame's first query, so each
query needs a load() of its own. The
folder is reached by pyarrow's file systems (a local or mounted path, hdfs, s3, gs); for stores that only Spark reads take
`sources.program.read_sources`.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from rungwise.operators.stage import batch_of, parse_source
from rungwise.schema import NODES
from rungwise.session import ship

#: Bytes of files in a partition, and what opening a file counts as.
PARTITION, OPENING = 16 << 20, 64 << 10


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(len(paths))
        self.paths = paths


def packed(sizes: Iterable[tuple[str, int]], most: int) -> list[list[str]]:
    """Paths dealt to partitions of `most` bytes, large files first, each to the partition opened last that has room; a larger file has one of its own."""
    out: list[list[str]] = []
    room = 0
    for path, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        cost = size + OPENING
        if not out or cost > room:
            out.append([])
            room = most
        out[-1].append(path)
        room -= cost
    return out


class ProgramReader(DataSourceReader):
    def __init__(self, path: str, glob: str, most: int, rendered: bool, kinds: frozenset[str] | None = None):
        self.path, self.glob, self.most, self.rendered, self.kinds = path, glob, most, rendered, kinds
        self.checks: list[Filter] = []

    def asks(self, path: str) -> bool:
        tests = {EqualTo: lambda v: path == v, In: lambda v: path in v, StringStartsWith: path.startswith, StringEndsWith: path.endswith, StringContains: lambda v: v in path}
        return all(tests[type(f)](f.value) for f in self.checks)

    def partitions(self) -> Sequence[InputPartition]:
        store, root = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        sizes = [(x.path, x.size) for x in found if x.type == fs.FileType.File and fnmatch.fnmatch(x.base_name, self.glob) and self.asks(x.path)]
        return [Files(p) for p in packed(sizes, self.most)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        held: list[tuple] = []
        for path in getattr(partition, "paths", ()):
            with store.open_input_stream(path) as stream:
                held += parse_source(path, stream.read(), kinds=self.kinds, rendered=self.rendered)
            if len(held) >= 20_000:
                yield batch_of(held)
                held = []
        if held:
            yield batch_of(held)


class PushedReader(ProgramReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes filters on kind and on source_id, gives back the others. Errors of a file are kept whatever kind is asked for, so those on kind are Spark's, too."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("kind",) and isinstance(f, EqualTo | In):
                asked = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                self.kinds = asked if self.kinds is None else self.kinds & asked
            elif column == ("source_id",) and isinstance(f, EqualTo | In | StringStartsWith | StringEndsWith | StringContains):
                self.checks.append(f)
                continue
            yield f


class ProgramSource(DataSource):
    """Options: path; glob (*.s); kinds (all; errors always come); partitionBytes; rendered (true); pushdown (false)."""

    @classmethod
    def name(cls) -> str:
        return "program"

    def schema(self) -> StructType:
        return NODES

    def reader(self, schema: StructType) -> DataSourceReader:
        path = self.options.get("path")
        if not path:
            raise ValueError("a program source needs a path")
        path = path if "://" in path or path.startswith("/") else fs.LocalFileSystem().normalize_path(path)
        kinds = self.options.get("kinds")
        asked = frozenset(k.strip() for k in kinds.split(",")) if kinds else None
        reader = PushedReader if self.options.get("pushdown", "false").lower() == "true" else ProgramReader
        return reader(path, self.options.get("glob", "*.s"), int(self.options.get("partitionBytes", PARTITION)), self.options.get("rendered", "true").lower() == "true", asked)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ProgramSource)

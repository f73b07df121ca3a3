"""Program files as a DataFrame, and the node relation as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.functions.decoding import is_coded

#: Sub-folders of a test corpus.
CORPUS_PARTS = ("valid", "invalid", "edge_cases", "semantic")


def read_sources(spark: SparkSession, path: str | list[str], glob: str | None = None, recursive: bool = True) -> DataFrame:
    """source_id (the path), length, content, coded. The format is found from content, never from the file's name."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    return files.select(F.col("path").alias("source_id"), "length", "content", is_coded(F.col("content")).alias("coded"))


def load_text(sources: DataFrame) -> DataFrame:
    """source_id and text of files of any wire format, decoded and with markers expanded, without provenance; null where that fails."""
    from rungwise.operators.checks import documents

    return documents(sources).select("source_id", F.col("normalized").alias("text"))


def corpus(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """The files of a corpus with the part each stands in, in path order, the first `most` if given."""
    files = read_sources(spark, path, "*.s").withColumn("part", F.element_at(F.split("source_id", "/"), -2))
    files = files.filter(F.col("part").isin(*CORPUS_PARTS)).orderBy("source_id")
    return files if most is None else files.limit(most)


def write_nodes(nodes: DataFrame, path: str, mode: str = "error") -> None:
    """Node rows as Parquet by kind, so that a view reads its own kinds only."""
    nodes.write.mode(mode).partitionBy("kind").parquet(path)


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)

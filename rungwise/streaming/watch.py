"""Program files as a stream: a folder is watched and every new file parsed once. The stage keeps no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rungwise.operators.stage import parse_sources

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_nodes(spark: SparkSession, path: str, glob: str = "*.s", files_per_trigger: int = 1000) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return parse_sources(files.select(F.col("path").alias("source_id"), "content"))


def keep_nodes(nodes: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends the stream's rows to Parquet by kind; the checkpoint makes each file count once."""
    writer = nodes.writeStream.format("parquet").partitionBy("kind").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()

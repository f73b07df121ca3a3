"""Offsets, lines and anchors as relations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from rungwise.functions.provenance import line_starts
from rungwise.plans.asof import as_of, filled
from rungwise.session import ship

#: Lines that leave the stage together.
LINES = 100_000


def lines(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, line, start, length for every line of every text; only LF ends a line, null text counts as empty. One pass over each text, no shuffle."""
    ship(texts.sparkSession)
    kind = to_arrow_type(texts.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                body = batch.column(1)[row].as_py()
                starts = line_starts(body)
                sizes = np.diff(np.append(starts, len(body) + 1)) - 1
                for k in range(0, len(starts), LINES):
                    n = len(starts[k : k + LINES])
                    own = batch.column(0).take(pa.array(np.full(n, row)))
                    yield pa.RecordBatch.from_arrays([own.cast(kind), *(pa.array(x.astype(np.int32)) for x in (np.arange(k + 1, k + 1 + n), starts[k : k + LINES], sizes[k : k + LINES]))], names=[key, "line", "start", "length"])

    schema = T.StructType([texts.schema[key], *(T.StructField(c, T.IntegerType()) for c in ("line", "start", "length"))])
    return texts.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("body")).mapInArrow(run, schema)


def line_of(offsets: DataFrame, texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """offsets (key, at) with 1-based line and col, as an as-of look-up in the starts of lines. Offsets of no text are left out."""
    asked = offsets.select(key, F.col("at").cast("int").alias("at"))
    starts = lines(texts.join(asked.select(key).distinct(), key, "left_semi"), key, text)
    found = as_of(asked, starts.select(key, F.col("start").alias("at"), F.struct("line", "start").alias("begun")), key, "at", "begun")
    return found.filter("begun IS NOT NULL").select(key, "at", F.col("begun.line").alias("line"), (F.col("at") - F.col("begun.start") + 1).alias("col"))


def anchors(places: DataFrame, key: str, at: str = "at", real: str = "real") -> DataFrame:
    """As-of look-up: each place's own original offset or, where it has none, that of the last place before it, 0 before any."""
    return filled(places.withColumn("anchor", F.col(real)), key, [at], "anchor").withColumn("anchor", F.coalesce("anchor", F.lit(0)))

"""As-of and interval look-ups that no single key can hold up.

Rows are dealt in ranges of (key, place) and sorted, so a key of many rows lies in several
partitions that follow each other. Each is filled by itself; what its first rows need from the partitions before
it is the last value of the same key there, found among one row for each partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from rungwise.session import checkpointed, ship


def fresh(df: DataFrame, name: str) -> str:
    held = {c.lower() for c in df.columns}
    while name in held:
        name += "_"
    return name


def runs(keys: pa.Array) -> np.ndarray:
    """Where each row's run of equal keys starts in a sorted batch; null equals null."""
    codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    new = np.concatenate([[True], codes[1:] != codes[:-1]])
    return np.maximum.accumulate(np.where(new, np.arange(len(codes)), 0))


class Fill:
    """Fills nulls forward over sorted batches of one partition, with the value that came before it."""

    def __init__(self, key=None, value: pa.Scalar | None = None):
        self.key, self.value = key, value

    def batch(self, keys: pa.Array, values: pa.Array) -> pa.Array:
        n = len(keys)
        start = runs(keys)
        last = np.maximum.accumulate(np.where(values.is_valid().to_numpy(zero_copy_only=False), np.arange(n), -1))
        known = last >= start
        carried = ~known & (start == 0) & (self.value is not None and self.key == keys[0].as_py())
        source = pa.concat_arrays([values, pa.array([None if self.value is None else self.value.as_py()], values.type)])
        out = source.take(pa.array(np.where(known, last, np.where(carried, n, -1)), pa.int64(), mask=~known & ~carried))
        self.key, self.value = keys[n - 1].as_py(), out[n - 1] if out[n - 1].is_valid else None
        return out


def filled(df: DataFrame, key: str, order: list[str], value: str, parts: int | None = None) -> DataFrame:
    """df with each null of `value` replaced by the last one before it among rows of its key, in ascending `order` (nulls first); null where there is none.

    Rows that tie in all of `order` are in no fixed order, so values of one place should be told apart by it. Null is a key of its own; repeated rows
    stay; other columns may have any names. `parts` ranges, shuffle partitions if not given: no task gets
    more than a range, however many rows a key has.
    """
    spark = ship(df.sparkSession)
    salt = fresh(df, "salt")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn(salt, F.monotonically_increasing_id()).repartitionByRange(parts, key, *order, salt).sortWithinPartitions(key, *order, salt)
    ranged = checkpointed(ranged.drop(salt))
    kind, key_kind = (to_arrow_type(df.schema[c].dataType) for c in (value, key))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The partition's number, its first and last key, and the last value of the last key."""
        fill, first = Fill(), None
        for batch in batches:
            if batch.num_rows:
                first = first or [batch.column(0)[0].as_py()]
                fill.batch(batch.column(0), batch.column(1))
        if first:
            value = None if fill.value is None else fill.value.as_py()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array(first, key_kind), pa.array([fill.key], key_kind), pa.array([value], kind)], names=["part", "first", "last", "value"])

    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("first", df.schema[key].dataType), T.StructField("last", df.schema[key].dataType), T.StructField("value", df.schema[value].dataType)])
    found = ranged.select(key, value).mapInArrow(ends, schema).collect()  # a row for each partition
    carried: dict[int, tuple] = {}
    last: dict = {}
    for r in sorted(found, key=lambda r: r["part"]):
        if r["first"] in last:
            carried[r["part"]] = r["first"], last[r["first"]]
        if r["value"] is not None:
            last[r["last"]] = r["value"]
    columns = df.columns
    at_key, at_value = columns.index(key), columns.index(value)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = carried.get(TaskContext.get().partitionId())
        state = Fill(before[0], pa.scalar(before[1], kind)) if before else Fill()
        for batch in batches:
            if batch.num_rows:
                held = list(batch.columns)
                held[at_value] = state.batch(held[at_key], held[at_value])
                yield pa.RecordBatch.from_arrays(held, names=columns)

    return ranged.mapInArrow(fill, df.schema)


def as_of(asked: DataFrame, events: DataFrame, key: str, at: str, value: str, parts: int | None = None) -> DataFrame:
    """asked with `value` of the last event (key, at, value) of its key at or before its place; null where there is none.

    Events of one place and null values tie in no fixed order. An asked place of null comes before all others. A column
    of asked that is named like `value` is replaced.
    """
    asked = asked.drop(value)
    side = fresh(asked, "side")
    kind = events.schema[value].dataType
    left = asked.withColumns({value: F.lit(None).cast(kind), side: F.lit(1)})
    right = events.select(F.col(key).cast(asked.schema[key].dataType).alias(key), F.col(at).cast(asked.schema[at].dataType).alias(at), value, F.lit(0).alias(side))
    both = left.unionByName(right, allowMissingColumns=True)
    return filled(both, key, [at, side], value, parts).filter(F.col(side) == 1).drop(side)


def within(asked: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, parts: int | None = None) -> DataFrame:
    """asked with the columns of the interval [start, end) of its key that holds its place, null where none does. Intervals of a key don't overlap."""
    held = fresh(asked, "interval")
    facts = [c for c in intervals.columns if c != key]
    clash = {c.lower() for c in asked.columns} & {c.lower() for c in facts}
    if clash:
        raise ValueError(f"both tables have {', '.join(sorted(clash))}")
    events = intervals.select(key, F.col(start).alias(at), F.struct(*facts).alias(held))
    found = as_of(asked, events, key, at, held, parts)
    inside = F.when(F.col(at) < F.col(held)[end], F.col(held))
    return found.select(*asked.columns, *(inside[c].alias(c) for c in facts))



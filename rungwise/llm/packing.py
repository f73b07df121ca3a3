"""Mixture-controlled packing by deficit round-robin.

Every source is a queue of tokens. A round fills one window: each queue gets
its share of the window, its deficit (the part of a token it is still owed) is
carried into the next round. As documents may be cut, the deficits have a
closed form: after k windows of `width` tokens the first s queues together
have been served

    B(s, k) = floor(k * width * (tokens of the first s queues) / (all tokens))

so queue s has been served Q(s, k) = B(s, k) - B(s-1, k), never a whole token
off its share, and window k holds the queue's tokens Q(s, k) to Q(s, k+1).
Once every document knows where its tokens start in its queue, each partition
works out its pieces alone: deficits carry across windows and partitions
without any task seeing the others' documents.

Sources that get less than a token per window have no quota of their own; they
join the largest queue, in the order of the scan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rungwise.llm.common import cut, ship, small
from rungwise.llm.wordbpe import coder, proof

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenized(df: DataFrame, vocabulary: str, doc_id: str, text: str, source: str) -> DataFrame:
    """part, queue, doc_id, ids (packed, without the end), width, n_tokens (with it), local: tokens of the same queue before the document in its partition."""
    ship(df.sparkSession)
    whole = proof(df.sparkSession, vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = coder(vocabulary, whole.value), {}
        for batch in batches:
            at = 0
            for ids in own.packed(batch.column(3)):
                part, queue, docs = (batch.column(k).slice(at, len(ids)) for k in range(3))
                at += len(ids)
                n = [x // own.width + 1 for x in pc.binary_length(ids).to_pylist()]
                local = []
                for q, m in zip(queue.to_pylist(), n, strict=True):
                    local.append(seen.get(q, 0))
                    seen[q] = local[-1] + m
                yield pa.RecordBatch.from_arrays(
                    [part, queue, docs, ids, pa.array([own.width] * len(n), pa.int32()), pa.array(n, pa.int64()), pa.array(local, pa.int64())],
                    names=["part", "queue", "doc_id", "ids", "width", "n_tokens", "local"],
                )

    rows = df.select(
        F.spark_partition_id().alias("part"),
        F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n")).alias("queue"),
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"),
    )
    return rows.mapInArrow(encode, "part int, queue string, doc_id long, ids binary, width int, n_tokens long, local long")


def quotas(held: DataFrame, width: int) -> DataFrame:
    """part, queue, first (where the part's tokens start in their lane), low and high (tokens of the lanes before, and with, this one), total.

    held: part, queue, tokens. One row per partition and source.
    """
    every = Window.partitionBy()
    sizes = held.groupBy("queue").agg(F.sum("tokens").alias("tokens")).withColumn("total", F.sum("tokens").over(every))
    largest = F.max(F.struct("tokens", "queue")).over(every)["queue"]
    lanes = sizes.select("queue", "total", F.when(F.col("tokens") * width >= F.col("total"), F.col("queue")).otherwise(largest).alias("lane"), "tokens")
    order = Window.orderBy("lane")
    sums = lanes.groupBy("lane", "total").agg(F.sum("tokens").alias("lane_tokens")).withColumn("high", F.sum("lane_tokens").over(order)).withColumn("low", F.col("high") - F.col("lane_tokens"))
    named = held.join(lanes.select("queue", "lane"), "queue")
    place = Window.partitionBy("lane").orderBy("part", "queue").rowsBetween(Window.unboundedPreceding, -1)
    return named.withColumn("first", F.coalesce(F.sum("tokens").over(place), F.lit(0))).join(sums.drop("lane_tokens"), "lane").select("part", "queue", "first", "low", "high", "total")


def served(k: int, low: int, high: int, total: int, width: int) -> int:
    """Tokens of a lane in windows before k."""
    if k * width >= total:
        return high - low
    return k * width * high // total - k * width * low // total


def pieces_of(start: int, length: int, low: int, high: int, total: int, width: int) -> Iterator[tuple[int, int, int, int]]:
    """(start in the document, length, sequence, offset) of a document whose tokens are `start` onwards of the lane."""
    size, last = high - low, (total - 1) // width
    at, end = start, start + length
    k = max(0, min(last, at * total // (size * width)) - 2)
    while served(k + 1, low, high, total, width) <= at:
        k += 1
    while at < end:
        stop = min(end, served(k + 1, low, high, total, width))
        if stop > at:
            lanes_before = served(k + 1, 0, low, total, width) - served(k, 0, low, total, width)
            offset = lanes_before + at - served(k, low, high, total, width)
            if k < last or total % width == 0:
                yield at - start, stop - at, k, offset
            else:
                yield from tail(at - start, stop - at, k, offset, total - k * width)
            at = stop
        k += 1


def tail(start: int, length: int, k: int, offset: int, size: int) -> Iterator[tuple[int, int, int, int]]:
    """The last, partly filled window is cut into sequences of the powers of two that make up its size, so nothing is padded."""
    base, sequence = 0, k
    for bit in range(size.bit_length() - 1, -1, -1):
        if size >> bit & 1:
            a, b = max(offset, base), min(offset + length, base + (1 << bit))
            if a < b:
                yield start + a - offset, b - a, sequence, a - base
            base, sequence = base + (1 << bit), sequence + 1


def pack(df: DataFrame, vocabulary: str, width: int = 4096, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and then end_id; null text counts as empty, so every
    row gives at least one piece, repeated rows and null identifiers included. Null is a
    source of its own. Every window of `width` tokens holds each source in
    proportion to its tokens; the rest that fills no window goes into shorter
    sequences of power-of-two sizes, so no sequence is padded. An empty table gives no rows.
    The ids are written once to the checkpoint folder; nothing but a row per
    partition and source is shuffled, unless that table is too large to broadcast.
    """
    rows = cut(tokenized(df, vocabulary, doc_id, text, source))
    quota = cut(quotas(rows.groupBy("part", "queue").agg(F.sum("n_tokens").alias("tokens")), width))
    placed = rows.join(small(quota), ["part", "queue"]).select("doc_id", "ids", "width", (F.col("first") + F.col("local")).alias("first"), "low", "high", "total")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PIECES.split(", ")]
        for batch in batches:
            doc, ids, size, first, low, high, total = (batch.column(k) for k in range(7))
            out: list[tuple] = []
            rest = zip(doc.to_pylist(), size.to_pylist(), first.to_pylist(), low.to_pylist(), high.to_pylist(), total.to_pylist(), strict=True)
            for n, (d, w, at, lo, hi, all_) in enumerate(rest):
                mine = np.append(np.frombuffer(ids[n].as_buffer(), dtype=f"<u{w}"), [end_id]).astype("<u4")
                view = memoryview(mine).cast("B")
                out += [(d, a, m, zlib.crc32(view[4 * a : 4 * (a + m)]), len(mine), s, o) for a, m, s, o in pieces_of(at, len(mine), lo, hi, all_, width)]
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    return placed.mapInArrow(cut_up, PIECES)

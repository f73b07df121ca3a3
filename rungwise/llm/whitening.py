"""Embedding whitening by a digit-slice product.

Vectors become integers x. With n distinct vectors and their sums S, y = n * x - S is the
centred vector times n, an integer. The product of all y with themselves is exact: y is cut into signed digits of
DIGIT bits, and a float64 BLAS product of two slices of at most ROWS rows stays below 2^53. The products of all pairs of
slices are put together again as big integers, added over a task, merged between tasks in
a tree, and divided by n^3 once: the covariance, correctly rounded. Its eigenvectors are
found on the driver, where the matrix is as large as the square of the dimension, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungwise.llm.common import cut, ship

DIGIT, ROWS = 20, 8192
#: Partial results that are merged in one task.
FAN = 32
#: An eigenvalue of this share of the trace or less counts as zero.
FLAT = 1e-13
PART = "dim int, slot long, n long, width int, data binary"
NAMES = ["dim", "slot", "n", "width", "data"]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, in int64 if that is wide enough, else in Python integers."""
    most = n * max(1, int(max(x.max(), -int(x.min())) if x.size else 1)) + max(map(abs, sums), default=0)
    if most < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def slices(y: np.ndarray) -> list[np.ndarray]:
    """Signed digits of y in base 2^DIGIT, lowest first, as float64."""
    out, half = [], 1 << (DIGIT - 1)
    while y.any():
        digit = ((y + half) & (2 * half - 1)) - half
        out.append(digit.astype(np.float64))
        y = (y - digit) >> DIGIT
    return out


def product(y: np.ndarray) -> np.ndarray:
    """The exact matrix y' y in Python integers."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for start in range(0, len(y), ROWS):
        parts = slices(y[start : start + ROWS])
        for p, a in enumerate(parts):
            for q in range(p, len(parts)):
                both = (a.T @ parts[q]).astype(np.int64).astype(object)
                total += (both if p == q else both + both.T) << DIGIT * (p + q)
    return total


def dump(values: list[int]) -> tuple[int, bytes]:
    """Bytes an integer, and the integers as signed bytes."""
    width = max((v.bit_length() // 8 + 1 for v in values), default=1)
    return width, b"".join(v.to_bytes(width, "little", signed=True) for v in values)


def load(width: int, data: bytes) -> list[int]:
    return [int.from_bytes(data[k : k + width], "little", signed=True) for k in range(0, len(data), width)]


def part_rows(found: dict[int, tuple[int, list[int]]], slot: int) -> pa.RecordBatch:
    dumped = [(dim, slot, n, *dump(values)) for dim, (n, values) in found.items()]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in dumped], kind) for k, kind in enumerate(kinds)], names=NAMES)


def grouped(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """Dimension, rows and integers of the rows of each dimension in each batch."""
    for batch in batches:
        dims = batch.column(column).value_lengths().to_numpy()
        for dim in np.unique(dims):
            part = batch.take(pa.array(np.flatnonzero(dims == dim)))
            yield int(dim), part, part.column(column).flatten().to_numpy().reshape(-1, dim)


def task_sums(fit: DataFrame) -> DataFrame:
    """PART: of each task, number and sums of the vectors of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, list[int]]] = {}
        for dim, _, x in grouped(batches, 0):
            n, sums = found.get(dim, (0, [0] * dim))
            low, high = (x & 0xFFFFFFFF).sum(0).tolist(), (x >> 32).sum(0).tolist()
            found[dim] = n + len(x), [s + a + (b << 32) for s, a, b in zip(sums, low, high, strict=True)]
        yield part_rows(found, TaskContext.get().partitionId())

    return fit.select("x").mapInArrow(run, PART)


def task_products(fit: DataFrame, sums: dict[int, tuple[int, list[int]]]) -> DataFrame:
    """PART: of each task, the products of the centred vectors of each dimension, row after row of the matrix."""
    held = fit.sparkSession.sparkContext.broadcast(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, np.ndarray]] = {}
        for dim, _, x in grouped(batches, 0):
            n, total = found.get(dim, (0, 0))
            found[dim] = n + len(x), total + product(centred(x, *held.value[dim]))
        yield part_rows({dim: (n, total.ravel().tolist()) for dim, (n, total) in found.items()}, TaskContext.get().partitionId())

    return fit.select("x").mapInArrow(run, PART)


def merged(parts: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Sums of the integers of each dimension; FAN tasks' parts are added in one task, level by level, until FAN of a dimension at most are left."""

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        lists = [load(w, d) for w, d in zip(rows.column("width").to_pylist(), rows.column("data").to_pylist(), strict=True)]
        return pa.Table.from_batches([part_rows({key[0].as_py(): (sum(rows.column("n").to_pylist()), [sum(x) for x in zip(*lists, strict=True)])}, key[1].as_py())])

    parts = cut(parts)
    slots = (parts.agg(F.max("slot")).first()[0] or 0) + 1
    while slots > FAN:
        parts = cut(parts.groupBy("dim", F.floor(F.col("slot") / FAN).alias("group")).applyInArrow(add, PART))
        slots = -(-slots // FAN)
    out: dict[int, tuple[int, list[int]]] = {}
    for r in parts.collect():  # FAN rows a dimension
        n, total = out.get(r["dim"], (0, None))
        values = load(r["width"], bytes(r["data"]))
        out[r["dim"]] = n + r["n"], values if total is None else [a + b for a, b in zip(total, values, strict=True)]
    return out


class Model:
    """Of one dimension: n, S, the columns that whiten (a component each, zero for those of no spread), shares of the trace, and how far the whitened covariance is from the identity."""

    def __init__(self, n: int, sums: list[int], products: list[int], most: int):
        dim = len(sums)
        cube = n**3
        spread = np.array([p / cube for p in products]).reshape(dim, dim)
        size, way = np.linalg.eigh(spread)
        size, way = size[::-1][:most], way[:, ::-1][:, :most]
        trace = sum(products[k * (dim + 1)] for k in range(dim)) / cube
        self.n, self.sums, self.trace = n, sums, trace
        self.live = size > FLAT * trace
        self.explained = [float(e / trace) if trace else None for e in size]
        self.to = np.where(self.live, way / np.sqrt(np.where(self.live, size, 1.0)), 0.0)
        held = self.to[:, self.live]
        off = np.abs(held.T @ spread @ held - np.eye(held.shape[1]))
        self.error = float(off.max()) if off.size else None


def whitened(rows: DataFrame, models: dict[int, Model]) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(models)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, part, x in grouped(batches, 1):
            m = held.value[dim]
            y = centred(x, m.n, m.sums)
            most = max(int(y.max()), -int(y.min()))
            if most * most * dim < 1 << 63:
                deviation = (y * y).sum(1).tolist()
            else:
                deviation = [d if d < 1 << 63 else None for d in (y.astype(object) ** 2).sum(1).tolist()]
            out = (y.astype(np.float64) / m.n) @ m.to
            for k in range(out.shape[1]):
                w = pa.array(out[:, k]) if m.live[k] else pa.nulls(len(x), pa.float64())
                same = [pa.array([v] * len(x), kind) for v, kind in ((k + 1, pa.int32()), (m.n, pa.int64()), (m.explained[k], pa.float64()), (m.error, pa.float64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), same[0], same[1], pa.array(deviation, pa.int64()), w, same[2], same[3]], names=names)

    return rows.select("vec_id", "x").mapInArrow(run, schema)


def whiten(df: DataFrame, components: int = 4, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for every vector and component up to `components`.

    Entries become floor(scale * c), held to the range of a long. The fit takes each distinct integer vector once; vectors of
    different dimension are fitted apart, each with as many components as it has dimensions at most. Null vectors and those with a
    null or non-finite entry are left out, empty ones have no component; rows that repeat and null identifiers come out
    row by row; an empty table gives no rows. A component without spread (all of them, of a single
    distinct vector) has whitened null, and identity_error covers the others, null if there is none; explained is null where the trace is zero. A
    deviation beyond a long is null. Other columns of df are not read.
    """
    spark = ship(df.sparkSession)
    v = F.col("v")
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    rows = rows.select("vec_id", F.transform(v, lambda c: F.floor(c * scale)).alias("x"))
    fit = cut(rows.select("x").distinct())
    sums = merged(task_sums(fit))
    products = merged(task_products(fit, sums))
    return whitened(rows, {dim: Model(n, s, products[dim][1], components) for dim, (n, s) in sums.items()})

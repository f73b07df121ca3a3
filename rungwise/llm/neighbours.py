"""Approximate nearest neighbours by stable projections and kd-trees.

Vectors are projected on M Gaussian directions. A Gaussian is 2-stable: the
squared projected distance of two points is their squared distance times a
chi-square variable of M degrees. Candidates are dealt into blocks, each with a
kd-tree over its projected points. A query takes projected neighbours from the
tree in increasing order, leaf after leaf, and verifies them on the original vectors. It stops
once the chance that a point further off in projection is nearer in truth
than its k-th best so far has fallen under 1 - TAU, by the chi-square test.

Space is cut into cells, the leaves of one kd-tree over the projections whose
splits come from a bounded sample; all vectors are dealt to cells, and a cell's rows into
blocks. A query first meets a block of its own cell. The k-th best found there bounds it, and it is
sent on only to cells whose bounding box passes the same test, so what is moved grows with the cells within reach.
Of equal vectors only the k + 1 of smallest identifiers can be among anyone's k nearest, so a
large group of copies is that many rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rungwise.llm.common import cut, ship, small

M, LEAF, TAU = 8, 32, 0.995
BLOCK, GROUP = 4096, 256
#: Rows from which splits are taken, and how many of them a cell holds at least.
SAMPLE, LEAST = 1 << 17, 16
FOUND = "asker long, query_id long, vec_id long, row long, score double"


def directions(dim: int, seed: int = 3) -> np.ndarray:
    """M Gaussian directions, the same on every worker."""
    return np.random.default_rng([seed, dim]).standard_normal((dim, M))


def chi_square(x: float) -> float:
    """Distribution of chi-square with M (even) degrees."""
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, M // 2):
        term *= half / i
        total += term
    return 1 - math.exp(-half) * total


def quantile(p: float) -> float:
    low, high = 0.0, 1e3
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid) < p else (low, mid)
    return high


class Tree:
    """A kd-tree: points halved at the median of the widest axis down to leaves, each with its bounding box."""

    def __init__(self, points: np.ndarray):
        leaves, todo = [], [np.arange(len(points))]
        while todo:
            rows = todo.pop()
            if len(rows) <= LEAF:
                leaves.append(rows)
                continue
            own = points[rows]
            axis = int(np.argmax(own.max(0) - own.min(0)))
            order = np.argpartition(own[:, axis], len(rows) // 2)
            todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
        self.leaves = leaves
        self.low = np.array([points[r].min(0) for r in leaves])
        self.high = np.array([points[r].max(0) for r in leaves])

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Squared distance of q to every leaf's box."""
        gap = np.maximum(0.0, np.maximum(self.low - q, q - self.high))
        return (gap * gap).sum(1)


class Cells:
    """A complete kd-tree of `depth` levels, split at the medians of a sample, widest axis first; its leaves are numbered cells."""

    def __init__(self, points: np.ndarray, n: int):
        self.depth = max(0, min(math.ceil(math.log2(max(1, n / BLOCK))), int(math.log2(max(1, len(points) // LEAST)))))
        inner = (1 << self.depth) - 1
        self.axis, self.cut = np.zeros(inner, np.int64), np.zeros(inner)
        held = {0: points}
        for node in range(inner):
            own = held.pop(node)
            axis = int(np.argmax(own.max(0) - own.min(0))) if len(own) else 0
            cut = float(np.median(own[:, axis])) if len(own) else 0.0
            self.axis[node], self.cut[node] = axis, cut
            over = own[:, axis] > cut
            held[2 * node + 1], held[2 * node + 2] = own[~over], own[over]

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        node, every = np.zeros(len(points), np.int64), np.arange(len(points))
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[every, self.axis[node]] > self.cut[node])
        return node - ((1 << self.depth) - 1)


def search(ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, queries: np.ndarray, askers: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Place among the queries, identifiers, rows and distances of the k nearest of each query in one block, its own row left out."""
    way = directions(vectors.shape[1])
    tree, reach = Tree(vectors @ way), quantile(TAU)
    for place, (q, own, asker, bound) in enumerate(zip(queries, queries @ way, askers, bounds, strict=True)):
        boxes = tree.distances(own)
        best, at = np.zeros(0), np.zeros(0, np.int64)
        slack = 1e-9 * float(own @ own)  # copies of one vector may be projected a rounding apart
        for leaf in np.argsort(boxes, kind="stable"):
            worst = min(bound, best[k - 1] if len(best) >= k else np.inf)
            if boxes[leaf] > reach * worst * worst + slack:
                break
            here = tree.leaves[leaf]
            here = here[rows[here] != asker]
            gap = vectors[here] - q
            best, at = np.concatenate([best, np.sqrt((gap * gap).sum(1))]), np.concatenate([at, here])
            order = np.lexsort((rows[at], ids[at], best))[:k]
            best, at = best[order], at[order]
        yield place, ids[at], rows[at], best


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id, v (doubles), dim of the rows whose vector is neither null, empty, all zero nor holds a null or a number that isn't finite."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)).withColumn("dim", F.size("v"))


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def by_dim(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The batch's rows of each dimension."""
    dims = batch.column(column).to_numpy()
    for dim in np.unique(dims):
        yield int(dim), batch.take(pa.array(np.flatnonzero(dims == dim)))


def projected(rows: DataFrame) -> DataFrame:
    """dim, p of the rows' vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, part in (x for batch in batches for x in by_dim(batch, 0)):
            p = matrix(part.column(1), dim) @ directions(dim)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in p], pa.binary())], names=["dim", "p"])

    return rows.select("dim", "v").mapInArrow(run, "dim int, p binary")


def dealt(rows: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    """row, vec_id, dim, v, cell, p of rows."""
    held = rows.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, part in (x for batch in batches for x in by_dim(batch, 2)):
            p = matrix(part.column(3), dim) @ directions(dim)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, M), pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(4)), pa.array(held.value[dim].of(p)), flat], names=["row", "vec_id", "dim", "v", "cell", "p"])

    return rows.select("row", "vec_id", "dim", "v").mapInArrow(run, "row long, vec_id long, dim int, v array<double>, cell long, p array<double>")


def packed(rows: DataFrame, by: list[str], bound: bool = False) -> DataFrame:
    """One row for each value of the keys (dim first): identifiers, row numbers, vectors and bounds, packed."""

    def run(key: tuple, block: pa.Table) -> pa.Table:
        block = block.combine_chunks().sort_by("row")
        flat = block.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        data = [block.column("vec_id").to_numpy(), block.column("row").to_numpy(), np.asarray(flat, np.float64), block.column("bound").to_numpy() if bound else np.zeros(0)]
        keys = {name: pa.array([x.as_py()], pa.int64()) for name, x in zip(by, key, strict=True)}
        return pa.table(keys | {name: pa.array([x.tobytes()], pa.binary()) for name, x in zip(("ids", "rows", "data", "bounds"), data, strict=True)})

    return rows.groupBy(*by).applyInArrow(run, ", ".join(f"{x} long" for x in by) + ", ids binary, rows binary, data binary, bounds binary")


def met(asked: DataFrame, stored: DataFrame, k: int) -> DataFrame:
    """What queries, rows (row, vec_id, dim, v, bound, cell, sub), find in their blocks. At most GROUP of a block's queries meet it at once."""
    place = ["dim", "cell", "sub"]
    load = asked.groupBy(*place).agg(F.ceil(F.count("*") / GROUP).alias("chunks"))
    chunked = asked.join(load, place).withColumn("chunk", F.pmod(F.xxhash64("row", F.lit(2)), F.col("chunks")))
    questions = packed(chunked.drop("chunks"), [*place, "chunk"], bound=True).select(*place, *(F.col(x).alias(f"q_{x}") for x in ("ids", "rows", "data", "bounds")))
    both = questions.join(stored.drop("bounds"), place).select("dim", "ids", "rows", "data", "q_ids", "q_rows", "q_data", "q_bounds")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, rows, q_ids, q_rows = (np.frombuffer(r[x], np.int64) for x in ("ids", "rows", "q_ids", "q_rows"))
                vectors, queries = (np.frombuffer(r[x]).reshape(-1, r["dim"]) for x in ("data", "q_data"))
                out = [(np.full(len(d), q_rows[n]), np.full(len(d), q_ids[n]), v, w, d) for n, v, w, d in search(ids, rows, vectors, queries, q_rows, np.frombuffer(r["q_bounds"]), k)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["asker", "query_id", "vec_id", "row", "score"])

    return both.mapInArrow(run, FOUND)


def reached(asked: DataFrame, boxes: dict[int, tuple]) -> DataFrame:
    """A row of each query (row, vec_id, dim, v, bound, own) for every block of every cell within its reach, but for the one it has met."""
    held = asked.sparkSession.sparkContext.broadcast(boxes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = quantile(TAU)
        for dim, part in (x for batch in batches for x in by_dim(batch, 2)):
            cells, low, high, subs = held.value[dim]
            p = matrix(part.column(3), dim) @ directions(dim)
            bound, own = part.column(4).to_numpy(), part.column(5).to_numpy()
            for n, q in enumerate(p):
                gap = np.maximum(0.0, np.maximum(low - q, q - high))
                near = np.flatnonzero((gap * gap).sum(1) <= reach * bound[n] * bound[n] + 1e-9 * float(q @ q))
                cell = np.repeat(cells[near], subs[near])
                sub = np.arange(len(cell)) - np.repeat(np.cumsum(subs[near]) - subs[near], subs[near])
                other = ~((cell == own[n]) & (sub == 0))
                rows = pa.array(np.full(int(other.sum()), n))
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(rows) for k in range(5)), pa.array(cell[other]), pa.array(sub[other])], names=["row", "vec_id", "dim", "v", "bound", "cell", "sub"])

    return asked.select("row", "vec_id", "dim", "v", "bound", "own").mapInArrow(run, "row long, vec_id long, dim int, v array<double>, bound double, cell long, sub long")


def nearest(df: DataFrame, every: int = 100, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found by Euclidean distance for each query.

    Queries are the rows whose vec_id is divisible by `every`; candidates all rows but the
    query's own, also others of its identifier. Ties go to the smaller vec_id; repeated rows count
    each, as queries too. Rows of a null identifier and vectors that
    are null, empty, zero or not finite take no part; vectors meet only those
    of their own dimension. A query without candidates gives no rows, nor does an empty table.
    """
    spark = ship(df.sparkSession)
    rows = cut(usable(df, vec_id, vector).withColumn("row", F.monotonically_increasing_id()))
    copies = Window.partitionBy("dim", F.xxhash64("v"), F.xxhash64("v", F.lit(1))).orderBy("vec_id", "row")
    stored = cut(rows.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).drop("copy"))
    sizes = {r["dim"]: r["n"] for r in stored.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    most = max(sizes.values(), default=1)
    sample = projected(stored.filter(F.pmod(F.xxhash64("row", F.lit(5)), F.lit(max(1, most // SAMPLE))) == 0)).groupBy("dim").agg(F.collect_list("p").alias("p"))
    points = {r["dim"]: np.frombuffer(b"".join(r["p"])).reshape(-1, M) for r in sample.collect()}
    cells = {dim: Cells(points.get(dim, np.zeros((0, M))), n) for dim, n in sizes.items()}
    placed = cut(dealt(stored, cells))
    edges = [f(F.col("p")[j]).alias(f"{name}{j}") for name, f in (("low", F.min), ("high", F.max)) for j in range(M)]
    found = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / (2 * BLOCK)).alias("subs"), *edges).collect()  # a row per cell, SAMPLE / LEAST at most
    boxes = {}
    for dim in sizes:
        mine = [r for r in found if r["dim"] == dim]
        boxes[dim] = tuple(np.array(x) for x in ([r["cell"] for r in mine], [[r[f"low{j}"] for j in range(M)] for r in mine], [[r[f"high{j}"] for j in range(M)] for r in mine], [r["subs"] for r in mine]))
    subs = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / (2 * BLOCK)).alias("subs"))
    split = placed.join(small(cut(subs)), ["dim", "cell"]).withColumn("sub", F.pmod(F.xxhash64("row", F.lit(1)), F.col("subs")))
    stored = cut(packed(split.select("dim", "cell", "sub", "row", "vec_id", "v"), ["dim", "cell", "sub"]))
    none = F.lit(float("inf"))
    asked = cut(dealt(rows.filter(F.col("vec_id") % every == 0), cells).drop("p"))
    first = cut(met(asked.withColumns({"bound": none, "sub": F.lit(0).cast("long")}), stored, k))
    kth = first.groupBy("asker").agg(F.count("*").alias("n"), F.max("score").alias("bound")).filter(F.col("n") == k).select(F.col("asker").alias("row"), "bound")
    bounded = asked.withColumnRenamed("cell", "own").join(kth, "row", "left").withColumn("bound", F.coalesce("bound", none))
    out = first.unionByName(met(cut(reached(bounded, boxes)), stored, k))
    best = Window.partitionBy("asker").orderBy("score", "vec_id", "row")
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

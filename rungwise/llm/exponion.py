"""Centroid clustering over integers by Exponion search.

A vector keeps an upper bound of its distance to its centroid and a lower bound
of that to all others. Each round the bounds give way by what the centroids moved. A vector
whose upper bound lies strictly under the lower one, or under half the distance from its centroid to
the next, stays where it is. Any other scans the centroids inside a ball around its
current centroid, of radius twice its distance plus that centroid's distance to its nearest neighbour, read off lists of
centroids sorted by distance from each centroid. Nothing outside that ball can be its nearest or
second nearest; the radius counts as inside, so ties are seen and go to the smaller number.

Vectors lie packed in blocks that are written once, dealt by block number. A round writes only the
blocks' numbers and bounds, 20 bytes a vector, and what each task has summed.
Sums are exact: they travel in limbs of 32 bits and are divided as integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungwise.llm.common import cut, cut_by, ship

BLOCK = 4096
#: Vectors of integers whose length is surely under this have squared distances that are exact in float64.
EXACT = 1 << 25
SLACK = 1e-12
STATE = "block long, state binary, cluster int, limb int, n long, sums array<long>"


def within(most: float, width: int) -> bool:
    """Whether `width` components of this size at most make a vector shorter than EXACT."""
    return most * (math.isqrt(max(0, width - 1)) + 1) < EXACT


def integers(v: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * v): float64 that holds integers if all are small, else Python integers."""
    with np.errstate(over="ignore"):
        x = np.floor(v * scale)
    if not x.size or within(np.abs(x).max(), v.shape[1]):
        return x + 0.0
    return np.array([math.floor(Fraction(c) * scale) for c in v.ravel().tolist()], object).reshape(v.shape)


class Centroids:
    """k centroids of integers, with the sorted lists of distances between them. `before` are those of the round before."""

    def __init__(self, rows: list[tuple[int, ...]], before: Centroids | None = None):
        self.rows, self.k = rows, len(rows)
        width = len(rows[0])
        self.small = within(max(abs(c) for r in rows for c in r), width)
        self.at = np.array(rows, np.float64 if self.small else object).reshape(self.k, width)
        if not self.small:
            return
        self.squares = (self.at * self.at).sum(1)
        between = np.sqrt(np.maximum(0.0, self.squares[:, None] - 2 * self.at @ self.at.T + self.squares))
        self.order = np.argsort(between, axis=1, kind="stable")
        self.near = np.take_along_axis(between, self.order, 1)
        self.next = self.near[:, 1] if self.k > 1 else np.full(1, np.inf)
        self.moved, self.others = np.zeros(self.k), np.zeros(self.k)
        if before is not None and before.small:
            gap = self.at - before.at
            self.moved = np.sqrt((gap * gap).sum(1))
            if self.k > 1:
                top = np.argsort(self.moved)
                self.others = np.where(np.arange(self.k) == top[-1], self.moved[top[-2]], self.moved[top[-1]])


def exactly(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and squared distance by Python integers, all centroids tried."""
    best, at = np.zeros(len(x), np.int64), np.zeros(len(x), object)
    for n, row in enumerate(x):
        squares = [sum(int(d) ** 2 for d in row - other) for other in c]
        at[n] = min(squares)
        best[n] = squares.index(at[n])
    return best, at


def own_distance(x: np.ndarray, number: np.ndarray, c: Centroids) -> np.ndarray:
    gap = x - c.at[number]
    return (gap * gap).sum(1)


def search(x: np.ndarray, number: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids) -> int:
    """Brings the three arrays up to date with the centroids; how many distances to centroids were worked out."""
    upper[:] = (upper + c.moved[number]) * (1 + SLACK)
    lower[:] = np.maximum(0.0, lower - c.others[number]) * (1 - SLACK)
    todo = np.flatnonzero(~(upper < np.maximum(lower, c.next[number] / 2 * (1 - SLACK))))
    upper[todo] = np.sqrt(own_distance(x[todo], number[todo], c)) * (1 + SLACK)
    work = len(todo)
    todo = todo[~(upper[todo] < np.maximum(lower[todo], c.next[number[todo]] / 2 * (1 - SLACK)))]
    old = number[todo].copy()
    radius = (2 * upper[todo] + c.next[old]) * (1 + 1e-9)
    inside = (c.near[old] <= radius[:, None]).sum(1)
    ring = np.minimum(c.k, 1 << np.ceil(np.log2(np.maximum(2, inside))).astype(np.int64))  # rings of 2, 4, 8, ... centroids
    for a, width in {*zip(old.tolist(), ring.tolist(), strict=True)}:
        here = todo[(old == a) & (ring == width)]
        tried = np.sort(c.order[a, :width])  # the first of equals is the one of the smaller number
        own = x[here]
        squares = (own * own).sum(1)[:, None] - 2 * own @ c.at[tried].T + c.squares[tried]
        work += squares.size
        best = squares.argmin(1)
        every = np.arange(len(here))
        number[here], upper[here] = tried[best], np.sqrt(squares[every, best]) * (1 + SLACK)
        squares[every, best] = np.inf
        lower[here] = np.sqrt(squares.min(1)) * (1 - SLACK)
    return work


def limbs_of(total: list[int]) -> list[list[int]]:
    """Two's complement limbs of 32 bits, lowest first; the last one holds the sign."""
    out = []
    while True:
        if all(-(1 << 31) <= t < 1 << 31 for t in total):
            return [*out, total]
        out.append([t & 0xFFFFFFFF for t in total])
        total = [t >> 32 for t in total]


def packed(rows: DataFrame) -> DataFrame:
    """ids, data: blocks of BLOCK vectors at most, of rows vec_id, v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                part = batch.slice(k, BLOCK)
                data = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([ids, pa.array([data.tobytes()], pa.binary())], names=["ids", "data"])

    return rows.select("vec_id", "v").mapInArrow(run, "ids array<long>, data binary")


def fresh_state(m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.zeros(m, np.int64), np.full(m, np.inf), np.zeros(m)


def assigned(state: bytes | None, x: np.ndarray, c: Centroids) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray | None]:
    """A block's new numbers and bounds, and its squared distances where they had to be found in big integers."""
    m = len(x)
    if x.dtype == object or not c.small:
        number, far = exactly(x.astype(object), c.at.astype(object))
        return (number, np.full(m, np.inf), np.zeros(m)), far
    if state:
        number, bounds = np.frombuffer(state, np.int32, m).astype(np.int64), np.frombuffer(state, np.float64, offset=4 * m)
        now = number, bounds[:m].copy(), bounds[m:].copy()
    else:
        now = fresh_state(m)
    search(x, *now, c)
    return now, None


def one_round(vectors: DataFrame, c: Centroids, scale: int) -> DataFrame:
    """STATE: a row for each block with its new state, and, of each task, the limbs of each cluster's sums."""
    held, width = vectors.sparkSession.sparkContext.broadcast(c), len(c.rows[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        counts, sums, large = np.zeros(c.k, np.int64), np.zeros((c.k, width), np.int64), {}
        for batch in batches:
            for n in range(batch.num_rows):
                x = integers(np.frombuffer(batch.column(1)[n].as_buffer(), np.float64).reshape(-1, width), scale)
                (number, upper, lower), _ = assigned(batch.column(2)[n].as_py(), x, c)
                counts += np.bincount(number, minlength=c.k)
                if x.dtype == object:
                    for a, row in zip(number.tolist(), x, strict=True):
                        large[a] = row + large.get(a, 0)
                else:
                    order = np.argsort(number, kind="stable")
                    found, start = np.unique(number[order], return_index=True)
                    sums[found] += np.add.reduceat(x[order], start, axis=0).astype(np.int64)
                state = number.astype(np.int32).tobytes() + upper.tobytes() + lower.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(n, 1), pa.array([state], pa.binary()), *(pa.nulls(1, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], names=["block", "state", "cluster", "limb", "n", "sums"])
        rows = []
        for a in np.flatnonzero(counts).tolist():
            extra = large.get(a)
            total = [s + int(extra[j]) if extra is not None else s for j, s in enumerate(sums[a].tolist())]
            rows += [(a, k, int(counts[a]) if k == 0 else 0, limb) for k, limb in enumerate(limbs_of(total))]
        if rows:
            a, k, n, limbs = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.binary()), pa.array(a, pa.int32()), pa.array(k, pa.int32()), pa.array(n, pa.int64()), pa.array(limbs, pa.list_(pa.int64()))], names=["block", "state", "cluster", "limb", "n", "sums"])

    return vectors.select("block", "data", "state").mapInArrow(run, STATE)


def placed(vectors: DataFrame, c: Centroids, scale: int) -> DataFrame:
    """vec_id, cluster, distance of every vector; a squared distance beyond a long is null."""
    held, width = vectors.sparkSession.sparkContext.broadcast(c), len(c.rows[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                x = integers(np.frombuffer(batch.column(1)[n].as_buffer(), np.float64).reshape(-1, width), scale)
                (number, *_), far = assigned(batch.column(2)[n].as_py(), x, held.value)
                if far is None:
                    far = own_distance(x, number, held.value).astype(np.int64)
                else:
                    far = [d if d < 1 << 63 else None for d in far.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(n, 1).flatten(), pa.array(number, pa.int32()), pa.array(far, pa.int64())], names=["vec_id", "cluster", "distance"])

    return vectors.select("ids", "data", "state").mapInArrow(run, "vec_id long, cluster int, distance long")


def moved(state: DataFrame, c: Centroids) -> Centroids:
    """Each centroid at the floor of its vectors' means; those of no vectors stay."""
    width = len(c.rows[0])
    sums = [F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(width)]
    rows = list(c.rows)
    total: dict[int, list] = {}
    for r in state.filter("cluster IS NOT NULL").groupBy("cluster", "limb").agg(F.sum("n").alias("n"), *sums).collect():  # a row for each cluster and limb
        t = total.setdefault(r["cluster"], [0, [0] * width])
        t[0] += r["n"]
        t[1] = [s + (r[f"s{j}"] << 32 * r["limb"]) for j, s in enumerate(t[1])]
    for a, (n, s) in total.items():
        rows[a] = tuple(x // n for x in s)
    return Centroids(rows, c)


def fitting(x: int | None) -> int | None:
    """x, or null where it is beyond a long."""
    return x if x is not None and x < 1 << 63 else None


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: int = 2, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every vector of `width` finite components.

    Components become floor(scale * c). The first centroids are the k vectors of smallest sha256 of `seed:vec_id`; of
    rows that share an identifier the smaller vector comes first, null identifiers come last, and fewer vectors than k
    make fewer centroids. Null vectors, those of another number of components or with a null or non-finite one take no part; repeated rows and null identifiers
    are vectors like any other. An empty table gives no rows. Components of any finite size are
    exact: those of longer vectors than EXACT are compared in big integers with every centroid; a distance or
    inertia beyond a long is null. Other columns of df are not read.
    """
    spark = ship(df.sparkSession)
    v = F.col("v")
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter((F.size(v) == width) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    seeds = rows.orderBy(digest.asc_nulls_last(), "v").limit(k).collect()  # k rows
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not seeds:
        return spark.createDataFrame([], schema)
    c = Centroids([tuple(map(int, integers(np.array([r["v"]]), scale)[0])) for r in seeds])
    vectors = cut(packed(rows).withColumn("block", F.monotonically_increasing_id()))
    vectors = cut_by(vectors, "block", vectors.rdd.getNumPartitions())
    with_state = vectors.withColumn("state", F.lit(None).cast("binary"))
    for _ in range(rounds):
        state = cut(one_round(with_state, c, scale))
        with_state = vectors.join(state.filter("block IS NOT NULL").select("block", "state").hint("shuffle_hash"), "block")
        c = moved(state, c)
    out = cut(placed(with_state, c, scale))
    far = F.col("distance").cast("decimal(38,0)")
    found = {r["cluster"]: r for r in out.groupBy("cluster").agg(F.sum(far).alias("sum"), (F.count("distance") == F.count("*")).alias("whole")).collect()}  # k rows
    total = sum(int(r["sum"] or 0) for r in found.values()) if all(r["whole"] for r in found.values()) else None
    named = [(a, fitting(int(r["sum"]) if r["whole"] else None), fitting(total), hashlib.sha256(",".join(map(str, c.rows[a])).encode()).hexdigest()) for a, r in found.items()]
    per = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

"""Exact join of documents at a Jaccard distance of shingle sets, in metric space.

1. Documents of one shingle set form a class. Its set is kept whole for the last check, and as
   an image: a bit for each of IMAGE residues, or of as many as the set has shingles, set if the set holds an odd number of its shingles. The larger of the images'
   Hamming distance and the difference of the sizes is a metric that never exceeds
   the symmetric difference; put in place of it in the Jaccard distance, it gives
   a distance that is itself a metric and never exceeds the Jaccard distance.
2. Sets without a common shingle lie at distance 1 of each other, and so tell nothing of each other as pivots. The first pivots
   therefore are single shingles: a set lies in the regions of its rarest ones. If its
   n - ceil(t n) + 1 first ones, in any order that all sets share, hold none of those of another, their
   overlap is too small for a link. How often a shingle occurs is taken from a bounded sample; that bears on the cost alone.
3. In each region a forest of the pairs that images leave possible is confirmed on the full sets; sets
   that these link form components. Regions that hold one component only are done.
4. A region larger than a block is split: some of its sets are pivots, each member lies in the Voronoi
   region of its nearest pivot, and is replicated to that of every pivot at most twice the radius further
   away, which by the triangle inequality holds whatever it may link with. The parts are split again
   as long as that saves comparisons.
5. A region that fits in a block joins by itself, again by pivots and windows, down to a few
   sets that are compared by image. What may still be a link is confirmed on the full sets.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rungwise.llm.common import cut, dealt_anew, shared_folder, ship, small
from rungwise.llm.components import components
from rungwise.llm.minhash import BLOCK, HELD, SEATS, at_places, full_sets, mark_of, mix, seated, shingles, sorted_places

IMAGE, WORDS = 1024, 3
#: Different texts by which rare shingles are told from common ones, about, and entries of the table of common ones at most.
SAMPLED, COMMON = 4_000, 1 << 20
#: Pivots of a region that is split, levels of splits between tasks, members that are compared at once.
PIVOTS, LEVELS, LEAF = 24, 4, 48


def image(x: np.ndarray) -> bytes:
    width = max(IMAGE, 1 << (len(x) - 1).bit_length())
    bits = np.bincount((mix(x) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def folded(image: bytes | np.ndarray, words: int) -> np.ndarray:
    """An image of fewer bits, the same as if it had been taken so."""
    out = np.frombuffer(image, np.uint64)
    while len(out) > words:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def apart(one: bytes, other: bytes) -> int:
    """Hamming distance of two images, at the width of the smaller one."""
    words = min(len(one), len(other)) // 8
    return int(np.bitwise_count(folded(one, words) ^ folded(other, words)).sum())


def words_of(images: Iterable[bytes]) -> np.ndarray:
    held = [folded(x, IMAGE // 64) for x in images]
    return np.stack(held) if held else np.zeros((0, IMAGE // 64), np.uint64)


def gap(one: np.ndarray, size: np.ndarray, other: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Least symmetric difference, by images (rows of 64-bit words) and sizes, of each of `one` with each of `other`."""
    if len(other) < len(one):
        return gap(other, others, one, size).T
    out = np.abs(size[:, None] - others[None, :])
    for k in range(len(one)):
        np.maximum(out[k], np.bitwise_count(one[k] ^ other).sum(1, dtype=np.int64), out=out[k])
    return out


def distance(least: np.ndarray, size: np.ndarray, others: np.ndarray) -> np.ndarray:
    return 2 * least / (size[:, None] + others[None, :] + least)


def near(least: np.ndarray, size: np.ndarray, others: np.ndarray, percent: int) -> np.ndarray:
    """Where 100 * intersection >= percent * union isn't ruled out."""
    return least * (100 + percent) <= (100 - percent) * (size[:, None] + others[None, :])


def regions(far: np.ndarray, radius: float) -> np.ndarray:
    """Which pivot's region each row lies in, at its distances from the pivots: that of the nearest and those in its window."""
    return far <= far.min(1, keepdims=True) + 2 * radius + 1e-9


def possible(images: np.ndarray, full: np.ndarray, sizes: np.ndarray, roots: np.ndarray, asks: np.ndarray, percent: int, depth: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (asking, stored) of rows of different roots that images do not rule out, region by region; a pair may come twice. `asks` says 1 of rows that ask, 0 of stored ones, -1 of those that are both."""
    ask, hold = np.flatnonzero(asks != 0), np.flatnonzero(asks <= 0)
    if not len(ask) or not len(hold):
        return
    if len(hold) > LEAF and depth < 8:
        pivots = hold[np.linspace(0, len(hold) - 1, min(PIVOTS, math.isqrt(len(hold)))).astype(np.int64)]
        inside = regions(distance(gap(images, sizes, images[pivots], sizes[pivots]), sizes, sizes[pivots]), 1 - percent / 100)
        parts = [np.flatnonzero(inside[:, j]) for j in range(len(pivots))]
        work = [int((asks[p] != 0).sum()) * int((asks[p] <= 0).sum()) for p in parts]
        if sum(work) < 0.7 * len(ask) * len(hold):
            for p in parts:
                for a, b in possible(images[p], full[p], sizes[p], roots[p], asks[p], percent, depth + 1):
                    yield p[a], p[b]
            return
    for k in range(0, len(ask), 64):
        part = ask[k : k + 64]
        a, b = np.nonzero(near(gap(images[part], sizes[part], images[hold], sizes[hold]), sizes[part], sizes[hold], percent) & (roots[part][:, None] != roots[hold][None, :]))
        a, b = part[a], hold[b]
        wide = np.flatnonzero(np.minimum(sizes[a], sizes[b]) > IMAGE)
        if len(wide):
            stays = np.ones(len(a), bool)
            for k in wide:
                i, j = a[k], b[k]
                stays[k] = apart(full[i], full[j]) * (100 + percent) <= (100 - percent) * (sizes[i] + sizes[j])
            a, b = a[stays], b[stays]
        yield a, b


def sketch(df: DataFrame, doc_id: str, text: str, percent: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """row, doc_id, mark, n, set_hash, image, keys (the first pivots) of every row; the last three null without words."""
    held = df.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = held.value
        for batch in batches:
            n, sets, images, keys = [], [], [], []
            for t in batch.column(3):
                x = shingles(t.as_py(), WORDS)
                n.append(len(x))
                if not len(x):
                    for out in (sets, images, keys):
                        out.append(None)
                    continue
                sets.append(int(mix(x).sum()).to_bytes(8, "little") + int(np.bitwise_xor.reduce(mix(~x))).to_bytes(8, "little"))
                images.append(image(x))
                order = mix(x) >> np.uint64(16)
                if len(known):
                    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                    order |= np.where(known[at] == x, times[at], 0).astype(np.uint64) << np.uint64(48)
                most = min(len(x), len(x) + (-percent * len(x) // 100) + 1)
                keys.append(x[np.argpartition(order, most - 1)[:most]].view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(images, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["row", "doc_id", "mark", "n", "set_hash", "image", "keys"])

    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), mark_of(text).alias("mark"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, mark long, n long, set_hash binary, image binary, keys array<long>")


def common_shingles(df: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that occur in more than one of some SAMPLED different texts, the COMMON most frequent at most, and how often, sorted by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py(), WORDS).view(np.int64))], names=["h"])

    texts = df.filter(F.length(text) > 0).select(F.col(text).cast("binary").alias("text"), mark_of(text).alias("mark"))
    share = math.ceil((1 << 20) * min(1.0, SAMPLED / max(1, df.count())))
    picked = texts.filter(F.pmod(F.xxhash64("mark"), F.lit(1 << 20)) < share).dropDuplicates(["mark"]).select("text")
    found = picked.mapInArrow(run, "h long").groupBy("h").count().filter("count > 1").orderBy(F.desc("count"), "h").limit(COMMON).toArrow()
    known, times = found.column("h").to_numpy().view(np.uint64), found.column("count").to_numpy()
    order = np.argsort(known)
    return known[order], np.minimum(times[order], 0xFFFF)


def sized(seats: DataFrame, percent: int) -> DataFrame:
    """key, id, n of seats (key, id, n, size) that have a neighbour of a size near enough for a link; of regions beyond a block, all."""
    order = Window.partitionBy("key").orderBy("n", "id")
    near_in_size = (100 * F.lag("n").over(order) >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.lead("n").over(order))
    few = seats.filter(F.col("size") <= BLOCK).withColumn("fits", near_in_size).filter("fits")
    return few.select("key", "id", "n").unionByName(seats.filter(F.col("size") > BLOCK).select("key", "id", "n"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) with 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint64) for c in (2, 3))
                if linked(a, b, percent):
                    keep.append(k)
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows)], names=["u", "v"])

    one, two = (sets.select(F.col("id").alias(x), F.col("hashes").alias(f"h{x}")) for x in "uv")
    return pairs.join(one, "u").join(two, "v").select("u", "v", "hu", "hv").mapInArrow(run, "u long, v long")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def written(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder. Unlike a checkpoint it has a size that Spark knows; what it guesses for joins of joins of checkpoints grows without bound."""
    path = f"{shared_folder(df.sparkSession)}/join-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def loads(members: DataFrame) -> DataFrame:
    """key, load, size of each region: a load of 1 fills a block by members or by shingles."""
    load = F.sum(F.greatest(F.lit(1.0 / BLOCK), F.col("n") / HELD)).alias("load")
    return members.groupBy("key").agg(load, F.count("*").alias("size"))


def split(members: DataFrame, images: DataFrame, percent: int, level: int) -> DataFrame:
    """members (key, id, n, root) with those regions that are larger than a block, and gain by it, split into the regions of some of their members."""
    large = cut(loads(members).filter("load > 1"))
    if not large.take(1):
        return members
    inside = members.join(dealt_anew(large, "key"), "key").join(images, "id")
    chance = F.pmod(F.xxhash64("id", F.lit(level)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = inside.withColumn("chance", chance).filter(F.col("chance") < 4.0 * PIVOTS / F.col("size"))  # some 4 * PIVOTS of each region
    first = drawn.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("chance", "id"))).filter(F.col("place") <= PIVOTS)
    pivots = cut(first.groupBy("key").agg(F.collect_list(F.struct("id", "n", "image")).alias("pivots")))  # PIVOTS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch]).sort_by("key").combine_chunks()
            keys = rows.column("key").to_numpy()
            starts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                part = rows.slice(s, e - s)
                held = sorted(part.column("pivots")[0].as_py(), key=lambda p: p["id"])
                there, others = words_of(p["image"] for p in held), np.array([p["n"] for p in held])
                here, sizes = words_of(part.column("image").to_pylist()), part.column("n").to_numpy()
                found = regions(distance(gap(here, sizes, there, others), sizes, others), 1 - percent / 100)
                parts = pa.array([np.flatnonzero(f).tolist() for f in found], pa.list_(pa.int32()))
                yield from part.select(["key", "id", "n", "root"]).append_column("parts", parts).to_batches()

    dealt = inside.select("key", "id", "n", "root", "image").join(dealt_anew(pivots, "key"), "key").select("key", "id", "n", "root", "image", "pivots")
    dealt = cut(dealt.mapInArrow(run, "key long, id long, n long, root long, parts array<int>"))
    part = F.explode("parts").alias("part")
    weights = loads(dealt.select("key", part, "n").select(F.struct("key", "part").alias("key"), "n"))
    gains = weights.groupBy("key.key").agg(F.sum(F.col("load") * F.col("load")).alias("work")).join(large, "key")
    gains = cut(gains.filter("work < 0.7 * load * load").select("key"))
    if not gains.take(1):
        return members
    better = dealt.join(dealt_anew(gains, "key"), "key").select(part, "key", "id", "n", "root")
    better = better.select(F.xxhash64("key", "part", F.lit(level)).alias("key"), "id", "n", "root")
    return written(members.join(dealt_anew(gains, "key"), "key", "left_anti").unionByName(better))


SEAT = SEATS + ", n long, image binary"


def columns_of(rows: pa.Table) -> tuple[np.ndarray, ...]:
    asks = rows.column("asks").cast(pa.int8()).fill_null(-1).to_numpy()
    full = rows.column("image").to_pylist()
    return words_of(full), np.array([*full, None], object)[:-1], rows.column("n").to_numpy(), rows.column("root").to_numpy(), asks


def likely(members: DataFrame, images: DataFrame, percent: int) -> DataFrame:
    """The seats of rows that have, at their place, a partner of another component whom images don't rule out.

    A region that fits in a block is one place, where all ask and all are stored; a larger one that no pivots split is seated in blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in at_places(batches):
            columns, live = columns_of(rows), np.zeros(rows.num_rows, bool)
            for s, e in bounds:
                for a, b in possible(*(x[s:e] for x in columns), percent):
                    live[s + a] = live[s + b] = True
            yield from rows.filter(pa.array(live)).combine_chunks().to_batches()

    return at_seats(members, images).mapInArrow(run, SEAT)


def forest(members: DataFrame, images: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) that images leave possible, of each place only those that join components of which the ones before would already have made one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in at_places(batches):
            columns, ids, out = columns_of(rows), rows.column("id").to_numpy(), []
            for s, e in bounds:
                own = Joined(columns[3][s:e])
                for a, b in possible(*(x[s:e] for x in columns), percent):
                    for i, j in zip(a.tolist(), b.tolist(), strict=True):
                        if own.join(i, j):
                            out.append((int(max(ids[s + i], ids[s + j])), int(min(ids[s + i], ids[s + j]))))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return at_seats(members, images).mapInArrow(run, "u long, v long").distinct()


class Joined:
    """The components of a place's rows, by their roots."""

    def __init__(self, roots: np.ndarray):
        self.roots, self.up = roots.tolist(), {}

    def top(self, r: int) -> int:
        while r in self.up:
            r = self.up[r]
        return r

    def join(self, i: int, j: int, if_: Callable[[], bool] = lambda: True) -> tuple[int, int] | None:
        """The two roots, larger first, if rows i and j were of different components and are of one now."""
        u, v = self.top(self.roots[i]), self.top(self.roots[j])
        if u == v or not if_():
            return None
        u, v = max(u, v), min(u, v)
        self.up[u] = v
        return u, v


def at_seats(members: DataFrame, images: DataFrame) -> DataFrame:
    """Members with their images at their places, sorted by place."""
    large = cut(loads(members).filter("load > 1").select("key"))
    one = members.join(dealt_anew(large, "key"), "key", "left_anti").select("key", F.lit(0).alias("b"), F.lit(0).alias("c"), "id", "root", F.lit(None).cast("boolean").alias("asks"), "n")
    many = members.join(dealt_anew(large, "key"), "key")
    seats = one.unionByName(seated(many).join(members.select("id", "n").distinct(), "id").select(one.columns)).join(images, "id")
    return sorted_places(seats.select(*one.columns, "image"))


def settled(seats: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) of roots whose components meet at a place and hold members that are linked, confirmed on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in at_places(batches):
            columns, out = columns_of(rows), []
            hashes = rows.column("hashes")
            for s, e in bounds:
                own = Joined(columns[3][s:e])
                for a, b in possible(*(x[s:e] for x in columns), percent):
                    for i, j in zip(a.tolist(), b.tolist(), strict=True):
                        link = own.join(i, j, lambda i=i, j=j, s=s: linked(*(np.frombuffer(hashes[s + k].as_buffer(), np.uint64) for k in (i, j)), percent))
                        if link:
                            out.append(link)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return sorted_places(seats.join(sets, "id").select("key", "b", "c", "id", "root", "asks", "n", "image", "hashes")).mapInArrow(run, "u long, v long").distinct()


def join(df: DataFrame, percent: int = 90, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the least doc_id reachable by links, itself included).

    Null identifiers come after all others, so a component's is null only if all its rows' are. A null or
    word-free text has no shingles and no links. Rows that repeat a doc_id are documents of
    their own, equal sets are linked; an empty table gives no rows. Other columns of df are not read.
    """
    ship(df.sparkSession)
    base = cut(sketch(df, doc_id, text, percent, common_shingles(df, text)))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "mark"))
    classes = base.filter(F.col("set_hash").isNotNull()).groupBy("set_hash", "n").agg(best.alias("best"), F.first("image").alias("image"), F.first("keys").alias("keys"))
    classes = cut(classes.withColumn("id", F.col("best.row")))
    exploded = classes.select("id", "n", F.explode("keys").alias("key"))
    shared = exploded.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    seats = cut(sized(cut(exploded.join(dealt_anew(shared, "key"), "key").select("key", "id", "n", "size")), percent))
    texts = df.select(F.col(doc_id).cast("long").alias("doc_id"), mark_of(text).alias("mark"), F.col(text).cast("binary").alias("text"))
    repeated = bool(base.groupBy("doc_id", "mark").count().filter("count > 1").take(1))

    def sets_of(ids: DataFrame) -> DataFrame:
        """id, hashes (sorted, packed) of the classes that may still be linked, from their texts."""
        wanted = cut(classes.join(ids, "id", "left_semi").select("id", F.col("best.doc_id").alias("at"), F.col("best.mark").alias("mark")))
        read = texts.join(small(wanted), (wanted["mark"] == texts["mark"]) & wanted["at"].eqNullSafe(texts["doc_id"])).select("id", F.lit(b"").alias("sign"), "text")
        if repeated:  # one of the rows that repeat each other
            read = read.dropDuplicates(["id"])
        return cut(full_sets(read, WORDS).drop("sign"))

    def of_pairs(pairs: DataFrame) -> DataFrame:
        return confirmed(pairs, sets_of(pairs.select(F.col("u").alias("id")).union(pairs.select("v"))), percent)

    def rooted_in(rows: DataFrame, roots: DataFrame) -> DataFrame:
        """Rows of those regions that hold more than one component, with their roots."""
        rows = rows.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        several = rows.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("key")
        return cut(rows.join(dealt_anew(several, "key"), "key").select("key", "id", "n", "root"))

    members, images = seats.withColumn("root", F.col("id")), classes.select("id", "image")
    for level in range(LEVELS):
        before, members = members, split(members, images, percent, level)
        if members is before:
            break
    roots = written(components(written(of_pairs(written(forest(members, images, percent))))))
    seats = written(likely(rooted_in(members.drop("root"), roots), images, percent))
    tops = written(components(written(settled(seats, sets_of(seats.select("id")), percent))))
    rooted = classes.select("set_hash", "n", "id", "best").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    rooted = rooted.join(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").withColumn("top", F.coalesce("top", "root"))
    leads = rooted.groupBy("top").agg(F.min("best").alias("lead"))
    led = rooted.select("set_hash", "n", "top").join(dealt_anew(leads, "top"), "top").select("set_hash", "n", "lead")
    found = base.select("doc_id", "n", "set_hash").join(led, ["set_hash", "n"], "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("lead").isNull(), F.col("doc_id")).otherwise(F.col("lead.doc_id")).alias("component_id"))

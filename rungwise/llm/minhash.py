"""Near-duplicates by b-bit MinHash.

1. Each document's distinct five-word shingles are hashed to 64 bits; 128
   minima over them give 32 band keys of four minima each, and the low eight bits
   of every minimum are packed into a signature.
2. Documents of one shingle set form a class; its least identifier stands for it.
3. Representatives that share a band key are candidates. A first pass proposes for each the least
   document it shares a key with. Classes that these
   confirmed links join need no further comparison, so a large group of near
   copies costs a link per member. In a second pass all remaining candidate
   pairs, that is, of different components within a key, meet in bounded blocks, which give
   back only the links that join components, never the pairs.
4. A candidate pair is estimated from the signatures by counting equal low bits,
   corrected for chance collisions; a pair well below the threshold is dropped,
   every other one is confirmed on the full sets.

A pair at the threshold of 0.75 shares none of 32 keys with probability 5e-6.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungwise.llm.common import cut, dealt_anew, fresh, ship, small
from rungwise.llm.components import components

BANDS, ROWS, BITS, WORDS = 32, 4, 8, 5
HASHES = BANDS * ROWS
#: Members of a key that meet in one task in the second pass.
BLOCK = 1024
#: Shingles that a block holds: 8 MB.
HELD = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FACTORS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * _ODD) | np.uint64(1)
_TERMS = mix(np.arange(HASHES + 1, 2 * HASHES + 1, dtype=np.uint64) * _ODD)
_BAND = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


#: A random number for each byte, the same for A-Z as for a-z, zero for the six white-space characters; and how far words are hashed at once.
_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1000)) * _ODD)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_BYTE[_SPACE] = 0
_GAP = re.compile(rb"[\x20\x09-\x0D]")
CHUNK = 1 << 20
_BASE = int(mix(_ODD[None])[0]) | 1


def powers(base: int, n: int) -> np.ndarray:
    """base^0, base^1, ... modulo 2^64."""
    out = np.ones(n, np.uint64)
    out[1:] = base
    return np.multiply.accumulate(out)


_up, _down = np.zeros(0, np.uint64), np.zeros(0, np.uint64)


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text, in order: the bytes' numbers weighted by a power for each place in the word, all words of a chunk at once."""
    global _up, _down
    out, at = [], 0
    while at < len(text):
        end = at + CHUNK
        if end < len(text):
            gap = _GAP.search(text, end)
            end = gap.start() if gap else len(text)
        data = np.frombuffer(text, np.uint8)[at:end]
        if len(data) > len(_up):
            n = 1 << len(data).bit_length()
            _up, _down = powers(_BASE, n), powers(pow(_BASE, -1, 1 << 64), n)
        blank = _SPACE[data]
        start = ~blank
        start[1:] &= blank[:-1]
        starts = np.flatnonzero(start)
        if len(starts):
            out.append(mix(np.add.reduceat(_BYTE[data] * _up[: len(data)], starts) * _down[starts]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: bytes | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of `size` words of a text; of all its words if they are fewer."""
    h = word_hashes(text or b"")
    if not len(h):
        return h
    n = max(1, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(h))):
        out = mix(out * _ODD + h[k : k + n])
    if len(h) < size:
        out = mix(out + np.uint64(len(h)))
    return np.unique(out)


def minima(x: np.ndarray) -> np.ndarray:
    best = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(x), 256):
        np.minimum(best, (x[k : k + 256, None] * _FACTORS + _TERMS).min(0), out=best)
    return best


def signature(best: np.ndarray) -> bytes:
    return (mix(best) & np.uint64((1 << BITS) - 1)).astype(np.uint8).tobytes()


def band_keys(best: np.ndarray) -> np.ndarray:
    key = _BAND.copy()
    for k in range(ROWS):
        key = mix(key * _ODD + best.reshape(BANDS, ROWS)[:, k])
    return key.view(np.int64)


def estimate(equal: np.ndarray) -> np.ndarray:
    """Similarity from the share of equal low bits, corrected for those equal by chance."""
    chance = 1.0 / (1 << BITS)
    return (equal / HASHES - chance) / (1 - chance)


def floor_of(threshold: float) -> float:
    """Estimates under this are of pairs below the threshold: five standard deviations off."""
    return threshold - 5 * float(np.sqrt(threshold * (1 - threshold) / HASHES))


def mark_of(text: str) -> Column:
    """Tells texts of one identifier apart, the same in every evaluation of a table."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def sketch(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """row, doc_id, mark (a hash of the text), n, set_hash, signature, keys of every row; the last three null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "doc_id", "mark", "n", "set_hash", "signature", "keys"]
        for batch in batches:
            n, sets, signs, keys = [], [], [], []
            for t in batch.column(3):
                x = shingles(t.as_py())
                n.append(len(x))
                if len(x):
                    best = minima(x)
                    sets.append(int(mix(x).sum()).to_bytes(8, "little") + int(np.bitwise_xor.reduce(mix(x * _ODD))).to_bytes(8, "little"))
                    signs.append(signature(best))
                    keys.append(band_keys(best))
                else:
                    sets.append(None)
                    signs.append(None)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(signs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=names)

    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), mark_of(text).alias("mark"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, mark long, n long, set_hash binary, signature binary, keys array<long>")


def full_sets(df: DataFrame, size: int = WORDS) -> DataFrame:
    """id, sign, hashes (sorted, packed) from rows id, sign, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                sets = [shingles(t.as_py(), size).tobytes() for t in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sets, pa.binary())], names=["id", "sign", "hashes"])

    return df.mapInArrow(run, "id long, sign binary, hashes binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) with 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = floor_of(percent / 100)
        for batch in batches:
            keep = []
            su, sv, hu, hv = (batch.column(k) for k in range(2, 6))
            for k in range(batch.num_rows):
                equal = np.frombuffer(su[k].as_buffer(), np.uint8) == np.frombuffer(sv[k].as_buffer(), np.uint8)
                if estimate(equal.sum()) < least:
                    continue
                a, b = np.frombuffer(hu[k].as_buffer(), np.uint64), np.frombuffer(hv[k].as_buffer(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    keep.append(k)
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows)], names=["u", "v"])

    one = sets.select(F.col("id").alias("u"), F.col("sign").alias("su"), F.col("hashes").alias("hu"))
    two = sets.select(F.col("id").alias("v"), F.col("sign").alias("sv"), F.col("hashes").alias("hv"))
    joined = pairs.join(one, "u").join(two, "v").select("u", "v", "su", "sv", "hu", "hv")
    return joined.mapInArrow(run, "u long, v long")


SEATS = "key long, b int, c int, id long, root long, asks boolean"


def seated(members: DataFrame) -> DataFrame:
    """Places (key, b, c) at which rows of a key meet, from rows key, id, n, root.

    Per key, its most frequent root is the main one. All rows are stored, by
    home block b; rows outside the main component also ask, in chunks c. At place (b, c) the
    askers of chunk c meet the rows stored in block b, so two rows meet unless
    both are of the main component, and no place holds more than some 2 * BLOCK rows or, but
    for single texts that are longer, 2 * HELD shingles.
    """
    load = F.greatest(F.lit(1.0 / BLOCK), F.col("n") / HELD)
    per_root = members.groupBy("key", "root").agg(F.sum(load).alias("load"))
    main = F.max(F.struct("load", "root"))
    per_key = per_root.groupBy("key").agg(F.sum("load").alias("load"), F.count("*").alias("roots"), main.alias("main")).filter("roots > 1")
    named = members.join(dealt_anew(per_key, "key"), "key")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("load"))).cast("int")
    chunks = F.greatest(F.lit(1), F.ceil(F.col("load") - F.col("main.load"))).cast("int")
    home = F.pmod(F.xxhash64("id"), blocks.cast("long")).cast("int")
    chunk = F.pmod(F.xxhash64("id", F.lit(7)), chunks.cast("long")).cast("int")
    stored = F.transform(F.sequence(F.lit(0), chunks - 1), lambda c: F.struct(F.col("home").alias("b"), c.alias("c"), F.lit(False).alias("asks")))
    asking = F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: F.struct(b.alias("b"), F.col("chunk").alias("c"), F.lit(True).alias("asks")))
    places = F.when(F.col("root") == F.col("main.root"), stored).otherwise(F.concat(stored, asking))
    named = named.withColumns({"home": home, "chunk": chunk}).withColumn("places", places)
    return named.select("key", "id", "root", F.inline("places")).select("key", "b", "c", "id", "root", "asks")


PLACE = ["key", "b", "c"]


def at_places(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Tables of rows sorted by place, with the bounds of the places that are complete in each; a place cut by a batch's end waits for the next."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = (rows if rest is None else pa.concat_tables([rest, rows])).combine_chunks()
        if rows.num_rows:
            new = np.zeros(rows.num_rows - 1, bool)
            for name in PLACE:
                x = rows.column(name).to_numpy()
                new |= x[1:] != x[:-1]
            starts = [0, *(np.flatnonzero(new) + 1).tolist()]
            yield rows, list(zip(starts[:-1], starts[1:], strict=True))
            rest = rows.slice(starts[-1])
    if rest is not None:
        yield rest.combine_chunks(), [(0, rest.num_rows)]


def sorted_places(seats: DataFrame) -> DataFrame:
    return seats.repartition(*PLACE).sortWithinPartitions(*PLACE)


def columns_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Identifiers, roots (to be changed), which rows ask, and signatures."""
    sign = np.frombuffer(b"".join(rows.column("sign").to_pylist()), np.uint8).reshape(rows.num_rows, HASHES)
    return rows.column("id").to_numpy(), rows.column("root").to_numpy().copy(), rows.column("asks").to_numpy(), sign


def likely(members: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """The seats of rows that have, at their place, a partner of another component whose estimate isn't below the threshold."""
    least = floor_of(percent / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in at_places(batches):
            _, roots, asks, sign = columns_of(rows)
            live = np.zeros(rows.num_rows, bool)
            for s, e in bounds:
                here = s + np.flatnonzero(~asks[s:e])
                for k in s + np.flatnonzero(asks[s:e]):
                    other = here[roots[here] != roots[k]]
                    good = other[estimate((sign[other] == sign[k]).sum(1)) >= least]
                    live[good] = True
                    live[k] |= len(good) > 0
            yield from rows.select(["key", "b", "c", "id", "root", "asks"]).filter(pa.array(live)).combine_chunks().to_batches()

    return sorted_places(seated(members).join(signs, "id").select("key", "b", "c", "id", "root", "asks", "sign")).mapInArrow(run, SEATS)


def linked(ids: np.ndarray, roots: np.ndarray, asks: np.ndarray, sign: np.ndarray, hashes: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Confirmed links between the components at one place, given as their roots, at most one for each component.

    An inverted index over the place's shingles gives an asker's intersections
    with all stored rows at once.
    """
    least, here, out, own = floor_of(percent / 100), np.flatnonzero(~asks), [], roots.copy()
    sizes = np.array([len(h) // 8 for h in hashes])
    _, dense = np.unique(np.frombuffer(b"".join(hashes), np.uint64), return_inverse=True)
    ends = np.cumsum(sizes)
    order = np.argsort(dense, kind="stable")
    posted = np.repeat(np.arange(len(ids)), sizes)[order]
    first = np.searchsorted(dense[order], np.arange(dense.max() + 2))
    for k in np.flatnonzero(asks):
        other = here[roots[here] != roots[k]]
        other = other[estimate((sign[other] == sign[k]).sum(1)) >= least]
        if not len(other):
            continue
        mine = dense[ends[k] - sizes[k] : ends[k]]
        start, length = first[mine], first[mine + 1] - first[mine]
        spots = np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        both = np.bincount(posted[spots], minlength=len(ids))[other]
        good = other[100 * both >= percent * (sizes[k] + sizes[other] - both)]
        for j in good[np.unique(roots[good], return_index=True)[1]]:
            out.append((int(max(own[k], own[j])), int(min(own[k], own[j]))))
            roots[roots == roots[j]] = roots[k]
    return out


def settled(seats: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) of roots whose components meet at a place and hold members that are linked, as confirmed on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in at_places(batches):
            columns = columns_of(rows)
            hashes, out = rows.column("hashes").to_pylist(), []
            for s, e in bounds:
                out += linked(*(x[s:e] for x in columns), hashes[s:e], percent)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return sorted_places(seats.join(sets, "id").select("key", "b", "c", "id", "root", "asks", "sign", "hashes")).mapInArrow(run, "u long, v long").distinct()


def near_duplicates(df: DataFrame, percent: int = 75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    component_id is the least doc_id reachable over links, itself included; kept says
    that the row holds that doc_id, so rows that repeat it are kept each. Null identifiers come after all others, so a component's is null only
    if all its rows' are. A null or word-free text has no shingles and no links: its row is kept, with
    component_id = doc_id. Rows that repeat a doc_id are documents of their own. An empty table gives no rows.
    """
    return judged(df, percent, doc_id, text).drop("mark").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def judged(df: DataFrame, percent: int, doc_id: str, text: str) -> DataFrame:
    """near_duplicates() with `mark`, by which rows of one identifier are told apart, and one row alone kept of each component."""
    ship(df.sparkSession)
    base = cut(sketch(df, doc_id, text))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "mark"))
    classes = base.filter(F.col("set_hash").isNotNull()).groupBy("set_hash", "n").agg(best.alias("best"), F.first("signature").alias("sign"), F.first("keys").alias("keys"))
    classes = cut(classes.withColumn("id", F.col("best.row")))
    exploded = classes.select("id", "n", F.explode("keys").alias("key"))
    shared = exploded.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("size")).filter("size > 1").drop("size")
    seats = cut(exploded.join(dealt_anew(shared, "key"), "key"))
    wanted = classes.join(seats.select("id").distinct(), "id").select("id", "sign", F.col("best.doc_id").alias("at"), F.col("best.mark").alias("mark"))
    texts = df.select(F.col(doc_id).cast("long").alias("doc_id"), mark_of(text).alias("mark"), F.col(text).cast("binary").alias("text"))
    read = wanted.join(texts, (wanted["mark"] == texts["mark"]) & wanted["at"].eqNullSafe(texts["doc_id"])).select("id", "sign", "text")
    if base.groupBy("doc_id", "mark").count().filter("count > 1").take(1):  # one of the rows that repeat each other
        read = read.dropDuplicates(["id"])
    sets = cut(full_sets(read))
    first = seats.filter("id <> hub").groupBy("id").agg(F.min("hub").alias("hub")).select(F.col("id").alias("u"), F.col("hub").alias("v"))
    roots = cut(components(confirmed(first, sets, percent)))
    labelled = seats.drop("hub").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    open_keys = labelled.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("key")
    members = cut(labelled.join(dealt_anew(open_keys, "key"), "key"))
    seats = cut(likely(members, classes.select("id", "sign"), percent))
    tops = components(settled(seats, sets, percent))
    # a class's root is the root of its root; its component's first row stands for all
    rooted = classes.select("set_hash", "n", "id", "best").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    rooted = rooted.join(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").withColumn("top", F.coalesce("top", "root"))
    leads = rooted.groupBy("top").agg(F.min("best").alias("lead"))
    led = rooted.select("set_hash", "n", "top").join(dealt_anew(leads, "top"), "top").select("set_hash", "n", "lead")
    return base.select("row", "doc_id", "mark", "n", "set_hash").join(led, ["set_hash", "n"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("lead").isNull(), F.col("doc_id")).otherwise(F.col("lead.doc_id")).alias("component_id"),
        F.coalesce(F.col("lead.row") == F.col("row"), F.lit(True)).alias("kept"),
        "mark",
    )


def drop_near_copies(df: DataFrame, percent: int = 75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df, all columns, whatever their names, that stand for their components.

    Rows are found again by identifier and a hash of the text; of rows that repeat each other in both, one stays if
    theirs is the component's. Null identifiers, texts without words and empty tables are as in near_duplicates().
    """
    per = cut(judged(df, percent, doc_id, text).groupBy("doc_id", "mark").agg(F.max("kept").alias("kept"), F.count("*").alias("n")))
    mark = fresh(df, "mark")
    rows = df.withColumn(mark, mark_of(text))

    def among(found: DataFrame):
        return (rows[mark] == found["mark"]) & rows[doc_id].cast("long").eqNullSafe(found["doc_id"])

    gone, again = small(per.filter("not kept").select("doc_id", "mark")), per.filter("kept and n > 1").select("doc_id", "mark")
    stay = rows.join(gone, among(gone), "left_anti")
    if again.take(1):
        single = stay.join(again, among(again), "left_semi").dropDuplicates([doc_id, mark])
        stay = stay.join(again, among(again), "left_anti").unionByName(single)
    return stay.drop(mark)

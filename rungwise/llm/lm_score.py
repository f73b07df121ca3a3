"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

    P(word | history) = P(class of the word | history) * P(word | class)

The first factor goes down a balanced tree of CLASSES word classes (a hash of a word's last
three bytes; the end of a text is a class of its own), a softmax of two ways at each of its nodes. Its features are hashed: the word before (n-gram), the word before that
(skip) and both together, each an index into one weight table. It is trained by
gradient steps that all partitions take at once over all their training tokens; their weights are then
averaged, each weighing by the gradients it has met, in a tree of bounded groups, and all partitions go on
from the average until a round makes the training tokens likelier by less than ENOUGH. The
second factor depends on the word before as well:

    P(word | class, before) = (c(before, word) + L * p) / (c(before, class) + L)

p is the class's own word distribution with one count added to every word and one
for the unknown, so the whole sums to one. L is the one of STRENGTHS under which the
training texts are likeliest, each token left out of its own counts. In logarithms
this is p, a term of (before, class) and one of (before, word).

Texts are split into words once and kept as numbers. Counts are exact and over all training texts. Words that make up at least one part in
HEAVY of all tokens (at most HEAVY words, by arithmetic) are sent to every
worker. Every portion of texts deals its pairs, with the texts they stand in, over shards by the word before (light words by
themselves, too), packed; a shard adds up its counts and gives back one sum for each text of each portion. Words are told apart by a 64-bit hash.
pair_terms() gives the same terms as a table.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungwise.llm.common import cut, gathered, ship

CLASSES = 64
ONE, TWO = 1 << 12, 1 << 13
ROWS = 2 * ONE + TWO
HEAVY = 1 << 20
STEP, RATE = 2048, 0.1
#: Weights of so many partitions, or earlier averages, meet in one group; the table is cut into so many parts.
FAN, PARTS = 32, 16
#: Shards of pairs, and of light words: so many at least, each of some so many training tokens. A partition learns from so many at least, if there are.
SHARDS, SHARD, PUPIL = 64, 1 << 21, 1 << 21
#: Nats a training token.
ENOUGH = 0.05
#: What the word before may weigh against: so many tokens' worth of the class's own distribution.
STRENGTHS = tuple(4.0**k for k in range(-1, 11))


class Read(NamedTuple):
    """Some texts as places in a table of their distinct words; place 0 is the end of a text."""

    tokens: np.ndarray  # the place of every token, each text closed by its end
    sizes: np.ndarray  # tokens of every text
    hashes: np.ndarray  # of every place, 64 bits
    classes: np.ndarray
    features: np.ndarray


def read(texts: pa.Array) -> Read:
    """The words of UTF-8 texts (binary, no nulls), lower-cased from A to Z."""
    from xxhash import xxh3_64_intdigest

    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    words = lists.flatten()
    whole = pc.binary_length(words).to_numpy() > 0  # white space at an end leaves an empty one
    upto = np.concatenate([[0], np.cumsum(whole)])
    sizes = np.diff(upto[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])]) + 1
    coded = words.filter(pa.array(whole)).dictionary_encode()
    met = coded.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False)
    hashes = np.array([0, *(xxh3_64_intdigest(w) or 1 for w in met)], np.uint64)
    classes = np.array([0, *(1 + zlib.crc32(w[-3:]) % (CLASSES - 1) for w in met)], np.uint8)
    tokens = np.zeros(sizes.sum(), np.int32)
    inside = np.ones(len(tokens), bool)
    inside[np.cumsum(sizes) - 1] = False
    tokens[inside] = coded.indices.to_numpy() + 1
    return Read(tokens, sizes, hashes, classes, features_of(hashes))


def features_of(hashes: np.ndarray) -> np.ndarray:
    """What the words of a table, the end first, are in histories."""
    return np.append(np.uint64(1), 2 + hashes[1:] % np.uint64(0x7FFFFFFF)).astype(np.uint32)


def portions(batch: pa.RecordBatch, text: int, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts, in column `text`, hold some `most` bytes."""
    if batch.num_rows:
        marks = np.cumsum(pc.binary_length(batch.column(text)).to_numpy()) // most
        cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)


def histories(features: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the weight table for every token: word before, word before that, both. Before a text's start stand zeros."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    one = np.concatenate([[0], features[:-1]]).astype(np.uint64)
    two = np.concatenate([[0, 0], features[:-2]]).astype(np.uint64)[: len(features)]
    one[starts] = 0
    two[starts] = 0
    two[starts[sizes > 1] + 1] = 0
    k, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(40)
    a = ((one * k) >> shift) % np.uint64(ONE)
    b = ((two * k) >> shift) % np.uint64(ONE) + np.uint64(ONE)
    c = (((one * np.uint64(31) + two) * k) >> shift) % np.uint64(TWO) + np.uint64(2 * ONE)
    return a.astype(np.uint16), b.astype(np.uint16), c.astype(np.uint16)


def before(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hash of the word before every token; 1 at a text's start."""
    out = np.concatenate([np.ones(1, np.uint64), hashes[:-1]])
    out[np.cumsum(sizes) - sizes] = 1
    return out


def paired(one: np.ndarray, two: np.ndarray, salt: int) -> np.ndarray:
    """64-bit keys of pairs; each salt gives keys of a kind of its own."""
    x = one + np.uint64(salt)
    for more in (two, np.uint64(0)):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = (x ^ (x >> np.uint64(31))) + more * np.uint64(0x9E3779B97F4A7C15)
    return x


def ordered(keys: np.ndarray) -> np.ndarray:
    """Places of 64-bit keys by all but their low bits, in which the place itself is sorted along: to sort plain numbers is several times faster than argsort."""
    low = np.uint64(len(keys).bit_length())
    held = (keys >> low << low) | np.arange(len(keys), dtype=np.uint64)
    held.sort()
    return (held & ((np.uint64(1) << low) - np.uint64(1))).astype(np.intp)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct 64-bit key stands first, by key, and for every key the number of its own, as np.unique gives them."""
    order, low = ordered(keys), np.uint64(len(keys).bit_length())
    held = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(held[1:], held[:-1], out=new[1:])
    high = held >> low
    if (mixed := new[1:] & (high[1:] == high[:-1])).any():  # different keys that are alike but for the low bits
        tops = np.unique(high[1:][mixed])
        some = np.flatnonzero(np.isin(high, tops))
        order[some] = order[some][np.argsort(held[some], kind="stable")]
        held = keys[order]
        np.not_equal(held[1:], held[:-1], out=new[1:])
    inverse = np.empty(len(keys), np.intp)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse


def keys_of(hashes: np.ndarray, classes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of (word before, word) and (word before, class) for every token."""
    own = before(hashes, sizes)
    return paired(own, hashes, 0x51ED270B), paired(own, classes.astype(np.uint64), 0x2545F491)


#: The nodes from the root of the tree of classes to every class, and which way it goes there. Node k leads to 2k and 2k + 1, classes stand below the last nodes.
DEPTH = CLASSES.bit_length() - 1
NODES = np.stack([(CLASSES + np.arange(CLASSES)) >> (DEPTH - k) for k in range(DEPTH)], 1).astype(np.intp)
TURNS = np.stack([((CLASSES + np.arange(CLASSES)) >> (DEPTH - 1 - k)) & 1 for k in range(DEPTH)], 1).astype(np.float32)


def node_bias(bias: np.ndarray) -> np.ndarray:
    """Log odds of the second way at every node, from logarithms of what the classes weigh."""
    mass = np.concatenate([np.zeros(CLASSES), np.exp(bias.astype(np.float64))])
    out = np.zeros(CLASSES, np.float32)
    for k in range(CLASSES - 1, 0, -1):
        mass[k] = mass[2 * k] + mass[2 * k + 1]
        out[k] = math.log(mass[2 * k + 1] / mass[2 * k])
    return out


def ways(weights: np.ndarray, bias: np.ndarray, y: np.ndarray, *rows: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of every token and node on the way to its class: places in the flat table by feature, log odds of the second way, and whether it is taken."""
    y = y.astype(np.intp)
    nodes = NODES.take(y, 0)
    at = [((r.astype(np.intp) * CLASSES)[:, None] + nodes).ravel() for r in rows]
    z = bias.take(nodes.ravel())
    for k in at:
        z += weights.take(k)
    return at, z, TURNS.take(y, 0).ravel()


class Work:
    """The model spelt out for all classes."""

    def softmax(self, weights: np.ndarray, bias: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        z = weights[a] + weights[b] + weights[c] + node_bias(bias)
        out = np.ones((len(z), 1), np.float32)
        for k in range(DEPTH):
            second = 1 / (1 + np.exp(-z[:, 1 << k : 2 << k]))
            out = np.stack([out * (1 - second), out * second], 2).reshape(len(z), -1)
        return out


class Trainer:
    """Gradient steps on one partition's tokens, each weight with a rate of its own that falls with the gradients it has met."""

    def __init__(self, bias: np.ndarray, weights: np.ndarray | None = None, past: np.ndarray | None = None):
        self.bias, self.start = bias, node_bias(bias)
        self.weights, self.past = np.zeros((ROWS, CLASSES), np.float32), np.full((ROWS, CLASSES), 0.1, np.float32)
        # filled, not copied: arrays that come pickled have a type object of their own, with which ufunc.at is several times slower
        if weights is not None:
            self.weights[:] = weights
        if past is not None:
            self.past[:] = past
        self.tokens, self.loss = 0, 0.0
        self.work = Work()

    def learn(self, y: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> None:
        weights, past = self.weights.reshape(-1), self.past.reshape(-1)
        for k in range(0, len(y), STEP):
            at, z, turns = ways(weights, self.start, *(x[k : k + STEP] for x in (y, a, b, c)))
            np.exp(np.negative(z, out=z), out=z)
            g = 1 / (1 + z) - turns
            self.loss -= float(np.log(np.maximum(1 - np.abs(g), 1e-30)).sum())
            squares = g * g
            for rows in at:
                np.add.at(past, rows, squares)
            g *= np.float32(RATE)
            for rows in at:
                np.subtract.at(weights, rows, g / np.sqrt(past.take(rows)))
            self.tokens += len(y[k : k + STEP])


class Model:
    """Weights, bias, size of each class (words and counts and one), the heavy words."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, counts: np.ndarray, classes: np.ndarray):
        self.weights, self.bias, self.sizes = weights, bias, sizes
        ranked = np.argsort(-counts, kind="stable")  # frequent words get small numbers, which pack well
        hashes, self.counts, self.classes = hashes[ranked], counts[ranked], classes[ranked]
        self.order = np.argsort(hashes)
        self.keys = hashes[self.order]

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the heavy words, in counts and classes; -1 for all others."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.order[at], -1)

    def counts_of(self, ranks: np.ndarray) -> np.ndarray:
        """Counts by number; 0 for -1."""
        return np.append(self.counts, 0)[ranks]

    def log10(self, classes: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 of P(class | history) / the class's size, per token."""
        out, flat, bias, sizes = np.empty(len(classes)), self.weights.reshape(-1), node_bias(self.bias), np.log10(self.sizes)
        for k in range(0, len(classes), 4 * STEP):
            y = classes[k : k + 4 * STEP]
            _, z, turns = ways(flat, bias, y, *(x[k : k + 4 * STEP] for x in (a, b, c)))
            z *= 1 - 2 * turns
            np.log1p(np.exp(np.minimum(z, 80.0), out=z), out=z)
            out[k : k + 4 * STEP] = -z.reshape(-1, DEPTH).sum(1, dtype=np.float64) / math.log(10) - sizes[y]
        return out


def packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on, by as many planes of bytes as they need."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return struct.pack("<QB", len(x), width) + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n, width = struct.unpack_from("<QB", data)
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(pa.decompress(memoryview(data)[9:], n * width, codec="zstd"), np.uint8).reshape(width, n).T
    return out.view("<i8").ravel()


CODED = "doc_id array<long>, learn binary, sizes binary, hashes binary, classes binary, tokens binary, n long"


def coded(rows: DataFrame) -> DataFrame:
    """The texts of rows (doc_id long, learn boolean, text binary) as numbers, a row for each portion: texts are split into words once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in portions(batch, 2, 8 << 20)):
            own = read(part.column(2))
            learn = part.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
            ids = pa.ListArray.from_arrays(pa.array([0, len(learn)], pa.int32()), part.column(0))
            data = (learn.tobytes(), packed(own.sizes), own.hashes.tobytes(), own.classes.tobytes(), packed(own.tokens))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([x], pa.binary()) for x in data), pa.array([int(own.sizes[learn > 0].sum())])], names=[x.split()[0] for x in CODED.split(", ")])

    return cut(rows.mapInArrow(run, CODED).withColumn("portion", F.monotonically_increasing_id()))


def decoded(learn: bytes, sizes: bytes, hashes: bytes, classes: bytes, tokens: bytes) -> tuple[np.ndarray, Read]:
    """Which texts the model learns from, and the texts."""
    hashes = np.frombuffer(hashes, np.uint64)
    return np.frombuffer(learn, np.bool_), Read(unpacked(tokens), unpacked(sizes), hashes, np.frombuffer(classes, np.uint8), features_of(hashes))


CODES = ["learn", "sizes", "hashes", "classes", "tokens"]


def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, Read]]:
    """Every row of coded texts, one at a time: the row, and decoded()."""
    for row in (batch.slice(k, 1) for batch in batches for k in range(batch.num_rows)):
        yield row, *decoded(*(row.column(c)[0].as_py() for c in CODES))


def lessons(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Read]]:
    """part, and texts to learn from, of rows (part, text) or of coded ones with a column part."""
    for batch in batches:
        if "text" in batch.schema.names:
            for some in portions(batch, 1):
                yield some.column(0)[0].as_py(), read(some.column(1))
            continue
        for row, learn, own in codes(iter([batch])):
            yield row.column("part")[0].as_py(), own._replace(tokens=own.tokens[np.repeat(learn, own.sizes)], sizes=own.sizes[learn])


def word_counts(rows: DataFrame) -> DataFrame:
    """h, class, c of every token to learn from, of rows of one column (text binary) or of coded ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (read(part.column(0)) for part in portions(batch, 0)) if batch.num_columns == 1 else (own._replace(tokens=own.tokens[np.repeat(learn, own.sizes)]) for _, learn, own in codes(iter([batch])))
            for own in texts:
                n = np.bincount(own.tokens, minlength=len(own.hashes))
                met = n > 0 if batch.num_columns > 1 else slice(None)
                yield pa.RecordBatch.from_arrays([pa.array(own.hashes.view(np.int64)[met]), pa.array(own.classes.astype(np.int32)[met]), pa.array(n[met])], names=["h", "class", "n"])

    return rows.mapInArrow(run, "h long, class int, n long").groupBy("h", "class").agg(F.sum("n").alias("c"))


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, h, context, c of every (word before, word) of rows (text binary); h is the word, context the key of (word before, class)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in portions(batch, 0)):
            own = read(part.column(0))
            hashes = own.hashes[own.tokens]
            pairs, contexts = keys_of(hashes, own.classes[own.tokens], own.sizes)
            pairs, at, n = np.unique(pairs, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (pairs, hashes[at], contexts[at], n)], names=["pair", "h", "context", "n"])

    return rows.mapInArrow(run, "pair long, h long, context long, n long").groupBy("pair", "h", "context").agg(F.sum("n").alias("c"))


def pair_terms(pairs: DataFrame, counts: DataFrame, sizes: np.ndarray, total: int) -> DataFrame:
    """h, v: what the word before adds to log10 P(word | class), by the key of (before, word) and of (before, class). sizes: words and counts and one, by class."""
    size = F.element_at(F.array(*[F.lit(float(x)) for x in sizes]), F.col("class") + 1)
    # p, and p with one token of the word left out
    priced = counts.select("h", ((F.col("c") + 1) / size).alias("p"), (F.col("c") / (size - 1)).alias("less"), (F.col("c") * HEAVY >= max(1, total)).alias("heavy"))
    heavy = priced.filter("heavy").select("h", F.struct("p", "less").alias("own"))
    light = priced.filter("not heavy").select(F.col("h").alias("key"), F.struct("p", "less").alias("far"))
    # pairs of a heavy word don't gather at it in the second join
    met = pairs.join(F.broadcast(heavy), "h", "left").withColumn("key", F.when(F.col("own").isNull(), F.col("h")).otherwise(F.col("pair"))).join(light, "key", "left")
    known = cut(met.select("pair", "c", F.coalesce("own", "far").alias("w")).select("pair", "c", "w.p", "w.less"))
    contexts = cut(pairs.groupBy("context").agg(F.sum("c").alias("c")))
    gain = known.agg(*[F.sum(F.col("c") * F.log10((F.col("c") - 1) + x * F.col("less"))) for x in STRENGTHS]).first()
    loss = contexts.agg(*[F.sum(F.col("c") * F.log10((F.col("c") - 1) + x)) for x in STRENGTHS]).first()
    best = max(zip(STRENGTHS, gain, loss, strict=True), key=lambda x: (x[1] or 0.0) - (x[2] or 0.0))[0]
    words = known.select(F.col("pair").alias("h"), F.log10(1 + F.col("c") / (best * F.col("p"))).alias("v"))
    return words.unionAll(contexts.select(F.col("context").alias("h"), F.log10(best / (F.col("c") + best)).alias("v")))


def trained(rows: DataFrame, bias: np.ndarray, weights: np.ndarray | None, past: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None, float]:
    """The average of what all partitions of rows, texts (part, text) or coded ones, learn in one pass from weights and past, and the loss a token met on the way.

    In it a partition's weight counts by the gradients it has met there, so what one partition alone has met isn't thinned by the others.
    """
    start = np.full((ROWS, CLASSES), 0.1, np.float32) if past is None else past
    held = rows.sparkSession.sparkContext.broadcast((bias, weights, start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, part = Trainer(*held.value), 0
        for part, own in lessons(batches):
            trainer.learn(own.classes[own.tokens], *histories(own.features[own.tokens], own.sizes))
        if trainer.tokens:
            cuts = [pa.compress(x, codec="zstd", asbytes=True) for x in np.array_split(np.stack([trainer.weights, trainer.past - held.value[2]], 1), PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array([part] * PARTS, pa.int64()), pa.array(range(PARTS), pa.int32()), pa.array([trainer.tokens] * PARTS, pa.int64()), pa.array([trainer.loss] * PARTS, pa.float64()), pa.array(cuts, pa.binary())], names=["part", "cut", "tokens", "loss", "data"])

    def average(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        n = group["tokens"].sum()
        met = moved = 0.0
        first = None
        for data, tokens in zip(group["data"], group["tokens"], strict=True):
            both = opened(data)
            first = both[:, 0] if first is None else first
            share = both[:, 1] * np.float32(tokens / n)
            met, moved = met + share, moved + share * both[:, 0]
        both = np.stack([np.where(met > 0, moved / np.where(met > 0, met, 1), first), met], 1).astype(np.float32)
        return pd.DataFrame({"part": [key[0]], "cut": [key[1]], "tokens": [n], "loss": [group["loss"].sum()], "data": [pa.compress(both, codec="zstd", asbytes=True)]})

    def opened(data: bytes) -> np.ndarray:
        return np.frombuffer(pa.decompress(data, ROWS // PARTS * 2 * CLASSES * 4, codec="zstd"), np.float32).reshape(-1, 2, CLASSES)

    kind = "part long, cut int, tokens long, loss double, data binary"
    level = rows.mapInArrow(run, kind)
    most = rows.agg(F.max("part")).first()[0] or 0
    while True:
        level = level.withColumn("part", F.floor(F.col("part") / FAN).cast("long")).groupBy("part", "cut").applyInPandas(average, kind)
        if most < FAN:
            break
        most //= FAN
    got = {r["cut"]: r for r in gathered(level).to_pylist()}
    if not got:
        return np.zeros((ROWS, CLASSES), np.float32), None, 0.0
    both = np.concatenate([opened(got[k]["data"]) for k in range(PARTS)])
    return both[:, 0].copy(), start + both[:, 1], got[0]["loss"] / got[0]["tokens"]


def settled(rows: DataFrame, bias: np.ndarray, rounds: int | None = None) -> tuple[np.ndarray, list[float]]:
    """Weights after as many rounds as pay, `rounds` at most if given, and each round's loss a token."""
    weights = past = None
    losses: list[float] = []
    while len(losses) != rounds and (len(losses) < 2 or losses[-2] - losses[-1] >= ENOUGH):
        weights, past, loss = trained(rows, bias, weights, past)
        losses.append(loss)
        if past is None:
            break
    return np.zeros((ROWS, CLASSES), np.float32) if weights is None else weights, losses


EVENTS = ["owners", "runs", "others", "classes", "n", "met", "rows", "times"]
SENT = "shard long, portion long, " + ", ".join(f"{x} binary" for x in EVENTS)


def sent(coded_rows: DataFrame, model: Broadcast, shards: int, total: int, scored: bool) -> DataFrame:
    """What the portions know of their pairs, packed by shard.

    Shards 0 to shards - 1 hold the words before (owners) with the words that follow them: heavy ones by number, light ones by
    class only. Shards from there on hold the light words with 40 bits of the hashes of those before
    them. Each comes with the tokens to learn from and, if scored, the texts it stands in. A word before that is frequent is dealt by class, too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, learn, own in codes(batches):
            if not scored:
                own, learn = own._replace(tokens=own.tokens[np.repeat(learn, own.sizes)], sizes=own.sizes[learn]), learn[learn]
            if not len(own.tokens):
                continue
            ranks = model.value.ranks(own.hashes)
            counts = model.value.counts_of(ranks)
            tokens, hashes = own.tokens, own.hashes[own.tokens]
            last = before(hashes, own.sizes)
            common = np.concatenate([[True], counts[tokens[:-1]] * 4 * shards >= total])
            common[np.cumsum(own.sizes) - own.sizes] = True
            text = np.repeat(np.arange(len(own.sizes)), own.sizes)
            taught = np.repeat(learn, own.sizes)
            told = np.where(ranks < 0, len(model.value.keys) + own.classes.astype(np.int64), ranks)[tokens]
            far = np.flatnonzero(ranks[tokens] < 0)
            for base, keys, of in ((0, paired(last, told.astype(np.uint64), 0x51ED270B), None), (shards, paired(last[far], hashes[far], 0x51ED270B), far)):
                if not len(keys):
                    continue
                pick = (lambda x, of=of: x if of is None else x[of])
                first, inverse = grouped(keys)
                first = first if of is None else of[first]
                place = tokens[first]
                classes = own.classes[place]
                if of is None:
                    owners, others = last[first], told[first]
                    spread = np.where(common[first], paired(owners, classes.astype(np.uint64), 0x2545F491), owners)
                else:
                    owners, others = hashes[first], last[first] >> np.uint64(24)
                    spread = owners
                shard = spread % np.uint64(shards)
                wide = np.uint64(shards.bit_length())
                order = ordered((shard << (np.uint64(64) - wide)) | (owners >> wide))
                n = np.bincount(inverse[pick(taught)], minlength=len(order))[order]
                shard, owners, others, classes = (x[order] for x in (shard, owners, others, classes))
                cuts = [0, *(np.flatnonzero(np.diff(shard.astype(np.int64))) + 1).tolist(), len(order)]
                if scored:
                    rank = np.empty(len(order), np.int64)
                    rank[order] = np.arange(len(order))
                    events = np.sort(rank[inverse] * len(own.sizes) + pick(text))
                    begin = np.flatnonzero(np.concatenate([[True], events[1:] != events[:-1]]))
                    times = np.diff(np.append(begin, len(events)))
                    item, rows = np.divmod(events[begin], len(own.sizes))
                    met = np.bincount(item, minlength=len(order))
                    upto = np.concatenate([[0], np.cumsum(met)])
                out: list[list] = [[] for _ in EVENTS]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    starts = np.flatnonzero(np.concatenate([[True], owners[a + 1 : b] != owners[a : b - 1]]))
                    data = [owners[a:b][starts].tobytes(), packed(np.diff(np.append(starts, b - a)))]
                    data += [packed(others[a:b]), None if of is None else packed(classes[a:b]), packed(n[a:b])]
                    data += [packed(met[a:b]), packed(rows[upto[a] : upto[b]]), packed(times[upto[a] : upto[b]])] if scored else [None] * 3
                    for held, x in zip(out, data, strict=True):
                        held.append(x)
                ids = pa.array(shard[cuts[:-1]].astype(np.int64) + base)
                yield pa.RecordBatch.from_arrays([ids, pa.array([row.column("portion")[0].as_py()] * len(ids), pa.int64()), *(pa.array(x, pa.binary()) for x in out)], names=[x.split()[0] for x in SENT.split(", ")])

    return coded_rows.mapInArrow(run, SENT)


class Shard:
    """All portions' rows of one shard, its counts added up."""

    def __init__(self, table: pa.Table, shards: int, model: Model):
        got = table.to_pydict()
        self.light = got["shard"][0] >= shards
        joined = lambda name: np.concatenate([unpacked(x) for x in got[name]])
        self.owners = np.repeat(np.concatenate([np.frombuffer(x, np.uint64) for x in got["owners"]]), joined("runs"))
        others, n = joined("others"), joined("n")
        if self.light:
            self.classes = joined("classes")
        else:
            many = len(model.keys)
            self.counts = model.counts_of(np.where(others < many, others, -1))
            self.classes = np.concatenate([model.classes, np.arange(CLASSES)])[others]
        own = self.owners if self.light else paired(self.owners, self.classes.astype(np.uint64), 0x2545F491)
        #: of words before and class, or of light words
        self.own, self.around = self.added(own, n)
        if self.light:
            self.counts = self.around
        kept = self.counts > 0
        # a light word of no training text has no pairs there, either
        keys = np.where(kept, paired(self.owners, others.astype(np.uint64), 0x51ED270B), 0)
        self.pairs, self.both = self.added(keys, np.where(kept, n, 0))
        size = model.sizes[self.classes]
        self.price, self.less = (self.counts + 1) / size, self.counts / (size - 1)

    @staticmethod
    def added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each distinct key is met first, and for every row the n of all rows of its key."""
        first, inverse = grouped(keys)
        return first, np.bincount(inverse, n, len(first)).astype(np.int64)[inverse]

    def gains(self) -> list[float]:
        """What the training pairs here add to log10 of the training texts under each of STRENGTHS."""
        first = self.pairs[self.both[self.pairs] > 0]
        c, less = self.both[first], self.less[first]
        gain = [float((c * np.log10(c - 1 + x * less)).sum()) for x in STRENGTHS]
        if self.light:
            return gain
        c = self.around[self.own]
        c = c[c > 0]
        return [g - float((c * np.log10(c - 1 + x)).sum()) for g, x in zip(gain, STRENGTHS, strict=True)]

    def terms(self, strength: float) -> np.ndarray:
        """What every row adds to log10 P(word | class) of a token."""
        out = np.log10(1 + self.both / (strength * self.price))
        return out if self.light else out + np.log10(strength / (self.around + strength))


def strength_of(coded_rows: DataFrame, model: Broadcast, total: int, shards: int) -> float:
    """The one of STRENGTHS under which the training texts are likeliest."""

    def run(table: pa.Table) -> pa.Table:
        return pa.table({"gains": pa.array([Shard(table, shards, model.value).gains()], pa.list_(pa.float64()))})

    gains = sent(coded_rows, model, shards, total, scored=False).groupBy("shard").applyInArrow(run, "gains array<double>")
    sums = gathered(gains.agg(*[F.sum(F.col("gains")[k]).alias(f"s{k}") for k in range(len(STRENGTHS))])).to_pylist()[0].values()
    return max(zip(STRENGTHS, sums, strict=True), key=lambda x: x[1] or 0.0)[0]


PARTIAL = "portion long, text array<int>, doc_id array<long>, n array<long>, known array<long>, logs array<double>, rest array<double>, terms array<float>"


def partial_rows(portions: list[int], texts: list[np.ndarray], **lists: list) -> dict[str, pa.Array]:
    """Columns of PARTIAL, one list a portion each; those not given are null."""
    out = {"portion": pa.array(portions, pa.int64()), "text": pa.array(texts, pa.list_(pa.int32()))}
    for name, kind in (("doc_id", pa.int64()), ("n", pa.int64()), ("known", pa.int64()), ("logs", pa.float64()), ("rest", pa.float64()), ("terms", pa.float32())):
        out[name] = pa.array(lists.get(name) or [None] * len(portions), pa.list_(kind))
    return out


def looked_up(events: DataFrame, model: Broadcast, shards: int, strength: float) -> DataFrame:
    """PARTIAL of every portion and shard: what the shard's pairs and light words add to the portion's texts."""

    def run(table: pa.Table) -> pa.Table:
        own = Shard(table, shards, model.value)
        terms, at = own.terms(strength), 0
        texts, known, logs, sums = [], [], [], []
        for k in range(table.num_rows):
            met, rows, times = (unpacked(table.column(x)[k].as_py()) for x in ("met", "rows", "times"))
            each = np.repeat(np.arange(at, at + len(met)), met)
            at += len(met)
            held = np.flatnonzero(np.bincount(rows))
            added = lambda x, rows=rows, times=times, held=held: np.bincount(rows, x * times)[held]
            texts.append(held.astype(np.int32))
            sums.append(added(terms[each]).astype(np.float32))
            if own.light:
                known.append(added(own.counts[each] > 0).astype(np.int64))
                logs.append(added(np.log10(own.counts[each] + 1.0)))
        return pa.table(partial_rows(table.column("portion").to_pylist(), texts, known=known, logs=logs, terms=sums))

    return events.groupBy("shard").applyInArrow(run, PARTIAL)


def own_parts(coded_rows: DataFrame, model: Broadcast) -> DataFrame:
    """PARTIAL of every portion by itself: the class factor and the heavy words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, _, own in codes(batches):
            tokens, sizes = own.tokens, own.sizes
            starts = np.cumsum(sizes) - sizes
            c = model.value.counts_of(model.value.ranks(own.hashes))
            rest = np.add.reduceat(model.value.log10(own.classes[tokens], *histories(own.features[tokens], sizes)), starts)
            known = np.add.reduceat((c > 0).astype(np.int64)[tokens], starts)
            logs = np.add.reduceat(np.log10(c + 1.0)[tokens], starts)
            lists = partial_rows(row.column("portion").to_pylist(), [np.arange(len(sizes), dtype=np.int32)], n=[sizes], known=[known], logs=[logs], rest=[rest])
            yield pa.RecordBatch.from_pydict(lists | {"doc_id": row.column("doc_id")})

    return coded_rows.mapInArrow(run, PARTIAL)


def together(table: pa.Table) -> pa.Table:
    """doc_id, n_tokens, n_known, logs, rest of one portion's texts."""
    places = table.column("text").combine_chunks()
    lengths = places.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    texts = places.flatten().to_numpy()
    (base,) = np.flatnonzero(table.column("n").is_valid().to_numpy(zero_copy_only=False))
    size = int(lengths[base])

    def added(name: str) -> np.ndarray:
        column = table.column(name).combine_chunks()
        given = np.repeat(column.is_valid().to_numpy(zero_copy_only=False), lengths)
        return np.bincount(texts[given], column.flatten().to_numpy(zero_copy_only=False), size)

    doc_id = table.column("doc_id")[int(base)].values
    return pa.table({"doc_id": doc_id, "n_tokens": pa.array(added("n").astype(np.int64)), "n_known": pa.array(added("known").astype(np.int64)), "logs": pa.array(added("logs")), "rest": pa.array(added("rest") + added("terms"))})


def score(df: DataFrame, training: Column, rounds: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row; the model learns from the rows where `training` is true.

    Texts are lower-cased (A-Z) and split at ASCII white space; the end of the
    text is a token. Null counts as empty: one token. base_score is the sum
    over tokens of log10((c + 1) / (N + V + 1)), score the model's log10 probability
    of the text. Training goes on while it pays, for `rounds` rounds at most if given. Repeated rows and null identifiers are scored row by row. An empty table gives
    no rows; without training rows every word is unknown.
    """
    spark = ship(df.sparkSession)
    body = F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")
    texts = coded(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(training, F.lit(False)).alias("learn"), body))
    total = texts.agg(F.sum("n")).first()[0] or 0
    counts = word_counts(texts.select(*CODES))
    # HEAVY words at most, and a row per class for all others
    stats = gathered(counts.groupBy("class", F.when(F.col("c") * HEAVY >= max(1, total), F.col("h")).alias("h")).agg(F.sum("c").alias("n"), F.count("*").alias("v")))
    n, v = (np.bincount(stats.column("class").to_numpy(), stats.column(x).to_numpy(), CLASSES) for x in ("n", "v"))
    bias = np.log((n + 1) / (total + CLASSES)).astype(np.float32)
    heavy = stats.filter(stats.column("h").is_valid())
    pupils = texts.filter("n > 0").coalesce(max(1, -(-total // PUPIL)))
    weights, _ = settled(pupils.select(F.spark_partition_id().cast("long").alias("part"), *CODES), bias, rounds)
    model = spark.sparkContext.broadcast(Model(weights, bias, n + v + 1, heavy.column("h").to_numpy().view(np.uint64), heavy.column("n").to_numpy(), heavy.column("class").to_numpy().astype(np.int64)))
    shards, distinct = max(SHARDS, -(-total // SHARD)), int(v.sum())
    strength = strength_of(texts, model, total, shards)
    parts = own_parts(texts, model).unionAll(looked_up(sent(texts, model, shards, total, scored=True), model, shards, strength))
    summed = parts.groupBy("portion").applyInArrow(together, "doc_id long, n_tokens long, n_known long, logs double, rest double")
    return summed.select(
        "doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * math.log10(total + distinct + 1)).alias("base_score"),
        (F.col("logs") + F.col("rest")).alias("score"),
    )

"""Language identification by error-correcting output codes.

Every language gets a codeword. For each bit a binary classifier over hashed
byte n-grams of the lower-cased letters predicts the bit; decoding picks the
codeword with the least loss, each bit weighing by its classifier's accuracy, and flags a text
whose two best codewords are close.

The classifiers are fitted on a bounded sample of labelled rows: `per_lang`
documents of each language, those with the least hash of their identifier, and
about `most` in all, one of each language at least. Everything is scored over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rungwise.llm.common import cut, fresh, ship, small

DIM_BITS = 14
MIX = np.uint32(2654435761)
#: Rows of the sample that are spread out at once, 64 KB each.
SLAB = 128
_LETTERS = regex.compile(r"\p{L}+")


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: for up to five languages all splits into two sides, beyond that the random code of most distance found in fixed tries."""
    if n <= 1:
        return np.ones((n, 1), np.float32)
    if n <= 5:
        bits = [[1 if c >> k & 1 else -1 for k in range(n)] for c in range(1, 2 ** (n - 1))]
        return np.array(bits, np.float32).T
    best, far = None, -1
    for seed in range(64):
        code = np.random.default_rng(seed).integers(0, 2, (n, max(15, 5 * int(np.ceil(np.log2(n)))))) * 2 - 1
        gap = closest(code)
        if gap > far and (np.abs(code.sum(0)) < n).all():
            best, far = code, gap
    return best.astype(np.float32)


def closest(code: np.ndarray) -> int:
    """Bits in which the two nearest rows differ."""
    code, gap = code.astype(np.float32), code.shape[1]
    for k in range(0, len(code), 1000):
        alike = code[k : k + 1000] @ code.T
        alike[np.arange(len(alike)), np.arange(k, k + len(alike))] = -code.shape[1]
        gap = min(gap, int(round((code.shape[1] - float(alike.max())) / 2)))
    return gap


def letters(text: str) -> bytes:
    """Lower-cased letters, one space for each run of anything else, one at each end."""
    return b" " + b" ".join(w.encode("utf-8") for w in _LETTERS.findall(text.lower())) + b" "


def grams(data: np.ndarray) -> Iterator[np.ndarray]:
    """Hashed 2-, 3- and 4-grams of the bytes: where each starts."""
    b = data.astype(np.uint32)
    h = b[:-1] * np.uint32(257) + b[1:]
    for n in (2, 3, 4):
        if n > 2:
            if len(b) < n:
                return
            h = h[: len(b) - n + 1] * np.uint32(257) + b[n - 1 :]
        x = (h + np.uint32(n * 7919)) * MIX
        yield (x ^ (x >> np.uint32(15))) * MIX >> np.uint32(32 - DIM_BITS)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The text's hashed n-grams: those that occur, and their relative frequencies, square-rooted so that a repeated word doesn't drown the others."""
    data = np.frombuffer(letters(text), np.uint8)
    total = np.zeros(1 << DIM_BITS, np.int64)
    for k in range(0, len(data) if len(data) > 2 else 0, 1 << 20):  # long texts in slices that overlap by one n-gram
        for g in grams(data[k : k + (1 << 20) + 3]):
            total += np.bincount(g[: 1 << 20], minlength=1 << DIM_BITS)
    used = np.flatnonzero(total)
    v = np.sqrt(total[used]).astype(np.float32)
    return used, v / np.sqrt((v * v).sum()) if len(used) else v


class Codes:
    """The fitted classifiers: weights (features x bits), bias, weight of each bit, codewords, languages."""

    def __init__(self, langs: list[str], weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.langs, self.weights, self.bias, self.trust, self.code = langs, weights, bias, trust, codewords(len(langs))

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str], rounds: int = 60) -> Codes:
        """rows: n-grams and frequencies of every text. They stay sparse; SLAB rows at a time are spread out."""
        names = sorted(set(langs))
        code = codewords(len(names))
        at = {x: k for k, x in enumerate(names)}
        y = code[[at[v] for v in langs]] if rows else np.zeros((0, code.shape[1]), np.float32)
        w, b = np.zeros((1 << DIM_BITS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
        slab = np.zeros((SLAB, 1 << DIM_BITS), np.float32)

        def slabs() -> Iterator[tuple[slice, np.ndarray]]:
            for k in range(0, len(rows), SLAB):
                own = rows[k : k + SLAB]
                slab[:] = 0
                for j, (used, v) in enumerate(own):
                    slab[j, used] = v
                yield slice(k, k + len(own)), slab[: len(own)]

        for _ in range(rounds if len(names) > 1 else 0):  # logistic loss, full gradient
            down, shift = 1e-5 * w, np.zeros_like(b)
            for own, x in slabs():
                g = -y[own] / (1 + np.exp(y[own] * (x @ w + b)))
                down += x.T @ g / len(rows)
                shift += g.sum(0)
            w -= 20 * down
            b -= 2 * shift / len(rows)
        hit = sum((((x @ w + b > 0) == (y[own] > 0)).sum(0) for own, x in slabs()), np.zeros(code.shape[1])) / max(1, len(rows))
        return cls(names, w, b, np.maximum(2 * hit - 1, 1e-3).astype(np.float32))

    def margins(self, text: str) -> np.ndarray | None:
        used, v = counted(text)
        return v @ self.weights[used] + self.bias if len(used) else None

    def decode(self, m: np.ndarray) -> tuple[str, float, bool]:
        """Language, probability, whether the two best codewords are close."""
        loss = (np.log1p(np.exp(-np.clip(self.code * m, -30, 30))) * self.trust).sum(1) / self.trust.sum()
        p = np.exp(-8 * (loss - loss.min()))
        p /= p.sum()
        best = int(loss.argmin())
        near = len(loss) > 1 and float(np.partition(loss, 1)[1] - loss[best]) < 0.05
        return self.langs[best], float(p[best]), near


def learn(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = 400, most: int = 4000, rounds: int = 60) -> Codes:
    """Fits the codes on rows of non-null text and lang: `per_lang` of each language, fewer if that makes more than `most` in all.

    Every language is learnt, of one row at least. A language's rows are those of least hash of identifier and text, so rows of null or shared identifiers are
    told apart; rows that repeat both count once. All
    but about twice as many fall to a filter. N-grams are counted where the texts lie, so no text is
    moved; one task fits the codes on the sample's sparse counts (96 KB a row at most), and only the codes come to the driver.
    Rows of null text or lang aren't learnt from; of rows that tie in hash those of smaller counts come first; empty texts count; an
    empty table gives codes that know no language.
    """
    ship(df.sparkSession)
    rows = df.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id), F.col(text), F.lit(5)).alias("h"))
    sizes = cut(rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"), F.min("h").alias("least")))
    found = sizes.count()
    if not found:
        return Codes.fit([], [])
    each = max(1, min(per_lang, most // found))
    share = sizes.select("lang", "least", F.least(F.lit(1.0), (2.0 * each + 64) / F.col("n")).alias("share"))
    near = rows.join(small(share), "lang").filter((F.col("h").cast("double") / 2.0**64 + 0.5 <= F.col("share")) | (F.col("h") == F.col("least"))).select("lang", "h", "text")

    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()  # rows that repeat each other; the filter has left few of different hash
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            batch = batch.take(pa.array([k for k, x in enumerate(keys) if not (x in seen or seen.add(x))], pa.int64()))
            found = [counted(t.as_py()) for t in batch.column(2)]
            packed = [v.astype(np.float32).tobytes() + used.astype(np.uint16).tobytes() for used, v in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["lang", "h", "grams"])

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("lang", "ascending"), ("h", "ascending")])
        rows = []
        for x in table.column("grams"):
            data = x.as_buffer()
            n = len(data) // 6
            rows.append((np.frombuffer(data, np.uint16, n, 4 * n), np.frombuffer(data, np.float32, n)))
        own = Codes.fit(rows, table.column("lang").to_pylist(), rounds)
        return pa.table({"langs": pa.array([own.langs], pa.list_(pa.string())), **{k: pa.array([x.tobytes()], pa.binary()) for k, x in (("weights", own.weights), ("bias", own.bias), ("trust", own.trust))}})

    first = Window.partitionBy("lang").orderBy("h", "grams")
    few = near.mapInArrow(profiles, "lang string, h long, grams binary").dropDuplicates(["lang", "h", "grams"]).withColumn("r", F.row_number().over(first)).filter(F.col("r") <= each).select("lang", "h", "grams")
    (got,) = few.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(fit, "langs array<string>, weights binary, bias binary, trust binary").collect()
    weights, bias, trust = (np.frombuffer(got[k], np.float32) for k in ("weights", "bias", "trust"))
    return Codes(list(got["langs"]), weights.reshape(1 << DIM_BITS, -1), bias, trust)


def predicted(codes: Codes, spark, text: Column) -> Column:
    """A struct of lang_pred, score, ambiguous for a text column. `und`, score 0, for a null text or one without a letter, or if nothing could be learnt."""
    ship(spark)
    held = spark.sparkContext.broadcast(codes)

    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = held.value
        for batch in texts:
            out = []
            for t in batch:
                m = own.margins(t.as_py()) if t.is_valid and own.langs else None
                out.append(("und", 0.0, False) if m is None else own.decode(m))
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.bool_())], names=["lang_pred", "score", "ambiguous"])

    return F.arrow_udf(predict, "lang_pred string, score double, ambiguous boolean", F.ArrowUDFType.SCALAR_ITER)(text)


def identify(df: DataFrame, codes: Codes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for every row, null, empty and repeated ones included; an empty table gives none. No shuffle."""
    said = predicted(codes, df.sparkSession, F.col("text"))
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.select("doc_id", said.alias("said")).select("doc_id", "said.*")


def keep_known(df: DataFrame, codes: Codes, text: str = "text") -> DataFrame:
    """The rows of df, with all their columns, whose text is in some language.

    Texts that are null or hold no letter go; repeated rows stay as often as they are, null
    identifiers too. Columns may have any names. An empty table gives no rows; codes that know no language keep none.
    """
    said = fresh(df, "said")
    return df.withColumn(said, predicted(codes, df.sparkSession, F.col(text))).filter(F.col(said)["lang_pred"] != "und").drop(said)

"""Toxicity by maximum-scoring segments.

Terms (words, and word beginnings of four to six letters) get the log-odds of
toxic against clean labelled text under a Dirichlet prior proportional to the
term's overall use, counted once a document, so that a text that repeats
itself weighs no more than another. Along a text, terms of significant log-odds score those,
all other words a small penalty; one linear scan finds all maximal scoring segments. A
segment of score s in n words is set against chance by the extreme-value law
for the best segment of clean text, E = K n exp(-lambda s); a document's evidence is
the sum of -ln E over its segments of E < 1 (else its best segment's), and a logistic curve
fitted on the labelled sample turns it into a score from 0 to 1.

Labels are read of a bounded sample: of each label the `per_label` rows with the least hash of
their identifier.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungwise.llm.common import cut, ship

_LETTERS = re.compile(r"[^\W\d_]+")
PENALTY, SIGNIFICANT, LEAST = 0.4, 4.0, 3
STEMS = (6, 5, 4)


def terms(chunk: bytes) -> list[str]:
    """The words of a chunk of text, and their beginnings marked by a trailing hyphen."""
    out = []
    for w in _LETTERS.findall(chunk.decode("utf-8").lower()):
        out.append(w)
        out += [w[:n] + "-" for n in STEMS if len(w) > n]
    return out


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, end, score) of all maximal scoring subsequences, in order.

    Only positive items open segments, so the scan runs over those and takes the
    sums in between from running totals. Each held segment knows the last one
    before it that starts from a lower total, and those in between are stepped
    over; where there is none, all held are final. So the scan is linear.
    """
    total = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    done: list[tuple[int, int, float]] = []
    held: list[tuple[int, int, float, float, int]] = []  # start, end, total before, total after, the lower one's place
    for k in np.flatnonzero(scores > 0).tolist():
        start, end, before, after = k, k + 1, float(total[k]), float(total[k + 1])
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= before:
                j = held[j][4]
            if j < 0:
                done += [(a, b, r - q) for a, b, q, r, _ in held]
                held = [(start, end, before, after, -1)]
                break
            if held[j][3] >= after:
                held.append((start, end, before, after, j))
                break
            start, before = held[j][0], held[j][2]
            del held[j:]
    return done + [(a, b, r - q) for a, b, q, r, _ in held]


class Model:
    """Scores of terms, the extreme-value law's lambda and K, and the logistic curve."""

    def __init__(self, weights: dict[str, float], lam: float):
        self.weights, self.lam, self.k, self.curve = weights, lam, 1.0, (0.0, 0.0)
        self.memory: dict[bytes, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memory": {}}

    def of_chunk(self, chunk: bytes) -> float:
        """A chunk of text without white space: the sum over its words of the word's own score, else that of its longest known beginning."""
        score, get = 0.0, self.weights.get
        for w in _LETTERS.findall(chunk.decode("utf-8").lower()):
            own = get(w)
            for n in STEMS:
                if own is None and len(w) > n:
                    own = get(w[:n] + "-")
            score += -PENALTY if own is None else own
        return score or -PENALTY

    def scores(self, text: bytes) -> np.ndarray:
        chunks, memory = text.split(), self.memory
        if len(memory) > 400_000:
            memory.clear()
        for c in set(chunks).difference(memory):
            memory[c] = self.of_chunk(c)
        return np.fromiter(map(memory.__getitem__, chunks), np.float64, len(chunks))

    def segments(self, text: bytes) -> tuple[int, list[tuple[int, int, float]]]:
        s = self.scores(text)
        return len(s), maximal_segments(s)

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> float:
        chance = math.log(self.k * max(1, n))
        values = [self.lam * s - chance for _, _, s in found]
        return sum(v for v in values if v > 0) or max(values, default=-chance)

    def score(self, evidence: float) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, a + b * evidence))))


def sample(labels: DataFrame, doc_id: str, label: str, per_label: int) -> DataFrame:
    """doc_id, toxic: at most per_label rows of each label; of a document with several labels the largest counts."""
    rows = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("toxic"))
    few = [rows.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(per_label) for k in (0, 1)]
    return cut(few[0].union(few[1]))


def learn(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", per_label: int = 15_000, most_terms: int = 20_000) -> Model:
    """Fits the model on at most `per_label` labelled rows of each label; of their terms, the `most_terms` most significant count.

    Labels other than 0 and 1 and those of null identifiers are left out, of a document's several labels the largest counts, labels that tie
    in hash go by identifier. Rows of df that repeat a labelled identifier count each, null text is empty; other columns, whatever
    their names, are not read. Without labelled text of both labels, as in an empty table, the score is the share of toxic labels.
    """
    spark = ship(df.sparkSession)
    few = sample(labels, doc_id, label, per_label)
    share = {r["toxic"]: r["n"] for r in labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")).join(F.broadcast(few), "doc_id").select("toxic", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both: list[Counter] = [Counter(), Counter()]
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                both[y].update({term for chunk in set(t.as_py().split()) for term in terms(chunk)})
            keys = sorted(set(both[0]) | set(both[1]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([both[0][k] for k in keys], pa.int64()), pa.array([both[1][k] for k in keys], pa.int64())], names=["term", "clean", "toxic"])

    counts = cut(rows.mapInArrow(count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("y0"), F.sum("toxic").alias("y1")))
    whole = counts.filter(~F.col("term").endswith("-")).agg(F.sum("y0"), F.sum("y1")).first()
    n0, n1 = (whole[0] or 0) + 1.0, (whole[1] or 0) + 1.0
    prior = 0.1 * (n0 + n1)
    alpha = prior * (F.col("y0") + F.col("y1")) / (n0 + n1)
    odds = F.log((F.col("y1") + alpha) / (n1 + prior - F.col("y1") - alpha)) - F.log((F.col("y0") + alpha) / (n0 + prior - F.col("y0") - alpha))
    z = odds / F.sqrt(1 / (F.col("y1") + alpha) + 1 / (F.col("y0") + alpha))
    listed = counts.withColumns({"odds": odds, "z": z}).filter((F.col("y0") + F.col("y1") >= LEAST) & (F.abs("z") >= SIGNIFICANT)).orderBy(F.abs("z").desc(), "term").limit(most_terms).collect()
    weights = {r["term"]: max(-2.0, min(6.0, r["odds"] - PENALTY)) for r in listed}
    # lambda: the positive root of sum p exp(lambda s) = 1 over clean words
    p = np.array([(r["y0"] + prior * (r["y0"] + r["y1"]) / (n0 + n1)) / (n0 + prior) for r in listed if not r["term"].endswith("-")] or [0.0])
    s = np.array([weights[r["term"]] for r in listed if not r["term"].endswith("-")] or [0.0])
    low, high = 1e-3, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        if (p * np.exp(mid * s)).sum() + max(0.0, 1 - p.sum()) * math.exp(-mid * PENALTY) < 1:
            low = mid
        else:
            high = mid
    model = Model(weights, low)
    held = spark.sparkContext.broadcast(model)

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            found = [own.segments(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([[s for _, _, s in x] for _, x in found], pa.list_(pa.float64()))], names=["toxic", "n", "segments"])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = calibrated.value
        for batch in batches:
            found = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.evidence(n, [(0, 0, s) for s in x]) for n, x in found], pa.float64())], names=["toxic", "evidence"])

    segmented = cut(rows.mapInArrow(segment, "toxic int, n long, segments array<double>"))
    clean = [(r["n"], r["best"] or 0.0) for r in segmented.filter("toxic = 0 and n > 0").select("n", F.array_max("segments").alias("best")).collect()]
    if clean:
        model.k = max(1e-6, len(clean) / sum(n * math.exp(-model.lam * m) for n, m in clean))
    calibrated = spark.sparkContext.broadcast(model)
    fitted = segmented.mapInArrow(weigh, "toxic int, evidence double").collect()
    x = np.array([r["evidence"] for r in fitted])
    y = np.array([float(r["toxic"]) for r in fitted])
    model.curve = logistic(x, y, [share.get(0, 0), share.get(1, 0)])
    return model


def logistic(x: np.ndarray, y: np.ndarray, shares: list[int]) -> tuple[float, float]:
    """Intercept and slope by Newton steps, each label weighing as in all labels."""
    rate = (shares[1] + 0.5) / (sum(shares) + 1)
    base = math.log(rate / (1 - rate))
    if not len(x) or y.min() == y.max():
        return base, 0.0
    w = np.where(y > 0, shares[1] / y.sum(), shares[0] / (len(y) - y.sum()))
    w /= w.mean()
    a, b = base, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = np.array([(w * (y - q)).sum() - 0.001 * a, (w * (y - q) * x).sum() - 0.001 * b])
        c = w * np.maximum(q * (1 - q), 1e-9)
        h = np.array([[c.sum() + 0.001, (c * x).sum()], [(c * x).sum(), (c * x * x).sum() + 0.001]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        a, b = a + step[0], b + step[1]
        if float(np.abs(step).max()) < 1e-8:
            break
    return float(a), float(b)


def score(df: DataFrame, model: Model, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, predicted, segments (start and end in white-space chunks, score) of every row.

    Null text counts as empty, which has no segments; null identifiers and repeated rows come out row by row, texts are read
    whole, an empty table gives no rows. No shuffle.
    """
    spark = ship(df.sparkSession)
    held = spark.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            scores, spans = [], []
            for t in batch.column(1):
                n, found = own.segments(t.as_py())
                scores.append(own.score(own.evidence(n, found)))
                chance = math.log(own.k * max(1, n))
                spans.append([{"start": a, "end": b, "score": s} for a, b, s in found if own.lam * s > chance])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], names=["doc_id", "score", "segments"])

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, score double, segments array<struct<start: long, end: long, score: double>>")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

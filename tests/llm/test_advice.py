"""What the first review found done by half."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rungwise.llm import lm_score


def test_pair_terms_make_a_distribution(spark):
    texts = ["the sea the bee the sea", "a bee the tea", "a sea a bee", "the sea", ""] * 3 + ["once"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(F.col("text").cast("binary").alias("text"))
    counts = lm_score.word_counts(rows).cache()
    own = lm_score.read(pa.array([t.encode() for t in texts]))
    classes = {int(h): int(c) for h, c in zip(own.hashes, own.classes, strict=True)}
    c = {x.h & (2**64 - 1): x.c for x in counts.collect()}
    sizes = np.ones(lm_score.CLASSES)
    for h, n in c.items():
        sizes[classes[h]] += n + 1
    got = {x.h & (2**64 - 1): x.v for x in lm_score.pair_terms(lm_score.pair_counts(rows), counts, sizes, sum(c.values())).collect()}
    pairs = Counter()
    for one in np.split(own.hashes[own.tokens], np.cumsum(own.sizes)[:-1]):
        assert one[-1] == 0
        last = 1
        for h in one.tolist():
            pairs[last, h] += 1
            last = h
    contexts = Counter()
    for (last, h), n in pairs.items():
        contexts[last, classes[h]] += n
    key = lambda a, b, salt: int(lm_score.paired(np.array([a], np.uint64), np.array([b], np.uint64), salt)[0])
    assert len(got) == len(pairs) + len(contexts)
    strengths = set()
    for (last, k), n in contexts.items():
        v = got[key(last, k, 0x2545F491)]
        strengths.add(round(n * 10**v / (1 - 10**v), 6))
        inside = sum((c[h] + 1) / sizes[k] * 10 ** got.get(key(last, h, 0x51ED270B), 0.0) for h in c if classes[h] == k)
        assert math.isclose(10**v * (inside + 1 / sizes[k]), 1)
    (strength,) = strengths
    left_out = {x: sum(n * math.log10(n - 1 + x * c[h] / (sizes[classes[h]] - 1)) for (_, h), n in pairs.items()) - sum(n * math.log10(n - 1 + x) for n in contexts.values()) for x in lm_score.STRENGTHS}
    assert strength == max(left_out, key=left_out.get)


def test_the_word_before_tells_words_of_one_class_apart(spark):
    rows = [(i, "p aword" if i % 2 else "q bword") for i in range(200)] + [(1000, "p aword"), (1001, "p bword")]
    got = {x.doc_id: x.score for x in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 1000).collect()}
    assert got[1000] > got[1001] + 1


def test_many_words_each_follow_their_own(spark):
    """More pairs than the class factor has rows."""
    n = lm_score.ROWS
    texts = [" ".join(f"x{k}same y{k}same" for k in range(a, a + 64)) for a in range(0, n, 64)]
    rows = [(i, t) for i, t in enumerate(texts * 4)] + [(10_000, texts[5])]
    got = {x.doc_id: x.score / x.n_tokens for x in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 10_000).filter("doc_id = 10000").collect()}
    assert got[10_000] > -2.5


def test_training_goes_on_from_the_average_while_it_pays(spark):
    rows = spark.range(4000).select((F.col("id") % 40).alias("part"), F.concat_ws(" ", F.lit("a b"), F.expr("concat('c', id % 5)"), F.expr("concat('d', id % 5)")).cast("binary").alias("text")).repartition(40, "part")
    flat = np.zeros(lm_score.CLASSES, np.float32)
    _, losses = lm_score.settled(rows, flat)
    gains = [a - b for a, b in zip(losses, losses[1:], strict=False)]
    assert len(losses) > 2 and gains[0] > 0.3 and all(g >= lm_score.ENOUGH for g in gains[:-1]) and gains[-1] < lm_score.ENOUGH
    assert len(lm_score.settled(rows, flat, 1)[1]) == 1
    assert len(lm_score.settled(rows.limit(0), flat)[1]) == 1


def test_words_are_read_as_defined():
    texts = ["", "  \n", "The end ", "\tÜnï THE\x1cx", "a  b"]
    own = lm_score.read(pa.array([t.encode() for t in texts]))
    want = [[], [], ["the", "end"], ["Ünï", "the\x1cx"], ["a", "b"]]
    assert own.sizes.tolist() == [len(w) + 1 for w in want]
    from xxhash import xxh3_64_intdigest

    assert own.hashes[own.tokens].tolist() == [h for w in want for h in [*(xxh3_64_intdigest(x.encode()) for x in w), 0]]


def test_scores_by_shards_are_those_of_all_pairs(spark, monkeypatch):
    """Words of any frequency, in and out of the training texts, over many portions and shards; classes by their bias alone."""
    monkeypatch.setattr(lm_score, "HEAVY", 60)
    monkeypatch.setattr(lm_score, "settled", lambda *_: (np.zeros((lm_score.ROWS, lm_score.CLASSES), np.float32), []))
    texts = [" ".join(f"w{(i * i + k * (i % 7 + 1)) % (3 + k * 5)}x{k % 4}" for k in range(i % 23)) for i in range(90)] + ["new words x1 w1x1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = {r.doc_id: r for r in lm_score.score(df, F.col("doc_id") < 60).collect()}
    learnt = spark.createDataFrame([(t.encode(),) for t in texts[:60]], "text binary")
    counts = lm_score.word_counts(learnt).cache()
    c = {r.h & (2**64 - 1): r.c for r in counts.collect()}
    total = sum(c.values())
    assert 3 < sum(x * 60 >= total for x in c.values()) < len(c) - 3
    n, sizes = np.zeros(lm_score.CLASSES), np.ones(lm_score.CLASSES)
    for r in counts.collect():
        n[r["class"]] += r.c
        sizes[r["class"]] += r.c + 1
    terms = {r.h & (2**64 - 1): r.v for r in lm_score.pair_terms(lm_score.pair_counts(learnt), counts, sizes, total).collect()}
    for i, text in enumerate(texts):
        own = lm_score.read(pa.array([text.encode()]))
        hashes, classes = own.hashes[own.tokens], own.classes[own.tokens]
        keys = lm_score.keys_of(hashes, classes, own.sizes)
        want = sum(math.log10((n[k] + 1) / (total + lm_score.CLASSES) * (c.get(int(h), 0) + 1) / sizes[k]) for h, k in zip(hashes, classes, strict=True))
        want += sum(terms.get(int(x), 0.0) for x in np.concatenate(keys))
        assert math.isclose(got[i].score, want, abs_tol=1e-4), (i, got[i].score, want)
        assert got[i].n_known == sum(int(h) in c for h in hashes) and got[i].n_tokens == len(hashes)


def test_the_way_to_a_class_has_its_probability():
    r = np.random.default_rng(0)
    w = r.normal(size=(lm_score.ROWS, lm_score.CLASSES)).astype(np.float32)
    a, b, c = lm_score.histories(r.integers(1, 1000, 64), np.array([20, 1, 43]))
    bias = np.log(r.dirichlet(np.ones(lm_score.CLASSES))).astype(np.float32)
    none = np.zeros(0, np.int64)
    own = lm_score.Model(w, bias, np.ones(lm_score.CLASSES), none.astype(np.uint64), none, none).log10(np.arange(64), a, b, c)
    assert np.allclose(10**own, lm_score.Work().softmax(w, bias, a, b, c)[np.arange(64), np.arange(64)], rtol=1e-3)


def test_keys_are_grouped_as_unique_groups_them():
    r = np.random.default_rng(7)
    near = np.repeat(r.integers(0, 1 << 63, 50), 60).astype(np.uint64) + r.integers(0, 9, 3000).astype(np.uint64)  # alike but for the low bits
    for keys in (np.zeros(0, np.uint64), np.zeros(1, np.uint64), r.integers(0, 50, 1000).astype(np.uint64), near, np.append(r.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2), near)):
        _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        got = lm_score.grouped(keys)
        assert (got[0] == first).all() and (got[1] == inverse).all()

"""Exponion clustering, the Jaccard join and whitening against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rungwise.llm import exponion, jaccard_join, minhash, queries, whitening

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, cluster string, n string, x string, v string, dim string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "clash", "clash", "clash", "clash", "clash") for i, v in rows], VECTORS).repartition(3)


def brute_clusters(rows, k, rounds, width, scale=256):
    kept = [(i, [math.floor(Fraction(c) * scale) for c in v]) for i, v in rows if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    raw = {id(x): v for (_, x), v in zip(kept, [v for _, v in rows if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)], strict=True)}
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", raw[id(r[1])]))[:k]
    centroids = [list(x) for _, x in first]

    def assign():
        out = []
        for _, x in kept:
            far = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in centroids]
            out.append((far.index(min(far)), min(far)))
        return out

    for _ in range(rounds):
        found = assign()
        for c in range(len(centroids)):
            own = [x for (_, x), (a, _) in zip(kept, found, strict=True) if a == c]
            if own:
                centroids[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    found = assign()
    held = lambda d: d if d < 1 << 63 else None
    return Counter(
        (i, a, held(d), None if any(held(e) is None for b, e in found if b == a) else held(sum(e for b, e in found if b == a)), None if any(held(e) is None for _, e in found) else held(sum(e for _, e in found)), hashlib.sha256(",".join(map(str, centroids[a])).encode()).hexdigest())
        for (i, _), (a, d) in zip(kept, found, strict=True)
    )


def test_clusters_by_brute_force(spark):
    r = random.Random(4)
    rows = [(i, [r.choice([0.0, 0.25, 1.0, -0.3]) + r.random() / 8 for _ in range(5)]) for i in range(300)]
    rows += [(None, rows[0][1]), (None, [9.0] * 5), rows[1], (3, rows[7][1]), (400, None), (401, [1.0] * 4), (402, [1.0, None, 0.0, 0.0, 0.0]), (403, [math.inf] + [0.0] * 4), (404, [math.nan] + [0.0] * 4)]
    rows += [(500 + k, [0.5] * 5) for k in range(60)]  # a group of copies
    for k in (1, 2, 12, 1000):
        got = Counter(tuple(x) for x in exponion.cluster(vectors(spark, rows), k=k, rounds=3, width=5).collect())
        assert got == brute_clusters(rows, k, 3, 5), k
    assert exponion.cluster(vectors(spark, rows[:0]), k=3, width=5).count() == 0


def test_clusters_of_huge_components_are_exact(spark):
    r = random.Random(5)
    for top in (1e4, 1e6, 1e15, 1e300):
        rows = [(i, [r.uniform(-top, top), r.uniform(-1, 1)]) for i in range(40)]
        got = Counter(tuple(x) for x in exponion.cluster(vectors(spark, rows), k=4, rounds=2, width=2).collect())
        assert got == brute_clusters(rows, 4, 2, 2), top


@given(st.integers(1, 40), st.integers(0, 10**6), st.booleans())
@settings(max_examples=60, deadline=None)
def test_the_ball_holds_every_nearest_centroid(k, seed, lattice):
    """Ties included: on a lattice many distances are equal."""
    r = np.random.default_rng(seed)
    points = lambda n: tuple(map(tuple, (r.integers(0, 4, (n, 3)) if lattice else r.integers(-500, 500, (n, 3))).tolist()))
    x, c = np.array(points(200), np.float64), None
    now = exponion.fresh_state(200)
    tried = 0
    for _ in range(4):
        c = exponion.Centroids(list(points(k)) if c is None else [tuple(int(v + d) for v, d in zip(row, r.integers(-1, 2, 3), strict=True)) for row in c.rows], c)
        tried += exponion.search(x, *now, c)
        far = ((x[:, None] - c.at[None]) ** 2).sum(-1)
        assert (now[0] == far.argmin(1)).all()
        assert (now[1] ** 2 >= far.min(1) - 1e-6).all()
        far[np.arange(200), now[0]] = np.inf
        assert (now[2] <= np.sqrt(far.min(1)) + 1e-6).all()


def test_the_search_leaves_most_centroids_alone():
    r = np.random.default_rng(2)
    middle = r.normal(0, 2000, (100, 8))
    x = np.round(middle[r.integers(0, 100, 4000)] + r.normal(0, 40, (4000, 8)))
    c, now, work = exponion.Centroids([tuple(map(int, v)) for v in middle]), exponion.fresh_state(4000), []
    for _ in range(3):
        work.append(exponion.search(x, *now, c))
        c = exponion.Centroids([tuple(int(v + 1) for v in row) for row in c.rows], c)
    assert work[0] <= 4000 * 101 and max(work[1:]) < 4000 * 5


def test_limbs():
    for total in ([0], [-1, 5], [2**31, -(2**31)], [2**200 + 7, -(2**199) - 1]):
        limbs = exponion.limbs_of(total)
        assert [sum(x[j] << 32 * k for k, x in enumerate(limbs)) for j in range(len(total))] == total


# the join


def brute_join(rows, words, percent):
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append(frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset())
    by = defaultdict(list)
    for n, s in enumerate(sets):
        for x in s:
            by[x].append(n)
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, s in enumerate(sets):
        for m, both in Counter(m for x in s for m in by[x] if m < n).items():
            if 100 * both >= percent * (len(s) + len(sets[m]) - both):
                root[max(top(n), top(m))] = min(top(n), top(m))
    groups = defaultdict(list)
    for n in range(len(rows)):
        groups[top(n)].append(n)
    out = Counter()
    for group in groups.values():
        least = min((rows[n][0] is None, rows[n][0] or 0) for n in group)
        out.update((rows[n][0], len(sets[n]), None if least[0] else least[1]) for n in group)
    return out


def corpus(seed, bases, copies, size, edits):
    r = random.Random(seed)
    rows = []
    for b in range(bases):
        base = [f"w{r.randrange(3000)}" for _ in range(size)]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randrange(edits + 1)):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    return rows


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash", "clash", "clash") for i, t in rows], "doc_id long, text string, key string, root string, n string, image string").repartition(3)


AWKWARD = [(900, None), (901, ""), (902, " \t "), (903, "One"), (904, "one"), (None, "one"), (905, "two words"), (905, "two words"), (905, "Two WORDS!"), (None, None), (None, "alone here now"), (906, "é É é"), (907, "É é é")]


@pytest.mark.parametrize(("block", "percent"), [(1024, 60), (8, 90)])
def test_join_by_brute_force(spark, monkeypatch, block, percent):
    """With small blocks regions are split between tasks, too."""
    for module in (jaccard_join, minhash):
        monkeypatch.setattr(module, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "LEAF", min(jaccard_join.LEAF, block))
    rows = corpus(1, 6, 30, 80, 6) + [(1000 + i, t) for i, t in corpus(2, 3, 20, 12, 1)] + AWKWARD
    rows.append((2000, " ".join(f"w{k % 977}" for k in range(30_000))))
    got = Counter(tuple(r) for r in jaccard_join.join(docs_of(spark, rows), percent).collect())
    assert got == brute_join(rows, 3, percent)
    assert jaccard_join.join(docs_of(spark, rows[:0])).count() == 0


def test_join_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = Counter(tuple(r) for r in queries.op12_jaccard_join(spark, SF).collect())
    assert got == brute_join([(r.doc_id, r.text) for r in docs.collect()], 3, 90)


@given(st.integers(0, 10**6), st.sampled_from([50, 75, 90]))
@settings(max_examples=8, deadline=None)
def test_images_and_windows_lose_nothing(seed, percent):
    r = np.random.default_rng(seed)
    size = 60 if seed % 2 else 1500
    base = r.integers(0, 2**62, size).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[r.random(size) > 0.15 * r.random()], r.integers(0, 2**62, int(r.integers(0, 8))).astype(np.uint64)])) for _ in range(60)]
    sets = [s if len(s) else base[:1] for s in sets]
    sizes = np.array([len(s) for s in sets])
    full = np.array([*(jaccard_join.image(s) for s in sets), None], object)[:-1]
    images = jaccard_join.words_of(full)
    least = jaccard_join.gap(images, sizes, images, sizes)
    assert all(jaccard_join.apart(full[i], full[j]) <= len(np.setxor1d(sets[i], sets[j])) for i in range(0, 60, 5) for j in range(0, 60, 7))
    true = np.array([[len(np.setxor1d(a, b)) for b in sets] for a in sets])
    assert (least <= true).all()
    far = jaccard_join.distance(least, sizes, sizes)
    for k in range(0, 60, 17):  # the triangle inequality by way of k
        assert (far <= far[:, [k]] + far[[k], :] + 1e-9).all()
    n = len(sets)
    both = [x for k in range(2) for x in range(n)]
    found = set()
    asks = np.array([0] * n + [1] * n)
    for a, b in jaccard_join.possible(images[both], full[both], sizes[both], np.array(both), asks, percent):
        found |= {(both[i], both[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    alone = {(i, j) for a, b in jaccard_join.possible(images, full, sizes, np.arange(n), np.full(n, -1), percent) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    assert alone == found
    for i in range(n):
        for j in range(n):
            if i != j and jaccard_join.linked(sets[i], sets[j], percent):
                assert (i, j) in found


# whitening


def brute_products(x):
    n, sums = len(x), [sum(col) for col in zip(*x, strict=True)]
    y = [[n * v - s for v, s in zip(row, sums, strict=True)] for row in x]
    return [sum(a * b for a, b in zip(p, q, strict=True)) for p in zip(*y, strict=True) for q in zip(*y, strict=True)]


@given(st.integers(1, 4), st.integers(1, 30), st.sampled_from([1, 10, 2**20, 2**40, 2**62]), st.randoms())
@settings(max_examples=80, deadline=None)
def test_products_are_exact(dim, n, top, r):
    x = [[r.randint(-top, top) for _ in range(dim)] for _ in range(n)]
    sums = [sum(col) for col in zip(*x, strict=True)]
    got = whitening.product(whitening.centred(np.array(x, np.int64), n, sums)).ravel().tolist()
    assert got == brute_products(x)
    assert whitening.load(*whitening.dump(got)) == got


def check_whitened(got, rows, scale=256, most=4):
    kept = [(i, [math.floor(Fraction(c) * scale) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    by_dim = defaultdict(list)
    for i, x in kept:
        by_dim[len(x)].append((i, x))
    assert len(got) == sum(min(len(x), most) for _, x in kept)
    for dim, own in by_dim.items():
        fit = sorted({tuple(x) for _, x in own})
        n, sums = len(fit), [sum(col) for col in zip(*fit, strict=True)]
        cube = Fraction(n) ** 3
        spread = np.array([float(p / cube) for p in brute_products(fit)]).reshape(dim, dim)
        size = np.linalg.eigvalsh(spread)[::-1][:most]
        for k in range(min(dim, most)):
            mine = [r for r in got if r["component"] == k + 1]
            want = Counter((i, n, (d if d < 1 << 63 else None)) for i, x in own for d in [sum((n * v - s) ** 2 for v, s in zip(x, sums, strict=True))])
            assert want <= Counter((r["vec_id"], r["n"], r["deviation"]) for r in mine)
            if np.trace(spread):
                assert min(abs(r["explained"] - size[k] / np.trace(spread)) for r in mine) < 1e-9


def test_whitening_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    r = random.Random(3)
    rows = [(i, [r.gauss(0, s) for s in (3, 2, 1, 0.5, 0.25, 0.2)]) for i in range(200)]
    awkward = [(None, rows[0][1]), rows[1], (1005, rows[1][1]), (300, None), (301, []), (302, [1.0, None]), (303, [math.nan]), (304, [-math.inf, 1.0])]
    df = vectors(spark, rows + awkward).repartition(5)
    got = [x.asDict() for x in whitening.whiten(df).collect()]
    check_whitened(got, rows + awkward)
    fit = {tuple(math.floor(256 * c) for c in v) for _, v in rows}
    own = {(x["vec_id"], x["component"]): x["whitened"] for x in got}
    w = np.array([[own[i, k] for k in range(1, 5)] for i, _ in rows])
    assert len(fit) == 200 and np.abs(w.T @ w / 200 - np.eye(4)).max() < 1e-9 and np.abs(w.mean(0)).max() < 1e-9
    assert len({x["identity_error"] for x in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_whitening_of_odd_tables(spark):
    same = [(i, [1.5, -2.0, 0.0]) for i in range(4)]
    got = whitening.whiten(vectors(spark, same)).collect()
    assert len(got) == 12 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None and r.identity_error is None for r in got)
    mixed = [(1, [1.0]), (2, [2.0]), (3, [1e300]), (4, [0.0, 1.0]), (5, [0.0, 3.0])]
    got = whitening.whiten(vectors(spark, mixed)).collect()
    assert len(got) == 3 + 4 and {r.n for r in got if r.vec_id < 4} == {3}
    flat = [r for r in got if r.vec_id >= 4 and r.component == 2]
    assert [r.whitened for r in flat] == [None, None] and all(abs(abs(r.whitened) - 1) < 1e-12 for r in got if r.vec_id >= 4 and r.component == 1)
    assert whitening.whiten(vectors(spark, [])).count() == 0


def test_queries_on_vectors(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = Counter(tuple(r) for r in queries.op11_centroid_clustering(spark, SF).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())
    assert got == brute_clusters(rows, 40, 5, 64)
    out = queries.op13_whitening(spark, SF)
    assert out.agg(F.max("identity_error")).first()[0] < 1e-4
    check_whitened([r.asDict() for r in out.collect()], rows)

"""Each operator against brute force on small tables that hold the awkward cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rungwise.llm import exact_dedup, html_extract, langid, lm_score, minhash, mixing, neighbours, packing, queries, token_counts, toxicity
from rungwise.llm.components import components
from rungwise.llm.wordbpe import ChunkCoder

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed, pool=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows and columns whose names clash with results."""
    base = words(120, 1)
    texts = [None, "", "  \n", "The END", "the end", "THE end ", base, base.upper(), base + " more words at the end", words(50_000, 3), "a b", "a b", "Ünï çödé", "123 ²½ !!", words(3, 4)]
    rows = [(i, t, ["en", "de", None][i % 3], ["b", "a", None, "B"][i % 4], 0) for i, t in enumerate(texts)]
    rows += [rows[6], (None, "lost", None, None, None), (10**12, base, "en", "a", 5)]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("kept", "size", "score", "n_tokens", "queue", "row", "taken", "key")}).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


coder = None


@given(st.text(st.sampled_from("abZ \t\n'.,!?09éÉßİſ½²\xa0\x1c\x7f\x00日Σς<|>endoftx«"), max_size=40))
@settings(max_examples=400, deadline=None)
def test_ids_are_the_librarys(text):
    global coder, _library
    if coder is None:
        from tokenizers import Tokenizer

        coder, _library = ChunkCoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    for t in (text, text + "<|endoftext|>", "don't " + text):
        assert np.frombuffer(next(coder.encode([t.encode()])), coder.kind).tolist() == _library.encode(t, add_special_tokens=False).ids


def test_a_small_memory_changes_nothing(library):
    small = ChunkCoder(VOCABULARY, limit=3)
    texts = [words(30, k) for k in range(5)]
    got = list(small.encode([t.encode() for t in texts], most=100))
    assert [np.frombuffer(g, small.kind).tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_counts(docs, empty, library):
    got = Counter(tuple(r.values()) for r in rows_of(token_counts.token_counts(docs, VOCABULARY)))
    want = Counter()
    for r in docs.collect():
        t = r.text or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        want[(r.doc_id, len(t.encode()), n, n > 2048)] += 1
    assert got == want
    assert token_counts.token_counts(empty, VOCABULARY).count() == 0


# exact dedup


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize(("keep", "pick", "fan"), [("max", max, 2), ("min", min, 16)])
def test_exact_dedup(docs, empty, keep, pick, fan):
    groups = defaultdict(list)
    for r in docs.collect():
        groups[lowered(r.text)].append(r.doc_id)
    got = rows_of(exact_dedup.exact_dedup(docs, keep=keep, fan=fan))
    assert len(got) == docs.count()
    for r in got:
        group = next(g for g in groups.values() if r["doc_id"] in g)
        assert r["keep_id"] == (pick(group) if group != [None] else None) and r["group_size"] == len(group)
    assert sum(r["kept"] for r in got) == len(groups)
    assert exact_dedup.exact_dedup(empty).count() == 0
    stay = exact_dedup.drop_copies(docs, keep=keep)
    assert stay.columns == docs.columns and stay.count() == len(groups)


def test_exact_dedup_runs_no_python(docs):
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# mixing


def test_mixing(docs, empty):
    got = rows_of(mixing.mix(docs))
    size = {}
    for r in docs.collect():
        size.setdefault(r.source, 0)
        size[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    target = targets(size)
    by = defaultdict(list)
    source = {r.doc_id: r.source for r in docs.collect()}
    for r in got:
        by[source[r["doc_id"]]].append(r)
        assert r["taken"] <= 2 * r["size"] and r["source_size"] == size[source[r["doc_id"]]]
    for s, mine in by.items():
        assert mine[0]["target"] == pytest.approx(target[s])
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= max(r["size"] for r in mine) / 2 + 1e-6
    assert sorted(map(str, got)) == sorted(map(str, rows_of(mixing.mix(docs))))
    assert mixing.mix(empty).count() == 0
    taken = Counter(r["doc_id"] for r in mixing.mixed_rows(docs).select("doc_id").collect())
    assert taken == Counter({k: v for k, v in sum((Counter({r["doc_id"]: r["epochs"]}) for r in got), Counter()).items() if v})


def targets(size, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, open_, left = {}, set(names), share * sum(size.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > most * size[s]}
        if not over:
            return out | {s: weight[s] * level for s in open_}
        for s in over:
            out[s] = most * size[s]
            left -= out[s]
        open_ -= over
    return out


def test_one_hot_source_is_cut_near_its_budget(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('x ', cast(1 + id % 40 as int))").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    rows = mixing.mix(df).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max("size").alias("most")).collect()
    assert all(abs(r.taken - r.target) <= r.most for r in rows)


# language model


def test_lm_score(spark, docs, empty):
    many = spark.createDataFrame([(i, words(60, i, 50) if i % 2 else " ".join(f"v{(i * 7 + k) % 30}" for k in range(60)), None, "s", 0) for i in range(200)], DOCS)
    df = docs.select("doc_id", "text").union(many.select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 100))
    held = F.col("doc_id") % 7 == 2
    got = rows_of(lm_score.score(df, ~F.coalesce(held, F.lit(False))))
    tokens = lambda t: lowered(t).encode().split() + [b" end"]
    count = Counter()
    for r in df.collect():
        if r.doc_id is None or r.doc_id % 7 != 2:
            count.update(tokens(r.text))
    n, v = sum(count.values()), len(count)
    want = Counter((r.doc_id, len(tokens(r.text)), sum(count[w] > 0 for w in tokens(r.text)), round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(r.text)), 6)) for r in df.collect())
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == n for r in got)
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert lm_score.score(empty, F.lit(True)).count() == 0
    (untaught,) = rows_of(lm_score.score(df.filter("doc_id = 3"), F.lit(False)))
    assert untaught["base_score"] == 0 and untaught["n_known"] == 0


def test_the_model_is_a_distribution():
    r = np.random.default_rng(0)
    w = r.normal(size=(lm_score.ROWS, lm_score.CLASSES)).astype(np.float32)
    a, b, c = lm_score.histories(r.integers(1, 1000, 50), np.array([20, 1, 29]))
    p = lm_score.Work().softmax(w, np.zeros(lm_score.CLASSES, np.float32), a, b, c)
    assert np.allclose(p.sum(1), 1, atol=1e-5)
    assert a[0] == a[20] == a[21] and b[0] == b[1] == b[22]


def test_training_learns_a_rule():
    y = np.tile(np.array([1, 2, 3]), 100_000)
    a, b, c = lm_score.histories(y.astype(np.int64) + 5, np.array([len(y)]))
    t = lm_score.Trainer(np.zeros(lm_score.CLASSES, np.float32))
    t.learn(y, a, b, c)
    p = t.work.softmax(t.weights, t.bias, a[-100:], b[-100:], c[-100:])
    assert p[np.arange(100), y[-100:]].mean() > 0.8


# pages


PAGE = """<!DOCTYPE html><html><head><title>No</title><script>var t="</p><article>no";</script></head><body class="home">
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Menu<li><a>Two</a></ul></nav><div class="cookie-notice">We use cookies</div>
<main><article><header><h1>Head &amp; line</h1><span>By me</span></header><p>First   para&nbsp;one<br>two <b>bold<p>Short.</p><div class="ad">Buy</div><blockquote>Quote</blockquote>
<aside>Aside</aside><p>Last &lt;para&gt;</p><form><input>Send<button>Go</button></form></article><section id="comments"><p>Reader comment long enough to count as text</p></section></main>
<aside class="sidebar">Side</aside><footer>&copy; me</footer></body></html>"""


def test_html_extraction(spark):
    assert html_extract.main_text(PAGE) == "Head & line First para one two bold Short. Quote Last <para>"
    bare = "<body><div>" + "<ul>" + "<li><a>Link</a></li>" * 5 + "</ul></div><div class=menu>x</div><div><p>" + "real text " * 30 + "</p><p>more</p></div><div class='footer'>f</div></body>"
    assert html_extract.main_text(bare).endswith("text more") and "Link" not in html_extract.main_text(bare)
    for page in (None, "", "<nav>only</nav>", "<script>x", "<p", "<!-- x"):
        assert html_extract.main_text(page) == ""
    assert html_extract.main_text("<nav><a>open<article><p>Body text</article>") == "Body text"
    assert html_extract.main_text("plain text") == "plain text"
    df = spark.createDataFrame([(1, "u", PAGE, "c"), (1, "u", PAGE, "c"), (None, None, None, None)], "page_id long, url string, html string, text string")
    got = html_extract.extract(df).collect()
    assert len(got) == 3 and sorted(r.n_chars for r in got) == [0, 60, 60]
    assert html_extract.extract(df.limit(0)).count() == 0


# toxicity


def brute_segments(s):
    """By definition: recursively the best segment, then those on either side of it."""

    def best(a, b):
        top = max(((sum(s[i:j]), i - j, -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
        if top is None or top[0] <= 0:
            return []
        _, _, _, i, j = top
        return best(a, i) + [(i, j)] + best(j, b)

    return best(0, len(s))


@given(st.lists(st.integers(-6, 5), max_size=14))
@settings(max_examples=300, deadline=None)
def test_maximal_segments(scores):
    got = toxicity.maximal_segments(np.array(scores, float))
    # ties may shift ends over stretches of sum zero; scores are the same
    assert sorted(x for _, _, x in got) == sorted(float(sum(scores[i:j])) for i, j in brute_segments(scores))
    assert all(sum(scores[a:b]) == x for a, b, x in got)


def test_toxicity(spark, empty):
    r = random.Random(5)
    bad = ["vile", "nasty", "rotten"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 10 == 0
        text = [f"w{r.randrange(200)}" for _ in range(r.randint(10, 80))]
        if toxic:
            for _ in range(3):
                text.insert(r.randrange(len(text)), r.choice(bad) + r.choice(["", "ness", "ly"]))
        rows.append((i, " ".join(text), None, None, 0))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None, None, None, 0), (1001, "", None, None, 0), (None, "vile nasty rotten", None, None, 0)]
    df = spark.createDataFrame(rows, DOCS).withColumn("predicted", F.lit("clash"))
    marks = spark.createDataFrame(labels + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(df, marks.filter("doc_id % 3 <> 2 or doc_id is null"))
    got = {x["doc_id"]: x for x in rows_of(toxicity.score(df, model))}
    wrong = [i for i in range(600) if got[i]["predicted"] != (i % 10 == 0)]
    assert len(wrong) <= 6 and len(got) == 603
    assert got[1000]["predicted"] == got[1001]["predicted"] == 0 and got[None]["predicted"] == 1
    assert all(0 <= x["score"] <= 1 for x in got.values()) and got[0]["segments"]
    assert toxicity.score(empty, model).count() == 0
    nothing = toxicity.learn(empty, marks)
    assert {x["predicted"] for x in rows_of(toxicity.score(df, nothing))} == {0}


# neighbours


def test_chi_square():
    draws = (np.random.default_rng(1).standard_normal((200_000, neighbours.M)) ** 2).sum(1)
    for x in (2.0, 8.0, 15.0):
        assert neighbours.chi_square(x) == pytest.approx((draws < x).mean(), abs=0.01)
    assert neighbours.chi_square(neighbours.quantile(0.9)) == pytest.approx(0.9)


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 300)
    r = np.random.default_rng(2)
    centres = r.normal(size=(8, 16)) * 3
    v = (centres[r.integers(0, 8, 1500)] + r.normal(size=(1500, 16))).astype(np.float32)
    v[7] = v[100]
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan")] * 16, 0), (2003, [1.0, None] * 8, 0), (None, v[1].tolist(), 0), (3000, [1.0, 2.0], 0), (3001, [1.0, 3.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rank", F.lit("clash"))
    got = defaultdict(list)
    for x in neighbours.nearest(df).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    hits = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((v.astype(float) - v[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(1500), d))[:10]
        assert [s for _, s in got[q]] == sorted(s for _, s in got[q]) and all(s == pytest.approx(d[i], abs=1e-12) for i, s in got[q])
        hits += len({i for i, _ in got[q]} & set(want.tolist()))
    assert hits >= 0.9 * 150
    assert got[100][0] == (7, 0.0) and [i for i, _ in got[3000]] == [3001]
    assert set(got) == {*range(0, 1500, 100), 3000}
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_nearest_equals_brute_force_on_copies(spark, monkeypatch):
    """Repeated identifiers, a large group of copies and several cells."""
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    monkeypatch.setattr(neighbours, "LEAST", 4)
    r = np.random.default_rng(5)
    v = np.concatenate([r.normal(size=(900, 6)) * 3, np.tile(r.normal(size=6), (500, 1))])
    ids = [*range(1400)]
    ids[1], ids[7], ids[950] = 3, 200, 300
    df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<double>").repartition(5)
    got = defaultdict(list)
    for x in neighbours.nearest(df).collect():
        got[x.query_id].append((x.rank, x.vec_id, round(x.score, 9)))
    want = defaultdict(list)
    for k, q in enumerate(ids):
        if q % 100 == 0:
            d = np.sqrt(((v - v[k]) ** 2).sum(1))
            order = [j for j in sorted(range(1400), key=lambda j: (round(d[j], 12), ids[j])) if j != k][:10]
            want[q] += [(n, ids[j], round(float(d[j]), 9)) for n, j in enumerate(order, 1)]
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items()}


# near duplicates


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def roots(sets, percent=75):
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: top(i) for i in ids}


def test_near_duplicates(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    r = random.Random(9)
    texts = {}
    for g in range(6):  # chains of edits: neighbours alike, ends not
        w = words(80, 50 + g).split()
        for k in range(14):
            texts[len(texts)] = " ".join(w)
            w = list(w)
            w[r.randrange(len(w))] = f"new{g}_{k}"
    shared = words(60, 77)
    for k in range(25):  # a passage that unlike texts share
        texts[len(texts)] = words(12, 300 + k) + " " + shared + " " + words(10, 400 + k)
    texts |= {500: None, 501: "", 502: "a b", 503: "A B", 504: "a b c", 505: texts[0].upper(), 506: texts[0]}
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in texts.items()], DOCS).withColumn("kept", F.lit("clash")).repartition(4)
    got = {x["doc_id"]: x for x in rows_of(minhash.near_duplicates(df))}
    sets = {i: shingles(t) for i, t in texts.items()}
    want = roots(sets)
    assert {i: x["component_id"] for i, x in got.items()} == want
    assert all(x["n_shingles"] == len(sets[i]) and x["kept"] == (want[i] == i) for i, x in got.items())
    assert minhash.near_duplicates(empty).count() == 0
    stay = minhash.drop_near_copies(df)
    assert stay.columns == df.columns and sorted(x.doc_id for x in stay.collect()) == sorted(set(want.values()))
    awkward = rows_of(minhash.near_duplicates(docs))
    assert len(awkward) == docs.count() and [x for x in awkward if x["doc_id"] is None][0]["component_id"] is None
    assert [x["kept"] for x in awkward if x["doc_id"] == 6].count(True) == 1  # a repeated row


def helpers(df):
    """df as a shuffle's outcome, with the operators' own column names and rows that repeat an identifier, or have none."""
    more = [(5, words(30, 900), "en", "a", 0), (5, words(30, 901), "en", "a", 0), (None, words(30, 902), None, "a", 0), (None, words(30, 902), None, "a", 0), (None, words(30, 903), None, None, 0)]
    named = df.sparkSession.createDataFrame(more, DOCS).unionByName(df.select(*(x.split()[0] for x in DOCS.split(", "))))
    names = ("row", "_row", "_gone", "gone", "mark", "times", "_epochs", "_epoch", "said", "_said", "id", "root", "key", "best", "kept", "doc_id_", "at")
    return named.withColumns({c: F.lit("clash") for c in names}).repartition(7, "text").filter("length(coalesce(source, '')) < 5").distinct()


def test_rows_that_come_out_of_a_shuffle(spark):
    df = helpers(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id < 700"))
    everything = df.collect()
    exact = exact_dedup.drop_copies(df)
    groups = defaultdict(list)
    for r in everything:
        groups[lowered(r.text)].append(r.doc_id)
    key = lambda x: (x is not None, x)
    assert exact.columns == df.columns
    assert Counter((r.doc_id, lowered(r.text)) for r in exact.collect()) == Counter((max(v, key=key), t) for t, v in groups.items())
    taken = Counter()
    for r in mixing.mix(df).collect():
        taken[r.doc_id] += r.taken
    mixed = mixing.mixed_rows(df)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    got = Counter()
    for r in mixed.collect():
        got[r.doc_id] += size(r.text)
    assert mixed.columns == df.columns and +got == +taken
    near = minhash.drop_near_copies(df)
    sets = {k: shingles(r.text) for k, r in enumerate(sorted(everything, key=lambda r: (r.doc_id is None, r.doc_id or 0)))}
    ids = dict(enumerate(sorted((r.doc_id for r in everything), key=lambda x: (x is None, x or 0))))
    top = roots({k: x for k, x in sets.items() if x})
    assert near.columns == df.columns
    assert Counter(r.doc_id for r in near.collect()) == Counter(ids[k] for k in sets if top.get(k, k) == k)


def test_estimates_are_corrected_for_chance():
    r = np.random.default_rng(4)
    a = minhash.mix(r.integers(1, 2**62, 1000).astype(np.uint64))
    for overlap in (0, 500, 900):
        b = np.concatenate([a[:overlap], minhash.mix(r.integers(1, 2**62, 1000 - overlap).astype(np.uint64))])
        one, two = (np.frombuffer(minhash.signature(minhash.minima(np.unique(x))), np.uint8) for x in (a, b))
        assert minhash.estimate((one == two).sum()) == pytest.approx(overlap / (2000 - overlap), abs=0.16)


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + r.randrange(30), 100 + r.randrange(30)) for _ in range(25)] + [(5, 5), (3, 2)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    near = defaultdict(set)
    for u, v in edges:
        near[u].add(v)
        near[v].add(u)
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            for n in near[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        if len(seen) > 1:
            assert got[start] == min(seen)


# languages


def test_codewords():
    for n in (2, 3, 4, 5, 9):
        code = langid.codewords(n)
        gaps = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert len(code) == n and min(gaps) >= (1 if n == 2 else 2)


def test_language_id(spark, docs, empty):
    tables = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    codes = langid.learn(tables.filter("doc_id % 4 <> 2"))
    got = langid.identify(tables, codes).join(tables.withColumnRenamed("lang", "truth"), "doc_id").filter("doc_id % 4 = 2 and text rlike '[a-zA-Z]'").collect()
    assert sum(r.lang_pred == r.truth for r in got) >= 0.95 * len(got)
    by = {(r.doc_id, r.lang_pred == "und") for r in langid.identify(docs, codes).collect()}
    assert {d for d, und in by if und} == {0, 1, 2, 13}
    assert all(0 <= r.score <= 1 for r in langid.identify(docs, codes).collect())
    assert langid.identify(empty, codes).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.learn(empty)).collect()} == {"und"}
    kept = langid.keep_known(docs, codes)
    assert kept.columns == docs.columns and {0, 1, 2, 13}.isdisjoint({r.doc_id for r in kept.collect()})


# packing


@pytest.mark.parametrize("width", [64, 4096])
def test_packing(docs, empty, library, width):
    df = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    ids = {r.doc_id: np.array(library.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4") for r in df.collect()}
    pieces = rows_of(packing.pack(df, VOCABULARY, width=width))
    check_packing(pieces, ids, width)
    assert packing.pack(empty, VOCABULARY).count() == 0


def check_packing(pieces, ids, width):
    windows, told = defaultdict(list), defaultdict(list)
    for p in pieces:
        mine = ids[p["doc_id"]]
        assert p["doc_tokens"] == len(mine) and zlib.crc32(mine[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] and p["length"] > 0
        windows[p["sequence_id"]].append((p["offset"], p["length"]))
        told[p["doc_id"]].append((p["start"], p["length"]))
    for whole, parts in ((ids, told),):
        for d, mine in whole.items():
            at = 0
            for start, length in sorted(parts[d]):
                assert start == at
                at += length
            assert at == len(mine)
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == width or at < width and at & (at - 1) == 0


def test_every_window_keeps_the_proportions(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.expr("repeat('word ', cast(20 + id % 90 as int))").alias("text"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") == 1, None).otherwise(F.concat(F.lit("s"), F.col("id") % 4)).alias("source")).repartition(5)
    source = {r.doc_id: r.source for r in df.collect()}
    pieces = rows_of(packing.pack(df, VOCABULARY, width=256))
    total = Counter()
    per = defaultdict(Counter)
    for p in pieces:
        total[source[p["doc_id"]]] += p["length"]
        per[p["sequence_id"]][source[p["doc_id"]]] += p["length"]
    n = sum(total.values())
    for s in ("s0", "s1", "s2", "s3"):
        served = 0
        for k in range(n // 256):  # never a token off in all windows so far, so never two in one
            served += per[k][s]
            assert abs(served - (k + 1) * 256 * total[s] / n) < 1 and abs(per[k][s] - 256 * total[s] / n) < 2


# the registered queries


def test_queries_match_their_sql(spark):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    for name, sql in queries.oracle_sql().items():
        frame = queries.queries()[name](spark, SF)
        columns = sorted(frame.columns)
        assert sorted(map(str, (tuple(r) for r in frame.select(columns).collect()))) == sorted(map(str, db.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())), name


def test_query_columns(spark):
    held = {"op4_lm_score": 7, "op6_toxicity": 4, "op9_language_id": 4}
    for name, k in held.items():
        rows = queries.queries()[name](spark, SF).collect()
        assert len(rows) == 200 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % k == 2) for r in rows)

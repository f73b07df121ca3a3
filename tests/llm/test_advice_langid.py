import numpy as np

from rungwise.llm import langid


def test_every_language_is_learnt(spark):
    rows = [(i, f"text {i}", f"l{i % 1203:04d}") for i in range(2405)] + [(9000, None, "none"), (9001, "x", None)]
    codes = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rounds=1)
    assert codes.langs == [f"l{k:04d}" for k in range(1203)] and codes.weights.shape == (1 << langid.DIM_BITS, codes.code.shape[1])


def test_rows_of_null_or_shared_identifiers(spark):
    schema = "doc_id long, text string, lang string"
    for doc_id in (None, 7):
        rows = [(doc_id, f"text {i} {'eine' if i % 2 else 'one'}", "de" if i % 2 else "en") for i in range(2000)]
        codes = langid.learn(spark.createDataFrame(rows, schema), rounds=1)
        assert codes.langs == ["de", "en"]
    for n in (1, 3000):  # rows that repeat each other are one
        codes = langid.learn(spark.createDataFrame([(doc_id, "same", "en")] * n + [(i, f"text {i}", "de") for i in range(9)], schema).repartition(4), rounds=1)
        assert codes.langs == ["de", "en"]
    same = [langid.learn(spark.createDataFrame([(1, "a b", "en")] * n + [(2, "c d", "de")], schema), rounds=3).weights for n in (1, 50)]
    assert np.array_equal(*same)


def test_the_sparse_fit_equals_a_dense_one():
    r = np.random.default_rng(0)
    texts = ["".join(r.choice(list("abcdef" if k % 2 else "defghi"), 40)) for k in range(300)]
    rows = [langid.counted(t) for t in texts]
    own = langid.Codes.fit(rows, ["ab"[k % 2] for k in range(300)], rounds=5)
    x = np.zeros((300, 1 << langid.DIM_BITS))
    for j, (used, v) in enumerate(rows):
        x[j, used] = v
    y = langid.codewords(2)[[k % 2 for k in range(300)]].astype(float)
    w, b = np.zeros((x.shape[1], y.shape[1])), np.zeros(y.shape[1])
    for _ in range(5):
        g = -y / (1 + np.exp(y * (x @ w + b)))
        w, b = w - 20 * (x.T @ g / 300 + 1e-5 * w), b - 2 * g.mean(0)
    assert np.allclose(own.weights, w, atol=1e-4) and np.allclose(own.bias, b, atol=1e-4)
    assert own.code[0] @ own.margins("abcabcabc") < own.code[1] @ own.margins("abcabcabc")


def test_closest_rows():
    code = np.random.default_rng(1).integers(0, 2, (1100, 55)) * 2 - 1
    assert langid.closest(code) == min(int((code[i + 1 :] != code[i]).sum(1).min()) for i in range(1099))

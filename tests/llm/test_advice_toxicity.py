import math

from rungwise.llm import toxicity


def test_the_curve_is_fitted_on_all_segments(spark, monkeypatch):
    seen = []
    fit = toxicity.logistic
    monkeypatch.setattr(toxicity, "logistic", lambda x, y, shares: seen.append((x, y)) or fit(x, y, shares))
    gap = " ".join(["plain"] * 8)
    side = " ".join(["plain"] * 38)
    rows = [(i, f"{side} vile {side}" if i % 2 else f"{side} fine {side}") for i in range(400)] + [(1001, " ".join([f"vile {gap}"] * 70))]
    labels = [(i, i % 2) for i, _ in rows]
    model = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    n, found = model.segments(rows[-1][1].encode())
    want = model.evidence(n, found)
    fifty = model.evidence(n, sorted(found, key=lambda x: -x[2])[:50])
    assert len(found) == 70
    assert len(seen[0][0]) == 401 and any(math.isclose(e, want) for e, y in zip(*seen[0], strict=True) if y == 1)
    assert fifty < want, (fifty, want)

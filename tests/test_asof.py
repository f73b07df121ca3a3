"""Forward fill, as-of and interval look-ups against brute force, with keys that span many partitions."""

import random
from collections import Counter

import pytest

from rungwise.plans import asof


def brute_fill(rows):
    out, last = [], {}
    for k, at, n, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2])):
        if v is not None:
            last[k] = v
        out.append((k, at, n, last.get(k)))
    return Counter(out)


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_filled(spark, parts):
    r = random.Random(parts)
    keys = ["hot"] * 20 + ["a", "b", None]
    rows = [(r.choice(keys), r.choice([None, *range(50)]), n, r.choice([None] * 6 + [n])) for n in range(900)]
    rows += [("hot", 10**6, 1000 + n, None) for n in range(300)]  # one place of many rows, far behind the last value
    df = spark.createDataFrame(rows, "k string, at long, n long, value long").repartition(5)
    found = asof.filled(df, "k", ["at", "n"], "value", parts)
    assert Counter(map(tuple, found.collect())) == brute_fill(rows)
    sizes = [len(x) for x in found.rdd.glom().collect()]
    assert max(sizes) < 3 * len(rows) / parts + 50
    assert asof.filled(df.filter("n < 0"), "k", ["at"], "value", parts).count() == 0


def test_a_value_is_carried_over_several_partitions(spark):
    rows = [("k", 0, "first")] + [("k", n, None) for n in range(1, 500)] + [("l", 0, None)]
    df = spark.createDataFrame(rows, "k string, at int, value string")
    got = {(r.k, r.at): r.value for r in asof.filled(df, "k", ["at"], "value", 12).collect()}
    assert all(v == "first" for (k, _), v in got.items() if k == "k") and got["l", 0] is None


def test_as_of_and_within(spark):
    r = random.Random(7)
    asked = [(r.choice(["x", "y", None]), r.randrange(-5, 205), n) for n in range(400)]
    events = [(k, at, f"{k}{at}") for k in ("x", None) for at in range(0, 200, 10)]
    left = spark.createDataFrame(asked, "k string, at int, side int").repartition(3)
    right = spark.createDataFrame(events, "k string, at int, v string")
    for parts in (1, 7):
        want = Counter((k, at, n, None if k == "y" or at < 0 else f"{k}{min(at // 10 * 10, 190)}") for k, at, n in asked)
        assert Counter(map(tuple, asof.as_of(left, right, "k", "at", "v", parts).select("k", "at", "side", "v").collect())) == want
        spans = right.selectExpr("k", "at AS start", "at + 4 AS end", "v")
        want = Counter((k, at, n, None if k == "y" or at < 0 or at >= 200 or at % 10 >= 4 else f"{k}{at // 10 * 10}") for k, at, n in asked)
        assert Counter(map(tuple, asof.within(left, spans, "k", "at", "start", "end", parts).select("k", "at", "side", "v").collect())) == want
    with pytest.raises(ValueError):
        asof.within(left, right.selectExpr("k", "at", "at + 1 AS end"), "k", "at", "at", "end")

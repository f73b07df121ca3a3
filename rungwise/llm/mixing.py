"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source, keys fall into ranges
of equal width; the ranges' token counts, summed up range after range, and the
running sums inside each range give every document's place in its source's
random order. The order is cut where the source's budget ends; a budget above
the source's size takes whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rungwise.llm.common import SMALL, WORD, cut, fresh, numbered

#: Hexadecimal digits of the key that give its range, 48 bits: exact in a double.
KEY_DIGITS = 12
#: Ranges per source: at least so many, and no more than so many documents in one on average.
RANGES, PER_RANGE = 512, 65_536


def random_key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], percent: int, most: int) -> DataFrame:
    """source_key, target from rows (source_key, source, source_size).

    Sources in code-point order, null last, weigh `weights` in turn and share
    percent % of all sizes. A target stops at `most` times its source's size and
    the excess is shared among the others by weight. That is one water level:
    with sources in order of size / weight, those before the first whose level
    stays under its cap are capped. One row per source passes through here.
    """
    every = Window.partitionBy()
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", weight.cast("long"))
    fill = Window.orderBy(F.col("source_size") / F.col("w"), "source_key").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({
        "total": F.sum("source_size").over(every),
        "capped": F.coalesce(F.sum("source_size").over(fill), F.lit(0)),
        "free": F.sum("w").over(every) - F.coalesce(F.sum("w").over(fill), F.lit(0)),
    })
    # 100 * the level of a unit of weight, times the weights still free
    s = s.withColumn("rest", percent * F.col("total") - 100 * most * F.col("capped"))
    s = s.withColumn("open", 100 * most * F.col("source_size") * F.col("free") > F.col("w") * F.col("rest"))
    first = F.min(F.when(F.col("open"), F.struct(F.col("source_size") / F.col("w"), "source_key", "rest", "free"))).over(every)
    s = s.withColumn("level", first)
    level = F.col("w") * F.col("level.rest") / (100 * F.col("level.free"))
    cap = (most * F.col("source_size")).cast("double")
    return s.select("source_key", "source_size", F.when(F.col("level").isNull() | (level >= cap), cap).otherwise(level).alias("target"))


def mix(df: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2, seed: int = 17, doc_id: str = "doc_id", text: str = "text", source: str = "source", row: str | None = None) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, epochs.

    size is the number of words (runs of anything but ASCII white space; null
    text 0), taken the words the mix takes of the document, repeats counted.
    Documents are taken whole, the one at the cut if that brings the source
    nearer its target; taken never exceeds (whole epochs + 1) * size. Null is a
    source of its own. Ties of the key go by doc_id, then by place in the scan. Sources without words get target 0;
    an empty table gives no rows. epochs is how often the document is taken. row names
    a column that numbers df's rows; the result then has it, as `row`.
    """
    rows = cut(df.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.col(row) if row else F.monotonically_increasing_id()).alias("row"),
        F.col(source).cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n")).alias("source_key"),
        random_key(F.col(doc_id), seed).alias("key"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    ))
    stats = rows.groupBy("source_key").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    targets = source_targets(stats.drop("docs"), weights, percent, most)
    plan = cut(targets.join(stats.select("source_key", "docs"), "source_key"))
    few = plan.count() <= SMALL
    share = F.conv(F.substring("key", 1, KEY_DIGITS), 16, 10).cast("double") / float(16**KEY_DIGITS)
    ranges = F.greatest(F.lit(RANGES), F.ceil(F.col("docs") / PER_RANGE))
    dealt = rows.drop("source").join(F.broadcast(plan) if few else plan, "source_key").withColumn("range", F.floor(share * ranges).cast("long"))
    if not few:  # a join by source must not decide where a source's ranges are worked on
        dealt = dealt.repartition("source_key", "range")
    before = Window.partitionBy("source_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("source_key", "range").agg(F.sum("size").alias("own")).select("source_key", "range", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source_key", "range").orderBy("key", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["source_key", "range"])
    start = F.col("offset") + F.col("inner")
    whole = F.floor(F.col("target") / F.col("source_size")).cast("long")
    rest = F.col("target") - whole * F.col("source_size")
    epochs = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(whole + (start * 2 + F.col("size") <= rest * 2).cast("long"))
    epochs = F.when(F.col("size") == 0, F.least(epochs, F.lit(1))).otherwise(epochs).cast("long")
    out = placed.select("doc_id", "size", "source_size", "target", (epochs * F.col("size")).alias("taken"), epochs.alias("epochs"), "row")
    return out if row else out.drop("row")


def mixed_rows(df: DataFrame, **how) -> DataFrame:
    """The rows of the mix with all their columns, whatever their names: a document taken twice comes twice, one taken never is left out.

    Nulls, ties, repeated rows and empty tables are as in mix(). Rows are numbered once, in the checkpoint folder.
    """
    rows, row = numbered(df)
    times = fresh(rows, "times")
    taken = mix(rows, row=row, **how).filter("epochs > 0").select(F.col("row").alias(row), F.sequence(F.lit(1), F.col("epochs").cast("int")).alias(times))
    return rows.join(taken, row).withColumn(times, F.explode(times)).drop(row, times)

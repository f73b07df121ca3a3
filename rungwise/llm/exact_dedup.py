"""Exact deduplication by a tree merge of sorted digest runs. DataFrame operations only.

Every scan partition reduces its rows to a run: one entry per digest with the
row that stays, the number of rows and a check value. Runs then meet in
rounds; in each, `fan` neighbouring runs of the round before are merged, entries of one digest
becoming one (Spark sorts and merges the runs that meet in a task). A group of
copies is thus one entry per run at every level, however many rows it has.
The way back retraces the tree: the verdict of the last round joins the entries
of the round before it on (run, digest), and so on down to the rows, so no task ever
receives a whole large group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungwise.llm.common import ascii_lower, cut, numbered, small

#: Slices of a scan partition's run; a run never holds more than one partition's rows.
SLICES = 8


def _rounds(runs: int, fan: int) -> int:
    n, width = 0, runs
    while width > 1:
        width, n = -(-width // fan), n + 1
    return n


def exact_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "max", fan: int = 16, row: str | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after lower-casing A-Z; null counts
    as empty. Of equal texts the row with the largest (keep="max") or smallest
    (keep="min") doc_id stays; a null doc_id loses to all others. Of repeated
    rows (same doc_id and text) exactly one stays. An empty table gives no rows.
    SHA-256 names a text; byte length and a 64-bit hash of another kind verify
    every match at every level, so texts of one digest that differ in either stay apart.
    row names a column that numbers df's rows; the result then has it, as `row`.
    """
    body = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    rows = df.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.col(row) if row else F.monotonically_increasing_id()).alias("row"),
        F.spark_partition_id().alias("part"),
        body.alias("body"),
    ).select(
        "doc_id",
        "row",
        (F.col("part").cast("long") * SLICES + F.pmod(F.xxhash64("row"), F.lit(SLICES))).alias("run"),
        F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("digest"),
        F.struct(F.octet_length("body").alias("bytes"), F.xxhash64("body").alias("mix")).alias("check"),
    )
    rows = cut(rows)
    sign = 1 if keep == "max" else -1
    own = F.struct((F.col("doc_id") * sign).alias("rank"), F.col("row"))
    key = ["run", "digest", "check"]
    levels = [cut(rows.groupBy(*key).agg(F.max(own).alias("best"), F.count("*").alias("size")))]
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    for _ in range(_rounds(runs, fan)):
        up = levels[-1].withColumn("run", F.floor(F.col("run") / fan).cast("long"))
        levels.append(cut(up.groupBy(*key).agg(F.max("best").alias("best"), F.sum("size").alias("size"))))
    verdict = levels[-1]
    for below in reversed(levels[:-1]):
        up = verdict.select(F.col("run").alias("up"), "digest", "check", "best", "size")
        mine = below.select("run", F.floor(F.col("run") / fan).cast("long").alias("up"), "digest", "check")
        verdict = mine.join(up, ["up", "digest", "check"]).select("run", "digest", "check", "best", "size")
    out = rows.join(verdict, key).select(
        "doc_id",
        (F.col("best.rank") * sign).alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "row",
    )
    return out if row else out.drop("row")


def drop_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "max") -> DataFrame:
    """The rows of df that stay, with all their columns, whatever their names.

    Null text counts as empty, a null doc_id loses to all others, of repeated rows one stays, an
    empty table gives no rows. Rows are numbered once, in the checkpoint folder.
    """
    rows, row = numbered(df)
    gone = cut(exact_dedup(rows, doc_id, text, keep, row=row).filter(~F.col("kept")).select(F.col("row").alias(row)))
    return rows.join(small(gone), row, "left_anti").drop(row)

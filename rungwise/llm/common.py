"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.session import ship

#: Words are runs of anything but these six ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rows of a table of a few numbers, some 10 MB in all, that may be sent to every executor.
SMALL = 100_000
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the one the cluster names in spark.checkpoint.dir; our own only in local mode, as in tests."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have in any spelling."""
    held = {c.lower() for c in df.columns}
    while name in held:
        name += "_"
    return name


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """df with a number for each row, given once and held in the checkpoint folder, and that column's name.

    Two evaluations may deal the rows to other partitions, so places count only within one.
    """
    row = fresh(df, "row")
    return cut(df.withColumn(row, F.monotonically_increasing_id())), row


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and reads on from there; the shuffles on the way are deleted at once, not when the driver next collects garbage."""
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true")
    try:
        return df.select("*").checkpoint()  # a plan of its own, made under this setting
    finally:
        spark.conf.set(_TIDY, before)


def gathered(df: DataFrame) -> pa.Table:
    """The rows of df, few, at the driver; the shuffles on the way are deleted at once, as by cut()."""
    conf = df.sparkSession.conf
    before = conf.get(_TIDY, "false")
    conf.set(_TIDY, "true")
    try:
        return df.select("*").toArrow()
    finally:
        conf.set(_TIDY, before)


def cut_by(df: DataFrame, key: str, parts: int) -> DataFrame:
    """cut(), dealt into `parts` partitions by key in a way Spark knows of: joins on key leave these rows where they lie.

    Adaptive execution, under which a plan tells no partitioning, is off for this plan alone.
    """
    conf, adaptive = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(adaptive, "true")
    conf.set(adaptive, "false")
    try:
        return cut(df.repartition(parts, key))
    finally:
        conf.set(adaptive, before)


def small(df: DataFrame) -> DataFrame:
    """df, a table of a few plain columns that is held in the checkpoint folder, to be sent to every executor if it has SMALL rows at most; else Spark shuffles."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the identifier as text, modulo n; a null identifier counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def dealt_anew(df: DataFrame, key: str) -> DataFrame:
    """df with an equal key of unknown partitioning.

    A join then shuffles this side as well as the other, and adaptive execution
    may split a key that holds many of the other side's rows; it can't where an
    aggregate's partitioning is used again.
    """
    return df.withColumn(key, F.col(key).bitwiseXOR(F.lit(0)))


__all__ = ["SMALL", "UPPER", "WORD", "ascii_lower", "cut", "cut_by", "dealt_anew", "fold", "fresh", "gathered", "numbered", "shared_folder", "ship", "small", "table"]

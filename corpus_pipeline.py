"""The corpus pipeline: language ID, exact dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each one's result as Parquet in the folder of spark.checkpoint.dir and reads it again as the next one's
docs, so a lost executor costs tasks of one stage only. A result is deleted once the next one is written.

Every stage takes empty tables, which give no rows, and tables with more columns, whatever their names.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.llm import exact_dedup, langid, minhash, mixing, packing
from rungwise.llm.common import fold, shared_folder
from rungwise.llm.queries import VOCABULARY


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language: null texts and those without a letter. The codes are learnt from three quarters of docs.

    Null identifiers and repeated rows stay; documents of null lang are judged like all others.
    """
    codes = langid.learn(docs.filter(fold(F.col("doc_id"), 4) != 2))
    return langid.keep_known(docs, codes)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays; a null one loses to all others, of repeated rows one stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates, the document with the smallest doc_id stays; null ones come last, texts without words stay."""
    return minhash.drop_near_copies(docs, percent=75)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them; those beyond their source's budget go. Null is a source of its own, a null text has no words."""
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens; repeated rows are packed each, a null text counts as empty."""
    return packing.pack(docs, public_tokenizers.path(VOCABULARY), width=4096, end_id=2)


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixture), ("packing", packed)]

#: No SQL: the learnt classifiers, MinHash and the tokenizer are beyond it; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

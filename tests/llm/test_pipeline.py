"""The pipeline's stages against brute force."""

from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from tests.llm.test_operators import SF, check_packing, lowered, roots, shingles


def test_stages(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.union(docs.filter("doc_id = 5")).union(spark.createDataFrame([(900, None, None, None, 0), (901, "??", "en", "s", 2)], docs.schema))
    kept, columns = [], docs.columns
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF).select(columns).persist()
        kept.append(docs.collect())
    known, exact, near, mixed = kept
    assert len(known) == 201 and {900, 901}.isdisjoint({r.doc_id for r in known})
    last = {}
    for r in known:
        last[lowered(r.text)] = max(r.doc_id, last.get(lowered(r.text), -1))
    assert sorted(r.doc_id for r in exact) == sorted(last.values())
    sets = {r.doc_id: shingles(r.text) for r in exact}
    assert sorted(r.doc_id for r in near) == sorted(set(roots(sets).values()))
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in near} and max(Counter(r.doc_id for r in mixed).values()) <= 2
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    singles = docs.dropDuplicates(["doc_id"])
    ids = {r.doc_id: np.array(library.encode(r.text, add_special_tokens=False).ids + [2], "<u4") for r in singles.collect()}
    check_packing([r.asDict() for r in corpus_pipeline.packed(spark, singles, SF).collect()], ids, 4096)
    spark.catalog.clearCache()


def test_run(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.agg(F.sum("length")).first()[0] == out.filter("start = 0").agg(F.sum("doc_tokens")).first()[0]


def test_stages_take_null_identifiers(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.lit(None).cast("long"))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.filter("doc_id IS NULL").count() == docs.count() > 0

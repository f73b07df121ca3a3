"""The queries opN_<name> and `pipeline` over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib.util
import os
import sys
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.llm import exact_dedup, exponion, html_extract, jaccard_join, langid, lm_score, minhash, mixing, neighbours, packing, token_counts, toxicity, whitening
from rungwise.llm.common import fold, table

VOCABULARY = "word_bpe_49k.json"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), limit=2048)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("epochs")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 7) == 2
    return lm_score.score(table(spark, sf_dir, "documents"), ~held_out).withColumn("held_out", held_out)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return toxicity.score(docs, model, threshold=0.3).drop("segments").withColumn("held_out", held_out)


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=75)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    codes = langid.learn(docs.filter(~held_out))
    return langid.identify(docs, codes).withColumn("held_out", held_out)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), width=4096, end_id=2)


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exponion.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, width=64, scale=256, seed=2)


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"), percent=90)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=4, scale=256)


def corpus_pipeline():
    """The module at the top of the repository."""
    if "corpus_pipeline" not in sys.modules:
        path = os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "corpus_pipeline.py")
        spec = importlib.util.spec_from_file_location("corpus_pipeline", path)
        sys.modules["corpus_pipeline"] = module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
    return sys.modules["corpus_pipeline"]


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline().run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0]))) | {"pipeline": pipeline}


NORMAL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = f"""
WITH d AS (SELECT doc_id, {NORMAL} AS body FROM documents),
     g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.body) AS text_sha256
FROM d JOIN g USING (body)
"""

#: The water level in closed form, and each document's place by the md5 of its identifier.
OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, md5('17:' || doc_id) AS key,
                  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
     s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
     w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w,
                  sum(source_size) OVER () AS total FROM s),
     f AS (SELECT *, coalesce(sum(source_size) OVER o, 0) AS capped, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS free
           FROM w WINDOW o AS (ORDER BY source_size / w, source IS NOT NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
     l AS (SELECT *, (150 * total - 200 * capped)::BIGINT AS rest,
                  200 * source_size * free > w * (150 * total - 200 * capped) AS open FROM f),
     v AS (SELECT rest, free FROM l WHERE open ORDER BY source_size / w, source IS NOT NULL, source LIMIT 1),
     t AS (SELECT l.source, l.source_size,
                  CASE WHEN v.rest IS NULL OR (l.w * v.rest)::DOUBLE / (100 * v.free)::DOUBLE >= 2 * l.source_size THEN (2 * l.source_size)::DOUBLE
                       ELSE (l.w * v.rest)::DOUBLE / (100 * v.free)::DOUBLE END AS target
           FROM l LEFT JOIN v ON true),
     p AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target / nullif(t.source_size, 0))::BIGINT AS whole,
                  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
           FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (CASE WHEN source_size = 0 THEN 0
             ELSE size * (whole + (start * 2 + size <= (target - whole * source_size) * 2)::BIGINT) END)::BIGINT AS taken
FROM p
"""


def components_sql(words: int, percent: int, kept: str = "") -> str:
    """Documents, the sizes of their sets of `words`-word shingles, and the least doc_id reachable by links of `percent`."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({NORMAL}, '[^\x20\x09-\x0D]+') AS w FROM documents),
     s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(s) AS s, s AS shingle
           FROM (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - {words - 1}, 1) + 1), lambda k: array_to_string(w[k : k + {words - 1}], ' '))) AS s FROM w WHERE len(w) > 0)),
     n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
     l AS MATERIALIZED (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * shared >= {percent} * (x.n + y.n - shared)),
     e AS MATERIALIZED (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
     r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.root AS component_id{kept}
FROM documents d JOIN (SELECT node, min(root) AS root FROM r GROUP BY node) m ON m.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def clusters_sql(k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: int = 2) -> str:
    """Rounds of assignment and exact floor means over integers, every vector against every centroid."""

    def step(n: int) -> str:
        return f"""
     d{n} AS MATERIALIZED (SELECT e.vec_id, c.c, list_sum(list_transform(range(1, {width + 1}), lambda j: (e.x[j] - c.x[j]) * (e.x[j] - c.x[j])))::BIGINT AS far FROM e, c{n} c),
     a{n} AS MATERIALIZED (SELECT vec_id, min(far) AS far, arg_min(c, (far, c)) AS c FROM d{n} GROUP BY vec_id)"""

    def move(n: int) -> str:
        return f""",
     m{n} AS (SELECT a.c, j, sum(e.x[j])::BIGINT AS s, count(*) AS n FROM a{n} a JOIN e USING (vec_id), range(1, {width + 1}) t(j) GROUP BY ALL),
     v{n} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS x FROM m{n} GROUP BY c),
     c{n + 1} AS MATERIALIZED (SELECT c.c, coalesce(v.x, c.x) AS x FROM c{n} c LEFT JOIN v{n} v USING (c)),"""

    steps = "".join(step(n) + move(n) for n in range(rounds)) + step(rounds)
    return f"""
WITH e AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda v: floor({scale} * v::DOUBLE)::BIGINT) AS x FROM embeddings
           WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda v: isfinite(v))) = {width}),
     c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c, x FROM e QUALIFY c < {k}),{steps}
SELECT vec_id, a.c::INTEGER AS cluster, far AS distance, sum(far) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(far) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c USING (c)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": OP2_SQL,
        "op3_mixing": OP3_SQL,
        "op8_near_dedup": components_sql(5, 75, ", d.doc_id = m.root AS kept"),
        "op11_centroid_clustering": clusters_sql(),
        "op12_jaccard_join": components_sql(3, 90),
    }

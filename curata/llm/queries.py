"""The registered queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from curata.llm import (
    byte_bpe, decontaminate, html_text, language_id, lm_score, minhash_dedup, prefix_trie, sharding, suffix_dedup, token_files,
    toxicity, vector_search, whitening,
)
from curata.llm.tables import read


def op1_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(read(spark, folder, "documents")))


def op2_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash_dedup.digest(minhash_dedup.near_duplicates(read(spark, folder, "documents")))


def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.digest(sharding.assign(read(spark, folder, "documents")))


def op4_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return lm_score.scores(read(spark, folder, "documents"), path, public_tokenizers.PATTERN)


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return decontaminate.digest(found)


def op6_vector_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read(spark, folder, "embeddings")
    return vector_search.search(vectors, vectors.filter("vec_id % 20 = 0"))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.digest(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op8_byte_level_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.digests(read(spark, folder, "documents"), path, public_tokenizers.PATTERN)


def op9_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(read(spark, folder, "pages"))


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.digest(read(spark, folder, "documents"))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.digest(read(spark, folder, "conversations"))


def op12_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.digest(read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(read(spark, folder, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup,
        op2_minhash_near_dedup,
        op3_sharding,
        op4_lm_scoring,
        op5_decontamination,
        op6_vector_search,
        op7_toxicity,
        op8_byte_level_bpe,
        op9_html_extraction,
        op10_language_id,
        op11_prefix_trie,
        op12_token_files,
        op13_embedding_whitening,
    )
}

_OP1 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, len(h) // 2 AS n FROM d),
p AS (SELECT doc_id, p, row_number() OVER (PARTITION BY m ORDER BY doc_id, p) > 1 AS again
  FROM (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS m
    FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM n WHERE n >= 100))),
r AS (SELECT doc_id, p, sum(CAST(p > before + 100 OR before IS NULL AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY p) AS run
  FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM p WHERE again)),
s AS (SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b FROM r GROUP BY doc_id, run),
k AS (SELECT n.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS h
  FROM n JOIN (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b
    FROM (SELECT doc_id, a, b FROM s UNION ALL SELECT doc_id, n, n FROM n)) g USING (doc_id) GROUP BY n.doc_id),
c AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans FROM s GROUP BY doc_id)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(k.h)) AS kept_sha256
FROM n JOIN k USING (doc_id) LEFT JOIN c USING (doc_id)
"""

_OP2 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM s x JOIN s y USING (g) WHERE x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c.n >= 80 * (na.n + nb.n - c.n)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
t AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT t.doc_id, e.b FROM t JOIN e ON e.a = t.other)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d JOIN (SELECT doc_id, min(other) AS component_id FROM t GROUP BY doc_id) m USING (doc_id) LEFT JOIN n USING (doc_id)
"""

SQL = {
    "op1_suffix_array_dedup": _OP1,
    "op2_minhash_near_dedup": _OP2,
    "op5_decontamination": decontaminate.SQL,
    "op11_prefix_trie": prefix_trie.SQL,
}

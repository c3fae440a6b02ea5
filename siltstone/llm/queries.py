"""The queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import decontamination, kneser_ney, ngram_join, packing, quality, sharding, token_counts, token_store, toxicity, warc
from siltstone.llm.common import read_table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of each document, boundary tokens to the line with most of their bytes."""
    return token_counts.section_tokens(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of each document, after growing from 64 to 80 shards."""
    return sharding.shard(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of each document under a model of all documents."""
    return kneser_ney.perplexity(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of each page."""
    return warc.derivatives(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of each document among near copies."""
    return ngram_join.jaccard_join(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document, restored from disguises."""
    return toxicity.toxicity(read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of each document, written and read again."""
    return token_store.tokenized(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 2,048 tokens."""
    return packing.pack(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates, fences and the decision for each document."""
    return quality.quality(read_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in each document."""
    return decontamination.benchmark_hits(read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "benchmark", "item_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_sharding, op3_lm_scoring, op4_warc, op5_ngram_join,
        op6_toxicity, op7_token_store, op8_packing, op9_quality, op10_decontamination,
    )
}

_WORDS = r"string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')"


def _windows(table: str, key: str, n: int) -> str:
    return f"""SELECT DISTINCT {key}, array_to_string(w[i : i + {n - 1}], ' ') AS g FROM (
    SELECT {key}, w, unnest(range(1, greatest(len(w) - {n - 2}, 2))) AS i FROM (SELECT {key}, {_WORDS} AS w FROM {table} WHERE text IS NOT NULL) WHERE w[1] <> '')"""


JACCARD_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
s AS ({_windows("d", "r", 3)}), n AS (SELECT r, count(*) AS n FROM s GROUP BY 1),
p AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.r <> y.r GROUP BY ALL) JOIN n x ON x.r = a JOIN n y ON y.r = b
  WHERE shared >= 0.55 * (x.n + y.n - shared)
),
c AS (SELECT a AS r, a AS other FROM p UNION SELECT p.b, c.other FROM c JOIN p ON p.a = c.r),
k AS (SELECT c.r, min(d.doc_id) AS class_id FROM c JOIN d ON d.r = c.other GROUP BY 1),
l AS (SELECT a AS r, count(*) AS n_links FROM p GROUP BY 1)
SELECT doc_id, CASE WHEN k.r IS NULL THEN doc_id ELSE class_id END AS class_id, coalesce(n_links, 0) AS n_links FROM d LEFT JOIN k USING (r) LEFT JOIN l USING (r)
"""

HITS_SQL = f"""
WITH i AS (SELECT DISTINCT item_id, g, len(string_split(g, ' ')) AS n FROM ({_windows("benchmark", "item_id", 8)})),
w AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
k AS (SELECT DISTINCT n FROM i),
d AS (SELECT DISTINCT r, doc_id, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT r, doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, k WHERE len(w) >= n))
SELECT doc_id, item_id, count(*) AS n_windows FROM d JOIN i USING (g) GROUP BY r, doc_id, item_id
"""

ORACLE_SQL: dict[str, str] = {
    "op2_sharding": sharding.SHARD_SQL,
    "op4_warc": warc.derivatives_sql(),
    "op5_ngram_join": JACCARD_SQL,
    "op9_quality": quality.QUALITY_SQL.format(docs="documents"),
    "op10_decontamination": HITS_SQL,
}

"""Queries of this folder: each operator over its whole table, with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from locigrid.llm import anchors, collocations, language, lexical_search, mixing, packing, quality_classifier, quality_rules, secrets, simhash, token_files, topk, warc
from locigrid.llm.common import read
from locigrid.session import work_path


def op1_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels that are not held out."""
    return quality_classifier.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_inner_product_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest inner products of every twentieth vector with all others."""
    vectors = read(spark, sf_dir, "embeddings")
    return topk.top_inner_products(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def op3_simhash_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op4_language_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by the dictionary that makes it smallest."""
    return language.languages(read(spark, sf_dir, "documents"))


def op5_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, by way of a fresh ledger."""
    return secrets.secret_digest(read(spark, sf_dir, "documents"))


def op6_content_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived by content, and the archive's index read back."""
    folder = work_path(spark, "archive")
    warc.write_archive(read(spark, sf_dir, "pages"), folder)
    return warc.read_index(spark, folder)


def op7_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every document and the verdict of the adaptive rules."""
    return quality_rules.verdicts(read(spark, sf_dir, "documents"))


def op8_seekable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token files, and what these hold of each."""
    folder = work_path(spark, "tokens")
    token_files.write_token_files(read(spark, sf_dir, "documents"), folder)
    return token_files.read_token_files(spark, folder)


def op9_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    return mixing.decided(read(spark, sf_dir, "documents"))


def op10_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    return packing.pack(read(spark, sf_dir, "documents"))


def op11_anchor_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeat an earlier window, and the digest of the others."""
    return anchors.without_repeats(read(spark, sf_dir, "documents")).drop("repeats")


def op12_rollup_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best collocations of every language."""
    return collocations.collocations(read(spark, sf_dir, "documents"))


def op13_interval_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for every benchmark item."""
    return lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_ranking,
        op2_inner_product_search,
        op3_simhash_trees,
        op4_language_dictionaries,
        op5_secret_ledger,
        op6_content_archive,
        op7_adaptive_rules,
        op8_seekable_tokens,
        op9_pareto_mix,
        op10_histogram_packing,
        op11_anchor_repeats,
        op12_rollup_collocations,
        op13_interval_search,
    )
}

TOP_SQL = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({topk.SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
  r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
  SELECT * FROM r WHERE rank <= {topk.TOP}"""

ORACLES: dict[str, str] = {
    "op2_inner_product_search": TOP_SQL,
    "op5_secret_ledger": secrets.SQL,
    "op6_content_archive": warc.SQL,
    "op7_adaptive_rules": quality_rules.SQL,
    "op9_pareto_mix": mixing.SQL,
    "op11_anchor_repeats": anchors.SQL,
    "op12_rollup_collocations": collocations.SQL,
    "op13_interval_search": lexical_search.SQL,
}

"""Queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, html_text, language, lexical_search, lm_scoring, mixing, near_join, packing, quality, quality_rules, sharding, spelling, vector_dedup
from .tables import read_table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.ngram_jaccard_join(read_table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"), shards=40)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.cosine_links(read_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(read_table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = mixing.mix_sources(read_table(spark, sf_dir, "documents").select("doc_id", "source"))
    return placed.selectExpr("row.doc_id AS doc_id", "source", "block", "phase", "slot", "release", "due", "position")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(read_table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(read_table(spark, sf_dir, "documents"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read_table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read_table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.build_index(read_table(spark, sf_dir, "documents"))
    return lexical_search.search(index, read_table(spark, sf_dir, "benchmark"), 50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_sharding": op2_sharding,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_packing": op4_packing,
    "op5_html_extraction": op5_html_extraction,
    "op6_quality": op6_quality,
    "op7_language": op7_language,
    "op8_mixing": op8_mixing,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_fingerprints": op10_fingerprints,
    "op11_quality_rules": op11_quality_rules,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_lexical_search": op13_lexical_search,
}

ORACLE_SQL: dict[str, str] = {
    "op11_quality_rules": quality_rules.rules_sql(),
    "op12_spelling_variants": spelling.variants_sql(),
    "op13_lexical_search": lexical_search.search_sql(),
}

"""Registered queries of the training-data operators, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seriesloom.llm import blocks, bytepairs, divergence, filteraudit, jaccard, oracle, sentencepieces, suffixes
from seriesloom.llm.common import table
from seriesloom.llm.epsilon import near_duplicates
from seriesloom.llm.languages import identify
from seriesloom.llm.packing import best_two_fit
from seriesloom.llm.quality import judge
from seriesloom.llm.surrogates import with_surrogates
from seriesloom.llm.wordpieces import token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = dict(oracle.SQL)

SURROGATE_KEY = "seriesloom registered query"
"""Key of the registered query and the pipeline; an installation passes its own secret."""


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_surrogates(table(spark, sf_dir, "documents"), SURROGATE_KEY)


@query
def op3_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.digest(blocks.repeated_words(table(spark, sf_dir, "documents")))


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


@query
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.repeated_bytes(table(spark, sf_dir, "documents")))


@query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents"))


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_two_fit(table(spark, sf_dir, "documents"))


@query
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(table(spark, sf_dir, "documents"))


@query
def op10_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query
def op13_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytepairs.digest(bytepairs.encode(table(spark, sf_dir, "documents"), decoded=True))

"""Corpus pipeline: quality rules, one document of each near-duplicate group, repeated bytes out, surrogates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seriesloom.llm import jaccard, packing, quality, suffixes, surrogates
from seriesloom.llm.common import DOCUMENT_COLUMNS, columns_of, table
from seriesloom.llm.queries import SURROGATE_KEY
from seriesloom.sources.artifacts import settle

ORACLE_SQL = None
"""SQL can't state the learned rules; tests compare the stages with brute force."""

WIDTH, PERCENT = 5, 80
"""near duplicates share 80 of 100 of their five-word shingles"""


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.keep_good(columns_of(docs, *DOCUMENT_COLUMNS), table(spark, sf_dir, "labels"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return jaccard.one_of_each(columns_of(docs, *DOCUMENT_COLUMNS), WIDTH, PERCENT)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of repeats of 200 bytes or more go, whole characters only; nothing else of a document does."""
    return suffixes.without_repeats(columns_of(docs, *DOCUMENT_COLUMNS))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced."""
    return surrogates.with_surrogate_texts(columns_of(docs, *DOCUMENT_COLUMNS), SURROGATE_KEY)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of 2048."""
    return packing.best_two_fit(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("suffix_dedup", suffix_dedup),
    ("pii_surrogates", pii_surrogates),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

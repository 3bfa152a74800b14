"""From raw documents to packed sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir); all but the last return the columns of ``documents``. The order is
that of cost and effect: rejects go before anything is compared, copies go before they are scanned, secrets are masked
before texts are repeated by the mixture, and the mixture decides what is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import packing, quality_classifier, secret_scan, simhash_dedup, source_mixing
from tidegauge.llm.common import DOCUMENT_COLUMNS, shared_checkpoint, table
from tidegauge.llm.queries import tokenizer_path

#: SQL cannot express the classifier, the fingerprints, the test battery or the tokenizer.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    settings = quality_classifier.Settings()
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"), settings=settings)
    scored = docs.select(*DOCUMENT_COLUMNS, quality_classifier.score_column(F.col("text"), model, spark).alias("quality_score"))
    return scored.filter(F.col("quality_score") >= settings.threshold).select(*DOCUMENT_COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, a similarity of 0.8) stays."""
    return simhash_dedup.keep_one_of_each(docs.select(*DOCUMENT_COLUMNS), find=simhash_dedup.similar_documents)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of a secret is replaced by a mark; no document goes."""
    masked = docs.select("doc_id", secret_scan.redact_column(F.col("text")).alias("text"), "lang", "source")
    return masked.select("doc_id", "text", "lang", "source", F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document is in the mixture at least once; documents of small sources are in it up to twice."""
    return source_mixing.mix_sources(docs.select(*DOCUMENT_COLUMNS)).select(*DOCUMENT_COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.Settings(tokenizer_path()))


STAGES = [("quality classifier", quality), ("simhash near-dedup", deduplicate), ("secret scans", mask_secrets), ("source mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is checkpointed, so no later stage repeats its work."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = shared_checkpoint(docs)
    return docs

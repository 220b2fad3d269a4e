"""Training-data pipeline over ``documents``: from raw texts to packed sequences.

Each stage takes ``(spark, docs, sf_dir)``, works on every row its predecessor kept, and returns
a DataFrame that is written as Parquet and read again as the next one's ``docs``.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowlake.llm import dedup, jaccard, packing, pii, quality
from flowlake.llm.common import small_batches, stored, table
from flowlake.llm.queries import SEQUENCE


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a risk-controlled cutoff go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays."""
    return dedup.drop_copies(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar word runs the one with the smallest id stays."""
    small_batches(spark)
    return jaccard.one_of_each(docs)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; all documents stay."""
    small_batches(spark)
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, each with its sequence and its place there."""
    small_batches(spark)
    return packing.pack_documents(docs, SEQUENCE)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("jaccard_join", jaccard_join),
          ("mask_pii", mask_pii), ("pack", pack)]

#: Token ids, MinHash buckets and the field's messages cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

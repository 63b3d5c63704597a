"""A corpus pipeline over ``documents``: poor documents go, one of each group of near copies
stays, personal data is masked, sources are mixed to their targets, and texts become token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage's
result as Parquet to the shared folder and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from armwatch.llm import byte_bpe, pii, quality_rules, simhash, source_mixing
from armwatch.llm.common import bounded, table
from armwatch.session import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the base rule or a certified cutoff rejects go."""
    bounded(spark)
    return quality_rules.without_poor(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the document with the smallest doc_id of each group stays."""
    bounded(spark)
    return simhash.without_near_duplicates(docs, shingle=4, distance=4)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: spans of personal data are replaced by their kind."""
    bounded(spark)
    return pii.masked(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: each document as often as the mix of sources takes it."""
    bounded(spark)
    return source_mixing.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: token ids with their number beside the documents' other columns."""
    bounded(spark)
    return byte_bpe.encode(docs).selectExpr(
        "doc_id", "lang", "source", "ids", "octet_length(ids) div 4 AS n_tokens")


STAGES = [("quality rules", quality), ("simhash near-dedup", near_copies), ("pii", personal_data),
          ("source mixing", mixture), ("byte-level bpe", tokens)]

#: SQL has no fingerprints of 64-bit hashes, no decoder of a trained field and no merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

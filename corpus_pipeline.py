"""A training-data pipeline: five operators in a row, each on what the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again
as the next one's documents. The last stage returns what the token files hold of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import decontaminate, mixing, neardup, tokenfile, toxicity
from chronoweave.llm.common import scratch, stash, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject, at the threshold of their language."""
    model = toxicity.train(spark, docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, as_=("_score", "_predicted", "_toxic"))
    return scored.where(~F.col("_toxic")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies."""
    return neardup.deduplicate(docs)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: up to three times, or not at all."""
    return mixing.repeat(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' documents: where they start, how many ids they have, and the checksum of these."""
    folder = scratch(spark, "tokens")
    tokenfile.encode_corpus(docs, folder)
    return tokenfile.digests(spark, folder).withColumnRenamed("doc", "doc_id")


STAGES = [("toxicity", toxic), ("near_dedup", near_duplicates), ("decontamination", contaminated), ("mixing", mixed), ("token_output", encoded)]
#: No SQL for classifiers, fingerprints or Huffman files: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs

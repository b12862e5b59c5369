"""From raw documents to packed sequences: toxic documents and near copies go, then those that hold benchmark passages; what is left is packed.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns they got,
whatever these are called. Null and empty texts are clean, not toxic unless the model says so of texts without words, near
copies of each other, and packed as one word each. Null ids and repeated rows go through like others: a row that repeats another
is a near copy. Very long texts are read whole. Empty tables give empty results; without labels no document is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from binmap.llm import decontamination, near_duplicates, packing, queries, toxicity
from binmap.llm.shared import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose toxicity score is below the threshold; the model learns from the labels of docs."""
    return toxicity.below(docs, queries.toxicity_model(docs, spark, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the least doc_id; of classes without ids any one of the least text."""
    return near_duplicates.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no passage of a benchmark item."""
    return decontamination.without_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document in bins, with its place in them; one longer than a bin as several pieces. Ties are broken by doc_id, cluster and source."""
    return packing.best_fit(queries.sized(docs))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("decontamination", drop_contaminated), ("packing", pack)]

#: The stages compress, sample, fingerprint and pack: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage keeps is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs

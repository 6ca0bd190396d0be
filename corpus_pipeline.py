"""The corpus pipeline: stages over documents, each written as Parquet and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bagweave.llm import decontamination, jaccard, mixing, quality_knn, secrets
from bagweave.llm.common import cut, drop_dir, fresh_dir, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_knn.good_documents(docs, table(spark, sf_dir, "labels"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays, that with the least doc_id."""
    return jaccard.representatives(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets give way to a mark; every document stays."""
    return secrets.redact_secrets(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words it takes of each."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("source mixing", source_mixing),
]

#: The stages hold a trained model and Python operators; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, checkpointed; what the stages wrote goes, also after an error."""
    docs, paths = table(spark, sf_dir, "documents"), []
    try:
        for name, stage in STAGES[:-1]:
            paths.append(fresh_dir(spark, "pipeline-" + name.replace(" ", "-")))
            stage(spark, docs, sf_dir).write.parquet(paths[-1])
            docs = spark.read.parquet(paths[-1])
            if len(paths) > 1:  # nothing reads the stage before any more
                drop_dir(paths.pop(0))
        return cut(STAGES[-1][1](spark, docs, sf_dir))
    finally:
        for path in paths:
            drop_dir(path)

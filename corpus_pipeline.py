"""The corpus pipeline: each stage works on all that the one before it kept.

Stages take (spark, docs, sf_dir); all but the last return the columns of
documents.  Language ID drops what it rejects, near-dedup keeps one document of
each group, decontamination drops contaminated documents, PII is masked in the
texts, and the mixture gives a row for each time that it takes a document, range
sorted by training position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boxweave.llm import common, decontaminate, lang_id, mixture, near_dup, pii


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lang_id.keep_identified(docs, lang_id.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.deduplicate(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture.in_training_order(mixture.mix(docs))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("personal_data", personal_data),
    ("mix", mix),
]

#: The classifier, the random field and the order of the mix have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each one's result is written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stored(docs, f"pipeline-{name}")
    return docs

"""The corpus pipeline: language ID, near-duplicates, benchmark decontamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns rows with the
columns of ``documents`` (the last: how much of each document the mix takes). Clean documents pass unchanged.

Rows with null ids, texts, languages or sources go through every stage like others: a null text has no language and
goes in the first, a null source is a source of its own. Of repeated rows the second stage keeps one. An empty table
gives an empty result, and columns of any other name pass through to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontamination, language, mixing, secrets, simhash
from quillspark.llm.common import dropped, stored


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model, trained on these documents, can tell; the others go (null and letterless texts among them)."""
    return language.known(docs, language.train(docs))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one of the smallest id; of repeated rows one."""
    return simhash.deduplicate(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark windows don't contaminate; a null text is clean."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced and n_chars counted anew where that changed a text."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document."""
    return mixing.mix(docs)


STAGES = [
    ("language", known_language),
    ("near_dedup", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("mixing", mixed),
]
#: SQL can't express the trained and the searching stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again for the next; what nothing reads any more is removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            done = stored(done)
        if k:
            dropped(docs)  # the last stage has taken what it needs of it into a checkpoint
        docs = done
    return docs

"""The corpus pipeline: language, exact copies, near copies, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it
as Parquet in the folder that spark.checkpoint.dir names, reads it again as the
next stage's docs, and deletes what the stage before had written. All stages but
the last return the columns of docs. A column of docs may be null in any row and
have any name; texts of any length are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lexigrid.llm import common, exact_dedup, langid, packing, secrets, wide_simhash


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model rejects go: null texts, texts without letters, or a score below the calibrated bar. Repeated rows stay or go together."""
    common.small_batches(spark)
    return langid.keep_identified(docs, langid.train(docs.where(langid.may_train())))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays, null the least; of rows equal in both one. Null texts count as empty."""
    common.small_batches(spark)
    return exact_dedup.drop_exact_duplicates(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links join, the one with the smallest doc_id stays (null the least), then the least text; of rows equal in both one.

    Links are a similarity of 0.8 or more of the sets of five-word shingles.
    Texts without words, null ones too, are alike; unlike texts under one doc_id all stay.
    """
    common.small_batches(spark)
    return wide_simhash.drop_similar(docs, shingle=5, similarity=0.8)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; every row stays, and null and empty texts stay as they are."""
    common.small_batches(spark)
    return secrets.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every row, placed in sequences; a null or empty text is one token. Repeated rows each give theirs."""
    common.small_batches(spark)
    return packing.pack_documents(docs, keep=100_000)  # the workers of earlier stages' tasks live on beside it


STAGES = [("language", language), ("exact", exact), ("near", near), ("secrets", redact), ("packing", pack)]

#: SQL has no gradient descent, BPE or best-fit packing; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    common.ensure_checkpoint_dir(spark)
    home = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = common.table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{k}-{name}")
        docs = spark.read.parquet(f"{home}/{k}-{name}")
        if before:
            common.remove(spark, before)
        before = f"{home}/{k}-{name}"
    return docs

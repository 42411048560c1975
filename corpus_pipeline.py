"""The corpus pipeline: each stage works on what its predecessor kept.

All stages keep the columns of documents, whatever their names, and take null, empty and very long texts, null and
repeated ids, repeated rows and empty tables; what each does with them is said at the stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from robustspark.llm import bpe, decontaminate, jaccard, pii, quality
from robustspark.llm.common import read_table, shared_folder


def accepted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; its labels come from the folder's table.

    The text alone decides: null and empty texts score like any other, equal texts stay or go together.
    """
    return quality.keep_accepted(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, the one with the smallest doc_id (a null id comes last).

    Texts without words belong to no group and stay; of repeated rows one stays.
    """
    return jaccard.keep_one_of_each_component(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the folder's benchmark go; null and empty texts stay, and all do if it has no items."""
    return decontaminate.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; n_chars follows. No row goes; a null text stays null."""
    return pii.redacted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, a row for each row; a null text counts as empty."""
    return bpe.bpe_columns(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), keep_ids=False)


STAGES = [("quality", accepted), ("near_duplicates", near_duplicates), ("decontamination", decontaminated), ("pii", redacted), ("bpe", encode)]

#: Jaccard links, a trained classifier and merges are beyond SQL; tests hold near duplicates, personal data and encoding
#: against plain versions, and all stages against planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's rows are written to the shared folder and read again."""
    shared = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

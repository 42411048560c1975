"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(key: str = "id", text: str = "text") -> Column:
    """A key that is never null, of a row's id (which may be null or repeated) and text; equal rows share it."""
    return F.xxhash64(F.col(key), F.col(text))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only a session on one machine may leave it unset; it gets a folder of that machine.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return shared or tempfile.mkdtemp(prefix="spark-checkpoint-")


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the cluster's shared folder (``spark.checkpoint.dir``)."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def fresh(df: DataFrame, base: str) -> str:
    """A column name that starts with ``base`` and that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base

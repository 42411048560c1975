"""Files: the shared folder, sinks that are read back, and inventories of what a folder holds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What an inventory leaves out, and endings of files whose bytes stay as they are.
SKIPPED = (r"/\.vercel/", r"/data/public/", r"\.(pem|key|p12|local)$", r"/(credentials|secrets)\.json$", r"/\.env(?!\.example$)[^/]*$", r"/(\.DS_Store|Thumbs\.db)$")
IMAGES = r"(?i)\.(png|jpe?g|webp|gif)$"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only a session on one machine may leave it unset; it gets a folder of that machine.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='spark-files-')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, form: str = "parquet", by: Sequence[str] = (), **options: str) -> DataFrame:
    """``df`` written to ``path`` and read back with its own schema; nulls of JSON stay nulls."""
    df.write.format(form).options(**options).partitionBy(*by).save(path)
    reader = df.sparkSession.read.format(form).options(**options).schema(df.schema)
    return reader.load(path).select(*df.columns)


def binary_files(spark: SparkSession, path: str, skipped: Sequence[str] = SKIPPED) -> DataFrame:
    """(path, content) of all files below ``path``, but for those whose path below it matches a pattern of ``skipped``.

    A file is one row, so it must fit a task; Spark's source leaves empty files out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    below = F.substring_index("path", path.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    rows = files.select(F.concat(F.lit("/"), below).alias("path"), "content")
    for pattern in skipped:
        rows = rows.filter(~F.col("path").rlike(pattern))
    return rows.withColumn("path", F.substring("path", 2, 1_000_000))


def canonical(path: Column, content: Column) -> Column:
    """The bytes of a file with line ends as newlines; images and files with a zero byte stay as they are."""
    text = F.decode(content, "ISO-8859-1")  # a character for each byte
    lines = F.encode(F.replace(text, F.lit("\r\n"), F.lit("\n")), "ISO-8859-1")
    return F.when(path.rlike(IMAGES) | F.contains(text, F.lit("\0")), content).otherwise(lines)


def inventory(files: DataFrame) -> DataFrame:
    """(path, bytes, digest) of ``files (path, content)``, of their canonical bytes."""
    own = canonical(F.col("path"), F.col("content"))
    return files.select("path", F.octet_length(own).cast("long").alias("bytes"), F.sha2(own, 256).alias("digest"))

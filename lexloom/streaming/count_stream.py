"""Encodings over Structured Streaming.

Every column works on one row alone, so a stream needs no state and no watermark: a
source, the columns, and a sink that commits files batch by batch.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexloom.functions.columns import Columns


def transform(rows: DataFrame, columns: Columns, text: str = "text") -> DataFrame:
    """A stream's (or batch's) rows with n_tokens."""
    return rows.withColumn("n_tokens", columns.count(F.col(text)).cast("long"))


def shared_folder(spark: SparkSession) -> str:
    """Where the stream's log and files go: the folder all executors share."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(named or 'file://' + tempfile.mkdtemp(prefix='lexloom-')).rstrip('/')}/stream-{uuid.uuid4().hex}"


def counted(spark: SparkSession, sf_dir: str, columns: Columns) -> DataFrame:
    """doc_id, n_tokens of all documents that are there now, through a stream."""
    path = f"{sf_dir}/documents.parquet"
    schema = spark.read.parquet(path).schema
    # A file source takes folders and patterns; [t] makes a pattern that only this name,
    # a file's or a folder's, matches.
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{path[:-1]}[t]").select("doc_id", "text")
    folder = shared_folder(spark)
    stream = (
        transform(rows, columns)
        .select("doc_id", "n_tokens")
        .writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/log")
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
    return spark.read.schema("doc_id long, n_tokens long").parquet(f"{folder}/out")

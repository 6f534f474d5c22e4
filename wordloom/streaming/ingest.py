"""Texts that keep coming: the same tokens and counts over a stream of lines 'id<tab>text'.

The reference point is batch; this is its row-wise part as a stream, without state: each micro-batch's counts are appended to the fact
folder, and a document is counted once, by the checkpointed source.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.tokens import PATTERN, tokens


def stream_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(filename, text) of files as they appear in folder."""
    parts = F.split("value", "\t", 2)
    lines = spark.readStream.text(folder)
    return lines.where(F.contains("value", F.lit("\t"))).select(parts[0].alias("filename"), parts[1].alias("text"))


def append_counts(texts: DataFrame, out: str, checkpoint: str, pattern: str = PATTERN):
    """Start a query that appends (filename, word, count) for each new text to parquet in out; returns the query.

    A batch that is run again replaces itself; batches of another checkpoint, which numbers from 0 too, stand beside them.
    """
    run = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, number: int) -> None:
        words = batch.select("filename", F.explode(tokens(F.col("text"), pattern)).alias("word"))
        words.groupBy("filename", "word").agg(F.count("*").alias("count")).write.mode("overwrite").parquet(f"{out}/run=r{run}/batch={number}")

    return texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

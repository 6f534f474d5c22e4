"""A corpus pipeline: quality rules, near-copies, repeated passages, source mixing and packing, one after the other.

In every stage rows with nulls in any column, empty and very long texts, ties, repeated rows, an empty table and extra columns of any name are
fine: each stage's docstring says what becomes of them.  All stages but the last give the columns of what they get.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from wordloom.llm import mixing, packing, passages, quality_rules, simhash
from wordloom.shared import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules, learned from the labelled documents among docs, accept.

    Null and empty texts have the model's chance for no n-grams; long texts are scored whole; repeated rows and ties score alike, and those
    at the threshold stay; without labels of both kinds all texts have the share of good labels as their chance, and one half without any.
    """
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of least doc_id, null last.

    Null texts and texts without letter or digit are in no group and all stay; of rows equal in doc_id and text one stays, and of a tie in
    doc_id alone the one of least hash; long texts are compared whole.
    """
    return simhash.drop_near_copies(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document, by doc_id with null last, has; those of which no word is left go.

    Null, empty and short texts stay as they are; of rows equal in doc_id and text one stays; long texts are searched whole.
    """
    return passages.drop_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn for the target mix of sources, in the order of the mixed shards, which packing follows.

    A null source is a source of its own, the empty string another; null ids and texts count as values, texts of any length move whole;
    equal rows are interchangeable and keep their number.
    """
    return mixing.mix(docs, names=("_wl_shard", "_wl_position"), in_order=True).select(*[f"`{c}`" for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of whole documents and pieces, the training sequences.

    Null, empty and blank texts go into no bin, long ones into several; a null doc_id stays null; repeated rows are packed as often as they
    come; of equally full bins the oldest takes a piece.
    """
    return packing.best_fit(docs)


STAGES = [("quality rules", quality), ("near copies", near_copies), ("repeated passages", repeats), ("source mix", mix), ("packing", pack)]

#: Trained weights, fingerprints and keyed draws have no SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, nulls and all else as they say.

    What passes between them is written to the folder all executors share, and taken away when the next stage is written; what packing
    reads stays there, as the result still reads it.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return docs

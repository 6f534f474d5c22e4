"""Input formats: texts, catalogs, supplementary metadata, counts made elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(filename, text) from lines 'id<tab>text', plain or gzip; lines without a tab are left out, see bad_lines()."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).where(F.contains("value", F.lit("\t"))).select(parts[0].alias("filename"), parts[1].alias("text"))


def bad_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row: lines, lines without a tab, and whether these are over 1%."""
    bad = F.count_if(~F.contains("value", F.lit("\t")))
    return spark.read.text(path).agg(F.count("*").alias("lines"), bad.alias("bad"), (bad > F.count("*") * 0.01).alias("too_many"))


def whole_files(spark: SparkSession, folder: str) -> DataFrame:
    """(filename, text) from a folder with one text a file; the file's name without its ending is the id."""
    files = spark.read.text(folder, wholetext=True).withColumn("_path", F.input_file_name())
    return files.select(F.regexp_replace(F.element_at(F.split("_path", "/"), -1), r"\.[^.]*$", "").alias("filename"), F.col("value").alias("text"))


def catalog(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A catalog of JSON lines, or CSV with a header where the name ends in .csv.  Lines that aren't JSON are left out."""
    if path.split("?")[0].removesuffix(".gz").endswith(".csv"):
        return spark.read.csv(path, header=True, schema=schema)
    reader = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    if schema is None:
        df = reader.json(path)
        return df.where("filename is not null").drop("_corrupt") if "_corrupt" in df.columns else df
    return reader.json(path, schema=schema).where("filename is not null")


def metadata(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """Supplementary metadata from TSV with a header, or JSON lines, and the name of its key: the first column."""
    if path.removesuffix(".gz").endswith((".json", ".ndjson", ".jsonl")):
        df = spark.read.json(path)
        first = spark.read.text(path).first()
        import json

        return df, next(iter(json.loads(first[0]))) if first else df.columns[0]
    df = spark.read.csv(path, sep="\t", header=True)
    return df, df.columns[0]


def counted_words(lines: DataFrame, n: int = 1) -> DataFrame:
    """(filename, word or word1, word2.., count) from lines 'id<tab>word,count<form feed>word,count...', column value.

    The count follows the last comma, so words may hold commas; quotes around a word are taken off.  Entries whose count is no
    whole number are left out.  'NA' is a word like others.  Equal entries of a document add up.
    """
    parts = F.split("value", "\t", 2)
    entry = F.col("_e")
    word = F.regexp_replace(F.regexp_extract(entry, r"(?s)^(.*),\s*\d+\s*$", 1), '^"(.*)"$', "$1")
    rows = lines.where(F.contains("value", F.lit("\t"))).select(parts[0].alias("filename"), F.explode(F.split(parts[1], "\f")).alias("_e"))
    rows = rows.select("filename", word.alias("_w"), F.regexp_extract(entry, r",\s*(\d+)\s*$", 1).try_cast("bigint").alias("count")).where("count is not null and _w != ''")
    names = ["word"] if n == 1 else [f"word{k}" for k in range(1, n + 1)]
    words = F.split("_w", " ")
    rows = rows.select("filename", F.col("_w").alias("word"), "count") if n == 1 else rows.where(F.size(words) == n).select("filename", *[words[k].alias(names[k]) for k in range(n)], "count")
    return rows.groupBy("filename", *names).agg(F.sum("count").alias("count"))


def gram_size(path: str) -> int:
    """The n of a file of counted words, by its name."""
    return next((n for n, name in enumerate(("unigrams", "bigrams", "trigrams", "quadgrams"), 1) if f".{name}" in path), 1)


def feature_counts(counts: DataFrame) -> DataFrame:
    """(word, count, rank) from files of (word, count), added up: a ranked word list."""
    from wordloom.plans.corpus import ranked

    return ranked(counts.groupBy("word").agg(F.sum("count").alias("count")), "word", "rank")

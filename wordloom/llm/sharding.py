"""Sharding by sampled splitters.

Keys are drawn with a chance that grows with a record's bytes; the quantiles of such a sample are splitters that part bytes, not rows,
and records are range-partitioned between them.  All ranges start as one.  In each round exact bytes are counted by range, and
every overfull range is sampled within itself, all in one job, and subdivided at the quantiles of its own sample into at most FANOUT
ranges, so a range's sample is bounded and stays on the executors.  A key that fills whole quantiles becomes a range of its
own, and where that is overfull, which no boundary can mend, it is subdivided by a hash of the record.  Rounds end when
no overfull range holds two keys.  They read a narrow table of keys and sizes; the records themselves are read twice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.llm.spark_tools import checkpoint

TARGET_BYTES = 128 << 20
OVERSAMPLE = 64
FANOUT = 1024
SLACK = 1.25
SEED = 7


def _weight(docs: DataFrame) -> Column:
    return F.coalesce(F.octet_length(docs["text"]), F.lit(0)).cast("bigint") + 64  # 64: the other columns


def shard_key(docs: DataFrame) -> Column:
    """source, then doc_id zero-padded so that strings sort as the numbers do; nulls first."""
    number = F.coalesce(F.lpad((docs["doc_id"].cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("string"), 20, "0"), F.lit(""))
    return F.concat(F.coalesce(docs["source"], F.lit("")), F.lit("\x01"), number)


def _finer(keyed: DataFrame, splitters: list[str], over: list, oversample: float, seed: int) -> set[str]:
    """Splitters inside each range of over (r, w, lo, hi, pieces): at least one each, in (lo, hi]."""
    spark = keyed.sparkSession
    wanted = {x.r: (min(1.0, oversample * pieces / x.w), pieces) for x in over for pieces in [min(FANOUT, math.ceil(x.w / x.target))]}
    rates, many = np.zeros(len(splitters) + 1), np.ones(len(splitters) + 1, np.int64)
    for r, (rate, pieces) in wanted.items():
        rates[r], many[r] = rate, pieces
    shared = spark.sparkContext.broadcast((np.array(splitters, dtype=object), rates, many))

    @F.pandas_udf("struct<r:int,rate:double,pieces:bigint>")
    def draw(key: pd.Series) -> pd.DataFrame:
        cuts, rates, many = shared.value
        r = _number(cuts, key)
        return pd.DataFrame({"r": r.astype(np.int32), "rate": rates[r], "pieces": many[r]})

    chance = F.pmod(F.xxhash64(F.lit(seed), "h"), F.lit(1 << 40)) / float(1 << 40)
    hit = keyed.withColumn("x", draw(F.col("k"))).where(chance < F.col("w") * F.col("x.rate"))
    points = hit.groupBy("x.r", "k").agg(F.sum(F.greatest(1 / F.col("x.rate"), F.col("w").cast("double"))).alias("w"), F.first("x.pieces").alias("pieces"))
    by = Window.partitionBy("r")
    until = F.sum("w").over(by.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    step = F.sum("w").over(by) / F.col("pieces")
    found = points.select("r", "k", "w", "pieces", until.alias("until"), step.alias("step"))
    after, before = F.least(F.floor(F.col("until") / F.col("step")), F.col("pieces") - 1), F.floor((F.col("until") - F.col("w")) / F.col("step"))
    cuts: dict[int, set[str]] = {r: set() for r in wanted}
    for x in found.where(after > before).select("r", "k", (F.col("w") >= F.col("step")).alias("hot")).collect():  # splitters, not the sample
        cuts[x.r] |= {x.k, _next(x.k)} if x.hot else {x.k}
    added: set[str] = set()
    for x in over:
        added |= {c for c in cuts[x.r] if x.lo < c <= x.hi} or {_next(x.lo)}
    return added


def _next(key: str) -> str:
    """The least string above key: as a splitter it ends key's range."""
    return key + "\0"


def _number(cuts: np.ndarray, key: pd.Series) -> np.ndarray:
    return np.searchsorted(cuts, key.to_numpy(dtype=object), "right") if len(cuts) else np.zeros(len(key), np.int64)


def _range_of(spark: SparkSession, splitters: list[str]):
    shared = spark.sparkContext.broadcast(np.array(splitters, dtype=object))

    @F.pandas_udf("int")
    def number(key: pd.Series) -> pd.Series:
        return pd.Series(_number(shared.value, key).astype(np.int32))

    return number


class _Over:
    """An overfull range."""

    def __init__(self, row, target: int):
        self.r, self.w, self.lo, self.hi, self.target = row.r, row.w, row.lo, row.hi, target


def shard(docs: DataFrame, target_bytes: int = TARGET_BYTES, oversample: int = OVERSAMPLE, slack: float = SLACK, seed: int = SEED) -> DataFrame:
    """docs(doc_id, text, source, ...) with shard, numbered in key order, of about target_bytes of text each.

    No shard of several keys exceeds slack x target_bytes; a single key beyond that is subdivided by hash, evenly up to chance.  Keys: source and doc_id; null parts sort first.  Null and empty texts weigh
    64 bytes, as every record does besides its text; a text of any length stays whole.  Repeated rows share a key and a shard; where
    that key has to be subdivided they are dealt out one after the other, so that rows that are alike in all spread too, and any rerun of a task deals alike.  An empty table gives no rows.  All columns are kept; one called shard is replaced.
    Each shard is one Spark partition.  Only the splitters, as many as there are shards, reach the driver: take a larger
    target_bytes for more data.
    """
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c.lower() != "shard"]
    keyed = checkpoint(docs.select(shard_key(docs).alias("k"), _weight(docs).alias("w"), F.xxhash64(docs["doc_id"], docs["text"]).alias("h")))
    splitters: list[str] = []
    finer = oversample
    while True:
        sizes = keyed.groupBy(_range_of(spark, splitters)(F.col("k")).alias("r")).agg(F.sum("w").alias("w"), F.min("k").alias("lo"), F.max("k").alias("hi"))
        over = [_Over(x, target_bytes) for x in sizes.where(F.col("w") > slack * target_bytes).collect()]
        several = [x for x in over if x.lo != x.hi]
        if not several:
            break
        splitters = sorted({*splitters, *_finer(keyed, splitters, several, finer, seed)})
        finer *= 2
    parts = np.ones(len(splitters) + 1, np.int64)
    for x in over:
        parts[x.r] = math.ceil(x.w / target_bytes)
    base = np.concatenate([[0], np.cumsum(parts)]).astype(np.int64)
    shared = spark.sparkContext.broadcast((np.array(splitters, dtype=object), parts, base))

    @F.pandas_udf("int")
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        cuts, many, start = shared.value
        met: dict[int, int] = {}  # of subdivided keys: how often this task has met a record
        for key, h in batches:
            r, part = _number(cuts, key), h.to_numpy() // 64
            at = np.flatnonzero(many[r] > 1)
            if len(at):
                mine = h.iloc[at]
                part[at] += (mine.groupby(mine).cumcount() + mine.map(met).fillna(0)).to_numpy().astype(np.int64)
                for x, n in mine.value_counts().items():
                    met[x] = met.get(x, 0) + n
            yield pd.Series((start[r] + part % many[r]).astype(np.int32))

    whole = [docs[f"`{c}`"] for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    out = docs.withColumn("_wl_p", place(shard_key(docs), F.xxhash64(F.lit(seed + 1), *whole)))
    return out.select(*[F.col(f"`{c}`") for c in keep], F.col("_wl_p").alias("shard")).repartitionById(int(base[-1]), "shard")


def op8_range_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards of TARGET_BYTES; nulls, empty and long texts, ties, repeats and clashing names as shard() says."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))

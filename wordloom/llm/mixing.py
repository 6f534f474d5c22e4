"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Each source's rows get exact ranks, in an order drawn from a keyed hash of the row; runs of block_rows ranks are blocks.
   Ranks come from counts by (source, hash bin), so no task ever sorts a whole source, however hot it is.
2. The target weights and the rows at hand give each source an exact quota of blocks, without repetition.  Given weights are
   met exactly, so the scarcest source sets the total.  Weights derived from the counts are met as far as rows go: a source
   that runs out gives all, the others share the rest.
3. A binary tree over the output shards splits the quota vector: at each node the left half's vector is one multivariate
   hypergeometric draw without replacement, so the leaves add up to the quotas exactly.
4. A shard's blocks of a source are a range of a keyed permutation of that source's block numbers: disjoint by
   construction.  Inside a shard, a keyed permutation of its positions shuffles the rows.
Steps 2 and 3 depend on the sources and shards alone; everything by row is arithmetic on the rank, with one shuffle.
"""

from __future__ import annotations

import logging
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.llm.text import mix64

log = logging.getLogger(__name__)
BLOCK_ROWS = 16
SHARDS = 16
SEED = 20240229
ALPHA = 0.5
BIN_ROWS = 2048
RUN_ROWS = 8192
#: with derived weights: sources that hold no more than this share of the rows together never set the total, and of all rows
#: at least this share is drawn
RARE = 0.01
LEAST = 0.5
ROUND_KEYS = np.array([r * 0x9E3779B97F4A7C15 % 2**64 for r in range(4)], np.uint64)
DEST = "struct<shard:int,position:bigint>"


class Derived(dict):
    """Weights that follow from the counts, to be met as far as rows go."""


def target_weights(counts: dict, alpha: float = ALPHA) -> Derived:
    """Weights in proportion to rows ** alpha: 1 keeps the sources as they are, 0 makes them equal."""
    raw = {s: n**alpha for s, n in counts.items() if n}
    whole = sum(raw.values())
    return Derived({s: w / whole for s, w in raw.items()})


def fill(counts: dict, weights: dict) -> dict:
    """Rows to draw from each source, as a fraction: min(rows, level * weight) with one level for all.

    The level is where the first source runs out, those not counted that hold no more than RARE of the rows together; or, if
    that draws less than LEAST of the rows, the level that draws so many.
    """
    scarce = sorted(weights, key=lambda s: (counts[s] / weights[s], str(s)))
    whole = sum(counts[s] for s in scarce)
    rows = 0
    for s in scarce:
        rows += counts[s]
        if rows > RARE * whole:
            break
    level = counts[s] / weights[s]
    if sum(min(counts[s], level * w) for s, w in weights.items()) < LEAST * whole:
        want, left = LEAST * whole, sum(weights.values())
        for s in scarce:
            level = want / left
            if level <= counts[s] / weights[s]:
                break
            want, left = want - counts[s], left - weights[s]
    return {s: min(counts[s], level * w) for s, w in weights.items()}


def block_quotas(counts: dict, weights: dict, block_rows: int) -> dict:
    """Blocks to draw from each source: the largest mix in the given weights that no source has to repeat rows for.

    Shares are shares of rows, so a source's short last block counts by its rows.  They are rounded to blocks by largest remainder,
    never beyond a source's blocks, and a source with weight and rows gives one block at least.  A source without weight gives none.
    Derived weights give what fill() says, rounded up, so that no source is left out.
    """
    blocks = {s: math.ceil(n / block_rows) for s, n in counts.items()}
    live = {s: w for s, w in weights.items() if w > 0 and blocks.get(s)}
    if not live:
        return dict.fromkeys(counts, 0)
    if isinstance(weights, Derived):
        return dict.fromkeys(counts, 0) | {s: min(blocks[s], math.ceil(x / block_rows - 1e-9)) for s, x in fill(counts, live).items()}
    whole = sum(live.values())
    live = {s: w / whole for s, w in live.items()}
    total = min(counts[s] / w for s, w in live.items())
    exact = {s: blocks[s] if total * w > counts[s] - 1e-6 else total * w / block_rows for s, w in live.items()}
    quota = {s: math.floor(x + 1e-9) for s, x in exact.items()}
    for s in sorted(live, key=lambda s: (quota[s] - exact[s], str(s)))[: max(0, round(sum(exact.values())) - sum(quota.values()))]:
        quota[s] = min(blocks[s], quota[s] + 1)
    return dict.fromkeys(counts, 0) | {s: max(1, q) for s, q in quota.items()}


def splitting_tree(quota: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Block counts by (shard, source); columns add up to quota, rows to the even share of the total."""
    out = np.zeros((shards, len(quota)), np.int64)
    share = np.arange(shards + 1, dtype=np.int64) * int(quota.sum()) // shards
    todo = [(0, shards, quota.astype(np.int64))]
    while todo:
        lo, hi, have = todo.pop()
        if hi - lo == 1:
            out[lo] = have
            continue
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left, rest, want = np.zeros_like(have), int(have.sum()), int(share[mid] - share[lo])
        for k, n in enumerate(have):  # one source after the other: the multivariate draw as conditional draws
            rest -= int(n)
            left[k] = _hypergeometric(rng, int(n), rest, want)
            want -= int(left[k])
        todo += [(lo, mid, left), (mid, hi, have - left)]
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    if not good or not draws:
        return 0
    if not bad:
        return draws
    return int(rng.hypergeometric(good, bad, draws)) if good + bad < 10**9 else inverted(rng, good, bad, draws)


def inverted(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """The same draw beyond numpy's range, by inversion: the distribution from its mode outwards, as far as a double can tell."""
    mode = (draws + 1) * (good + 1) // (good + bad + 2)
    reach = 60 + int(14 * math.sqrt(draws * good / (good + bad) * bad / (good + bad) * (good + bad - draws) / (good + bad - 1)))
    lo, hi = max(0, draws - bad, mode - reach), min(good, draws, mode + reach)
    k = np.arange(lo, hi, dtype=np.float64)
    log_p = np.concatenate([np.zeros(1), np.cumsum(np.log((good - k) / (k + 1) * ((draws - k) / (bad - draws + k + 1))))])
    chance = np.cumsum(np.exp(log_p - log_p.max()))
    return lo + int(np.searchsorted(chance, rng.random() * chance[-1], "right"))


def permute(x: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0 .. size - 1 applied to x: four Feistel rounds, walking on until inside the range."""
    bits = np.maximum(1, np.ceil(np.log2(np.maximum(size, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    out, todo = x.astype(np.uint64), np.arange(len(x))
    while len(todo):
        b, m, k = bits[todo], mask[todo], key[todo]
        left, right = out[todo] >> b, out[todo] & m
        for r in range(len(ROUND_KEYS)):
            left, right = right, left ^ (mix64(right + k + ROUND_KEYS[r]) & m)
        y = (left << b) | right
        out[todo] = y
        todo = todo[y >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


class Plan:
    """Where each (source, rank) goes.  Small: sources x shards numbers."""

    def __init__(self, counts: dict, weights: dict | None, block_rows: int, shards: int, seed: int, alpha: float = ALPHA):
        self.names = sorted(counts, key=lambda s: (s is not None, s))
        self.code = {s: k for k, s in enumerate(self.names)}
        self.rows = np.array([counts[s] for s in self.names], np.int64)
        chosen = target_weights(counts, alpha) if weights is None else weights
        quota = block_quotas(counts, chosen, block_rows)
        self.quota = np.array([quota[s] for s in self.names], np.int64)
        self.blocks = -(-self.rows // block_rows)
        self.target = np.array([chosen.get(s, 0) for s in self.names], np.float64)
        self.tree = splitting_tree(self.quota, shards, seed)
        self.block_rows, self.shards, self.seed = block_rows, shards, seed
        self.until = np.cumsum(self.tree, axis=0)  # permuted block numbers below until[j, s] belong to shards 0 .. j
        # position of a shard's first block of a source among the shard's blocks
        self.before = np.cumsum(self.tree, axis=1) - self.tree
        self.in_shard = self.tree.sum(axis=1)

    def reached(self) -> dict:
        """By source: target share, share of the drawn blocks, blocks drawn, blocks at hand."""
        share = self.quota / max(1, self.quota.sum())
        target = self.target / (self.target.sum() or 1)
        return dict(zip(self.names, zip(target.tolist(), share.tolist(), self.quota.tolist(), self.blocks.tolist(), strict=True), strict=True))

    def place(self, source: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shard, -1 for none, and position in the shard."""
        seed = np.uint64(self.seed)
        block = permute(rank // self.block_rows, self.blocks[source], mix64(source.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + seed))
        shard = np.full(len(rank), -1, np.int64)
        slot = np.zeros(len(rank), np.int64)
        for s in np.unique(source):
            at = np.flatnonzero(source == s)
            at = at[block[at] < self.quota[s]]
            j = np.searchsorted(self.until[:, s], block[at], "right")
            shard[at] = j
            slot[at] = self.before[j, s] + block[at] - (self.until[j, s] - self.tree[j, s])
        position = np.zeros(len(rank), np.int64)
        at = np.flatnonzero(shard >= 0)
        size = self.in_shard[shard[at]] * self.block_rows
        position[at] = permute(slot[at] * self.block_rows + rank[at] % self.block_rows, size, mix64(shard[at].astype(np.uint64) ^ (seed << np.uint64(20))))
        return shard, position


def mix(docs: DataFrame, weights: dict | None = None, alpha: float = ALPHA, block_rows: int = BLOCK_ROWS, shards: int = SHARDS, seed: int = SEED, names: tuple[str, str] = ("shard", "position"), in_order: bool = False) -> DataFrame:
    """The drawn rows of docs(doc_id, text, source, ...) with shard and position, which orders a shard (with gaps after short blocks).

    weights: by source, met exactly, or None for rows ** alpha, met as far as rows go; the quotas reached are logged.  A null source is a source of its own, the empty string another.  Rows
    are told apart by a hash of doc_id and text; equal rows are interchangeable and keep their number, null ids and texts
    count as values.  An empty table gives no rows.  All columns of docs are kept, but those called as
    names says the two new ones are.  in_order: every partition of the result is a run of one shard's positions, sorted, of about RUN_ROWS rows
    at most; that shuffles the drawn rows once more.  The same rows and seed give the same mix whatever the partitioning.  Only the counts by source, as many
    numbers as there are sources, reach the driver; what goes to the tasks has a few numbers for each source and shard.  Texts of any
    length move whole, in one shuffle.
    """
    counts = {r[0]: r[1] for r in docs.groupBy(docs["source"].alias("_wl_s")).count().collect()}
    plan = Plan(counts, weights, block_rows, shards, seed, alpha)
    for s, x in plan.reached().items():
        log.info("source %r: target %.4f, reached %.4f, %d of %d blocks", s, *x)
    bins = max(1, math.ceil(max(counts.values(), default=1) / BIN_ROWS))
    keep = [c for c in docs.columns if c.lower() not in {x.lower() for x in names}]
    spark = docs.sparkSession
    number = F.coalesce(F.concat(F.lit("="), docs["source"]), F.lit(""))  # the null source apart from the empty one
    order = F.xxhash64(F.lit(seed), docs["doc_id"], docs["text"])
    tagged = docs.withColumns({"_wl_s": number, "_wl_h": order}).withColumn("_wl_b", F.pmod(F.shiftright("_wl_h", 20), F.lit(bins)))
    offsets = tagged.groupBy("_wl_s", "_wl_b").agg(F.count("*").alias("_wl_n"))
    offsets = offsets.select("_wl_s", "_wl_b", (F.sum("_wl_n").over(Window.partitionBy("_wl_s").orderBy("_wl_b")) - F.col("_wl_n")).alias("_wl_o"))
    held = F.row_number().over(Window.partitionBy("_wl_s", "_wl_b").orderBy("_wl_h"))
    ranked = tagged.withColumn("_wl_r", held - 1).join(offsets, ["_wl_s", "_wl_b"])
    shared = spark.sparkContext.broadcast(plan)

    @F.pandas_udf(DEST)
    def place(source: pd.Series, rank: pd.Series) -> pd.DataFrame:
        known = shared.value
        which, names = pd.factorize(source)
        code = np.array([known.code[s[1:] if s else None] for s in names], np.int64)
        shard, position = known.place(code[which], rank.to_numpy())
        return pd.DataFrame({"shard": shard.astype(np.int32), "position": position})

    placed = ranked.withColumn("_wl_d", place(F.col("_wl_s"), F.col("_wl_r") + F.col("_wl_o")))
    placed = placed.where("_wl_d.shard >= 0")
    if in_order:
        size = max(1, int(plan.in_shard.max()) * block_rows)
        runs = math.ceil(size / RUN_ROWS)
        run = F.col("_wl_d.shard") * runs + F.floor(F.col("_wl_d.position") / math.ceil(size / runs)).cast("int")
        placed = placed.repartitionById(shards * runs, run).sortWithinPartitions("_wl_d.shard", "_wl_d.position")
    return placed.select(*[F.col(f"`{c}`") for c in keep], F.col("_wl_d.shard").alias(names[0]), F.col("_wl_d.position").alias(names[1]))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents with derived weights; nulls, empty and long texts, ties, repeats and clashing names as mix() says."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Quality rules as hashed n-gram logistic regression.

Features are the mean counts of hashed character 3-, 4- and 5-grams (of the raw UTF-8 bytes, so that capitals and symbols
count) and of hashed words and word pairs, where a word that stands twice running is one pair whatever the word; each kind has its own 2**18 slots.  Training sees a bounded sample of labelled
rows; the margin is calibrated on a held-out part of it.  The model, a few megabytes, is broadcast; scoring reads Arrow batches,
hashes all n-grams of a batch at once and adds weights by cumulative sums, so it costs some array passes a byte.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.labels import platt, sample
from wordloom.llm.text import Words, mix64, slices

BITS = 18
SLOTS = 1 << BITS
CHARS = (3, 4, 5)
KINDS = len(CHARS) + 2
SCALE = 20.0
#: bound of the training sample, rows of each label; one row in HELD_OUT of it is kept for calibration
PER_CLASS = 1500
HELD_OUT = 4
ROUNDS = 40
BLOCK = 1 << 20
RATE = 0.1
DECAY = 1e-5
#: a document is kept if its chance of being good is at least this
KEEP = 0.5


def ngrams(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind: the slot of the n-gram at every place, and the places [start, end) of each row."""
    raw = words.raw.astype(np.uint64)
    start, end = words.off[:-1], words.off[1:]
    for kind, n in enumerate(CHARS):
        size = max(0, len(raw) - n + 1)
        code = np.zeros(size, np.uint64)
        for i in range(n):
            code = (code << np.uint64(8)) | raw[i : i + size]
        slot = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64) + kind * SLOTS
        yield slot, np.minimum(start, size), np.minimum(np.maximum(start, end - n + 1), size)
    kind = len(CHARS)
    h = words.h
    a, b = words.first[:-1], words.first[1:]
    yield (h >> np.uint64(64 - BITS)).astype(np.int64) + kind * SLOTS, a, b
    size = max(0, len(h) - 1)
    pair = mix64(h[:size] * np.uint64(3) + h[1:]) if size else h[:0]
    pair = np.where(h[:size] == h[1:], np.uint64(0), pair)
    yield (pair >> np.uint64(64 - BITS)).astype(np.int64) + (kind + 1) * SLOTS, np.minimum(a, size), np.minimum(np.maximum(a, b - 1), size)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    a: float
    b: float

    def margin(self, column: pa.Array) -> np.ndarray:
        words = Words(column)
        out = np.full(len(column), self.bias)
        for slot, start, end in ngrams(words):
            total = np.zeros(len(slot) + 1)
            np.cumsum(self.weights[slot], out=total[1:])
            out += SCALE * (total[end] - total[start]) / np.maximum(1, end - start)
        return out

    def chance(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.margin(column) + self.b, -500, 500)))


def _parts(texts: list[str]) -> Iterator[pa.RecordBatch]:
    return slices(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"])]), "t", 1 << 18)


def _matrix(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of (slot, value) one after the other, and their offsets."""
    slots, values, sizes = [], [], []
    for part in _parts(texts):
        grams = list(ngrams(Words(part.column(0))))
        for i in range(part.num_rows):
            n = 0
            for slot, start, end in grams:
                if end[i] > start[i]:
                    u, c = np.unique(slot[start[i] : end[i]], return_counts=True)
                    slots.append(u.astype(np.int32))
                    values.append((SCALE * c / (end[i] - start[i])).astype(np.float32))
                    n += len(u)
            sizes.append(n)
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return np.concatenate(slots) if slots else np.zeros(0, np.int32), np.concatenate(values) if values else np.zeros(0, np.float32), first


def train(texts: list[str], y: np.ndarray, prior: float) -> Model:
    """Logistic regression by full-batch Adam with equal weight on both labels, then Platt calibration for the share prior of good rows.

    Without rows of both labels nothing can be learned: every text then has the chance prior.
    """
    empty = Model(np.zeros(KINDS * SLOTS, np.float32), 0.0, 0.0, float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9))))
    held = np.zeros(len(y), bool)
    for label in (0, 1):
        held[np.flatnonzero(y == label)[::HELD_OUT]] = True
    fit = np.flatnonzero(~held)
    if len(set(y[fit].tolist())) < 2 or len(set(y[held].tolist())) < 2:
        return empty
    slot, value, first = _matrix([texts[i] for i in fit])
    target = y[fit].astype(np.float64)
    cost = np.where(target == 1, 0.5 / max(1, target.sum()), 0.5 / max(1, (1 - target).sum()))
    # rows are taken in blocks of about BLOCK entries, so that training holds little besides the entries themselves
    blocks = [0]
    while blocks[-1] < len(target):
        blocks.append(max(blocks[-1] + 1, int(np.searchsorted(first, first[blocks[-1]] + BLOCK, "right")) - 1))
    w, bias = np.zeros(KINDS * SLOTS), 0.0
    m, v = np.zeros(KINDS * SLOTS + 1), np.zeros(KINDS * SLOTS + 1)
    for step in range(1, ROUNDS + 1):
        grad = np.append(DECAY * w, 0.0)
        for lo, hi in itertools.pairwise(blocks):
            at, size = slice(first[lo], first[hi]), np.diff(first[lo : hi + 1])
            total = np.concatenate([np.zeros(1), np.cumsum(w[slot[at]] * value[at])])
            off = first[lo : hi + 1] - first[lo]
            p = 1 / (1 + np.exp(-np.clip(total[off[1:]] - total[off[:-1]] + bias, -50, 50)))
            error = cost[lo:hi] * (p - target[lo:hi])
            grad[:-1] += np.bincount(slot[at], value[at] * np.repeat(error, size), KINDS * SLOTS)
            grad[-1] += error.sum()
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w -= move[:-1]
        bias -= float(move[-1])
    model = Model(w.astype(np.float32), bias, 1.0, 0.0)
    rest = np.flatnonzero(held)
    model.a, model.b = platt(np.concatenate([model.margin(part.column(0)) for part in _parts([texts[i] for i in rest])]), y[rest], prior)
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    return train(*sample(docs, labels, "quality", per_class))


def _score(batches: Iterable[pa.RecordBatch], model: Model, keep: float | None, column: str) -> Iterator[pa.RecordBatch]:
    for part in slices(iter(batches), "text"):
        chance = pa.array(model.chance(part.column("text")))
        part = part.append_column(column, chance)
        yield part if keep is None else part.filter(pa.compute.greater_equal(chance, keep))


def score(docs: DataFrame, model: Model, keep: float | None = None, column: str = "p_good") -> DataFrame:
    """docs with the calibrated chance that a row's text is good; only rows of at least keep, if given.

    Whole texts are scored, however long.  Every row has a score: null and empty texts have no n-grams and get the model's chance for that, the bias.  Repeated rows, and texts of the same n-grams,
    score alike.  An empty table stays empty.  All columns of docs are kept; one that is called like the score is replaced.
    """
    import pyarrow.compute  # noqa: F401  (pa.compute in the workers)

    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != column.lower()])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        return _score(batches, shared.value, keep, column)

    return docs.mapInArrow(run, f"{fields}, `{column}` double")


def keep_good(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """The rows of docs whose calibrated chance of being good is at least keep; columns as they are."""
    return score(docs, fit(docs, labels), keep, "_wl_p").drop("_wl_p")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score; keep: whether the rules keep it.  Nulls, empty and long texts, ties, repeats, empty tables and
    other columns as score() says."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.select("doc_id", "text"), model).select("doc_id", "p_good", (F.col("p_good") >= KEEP).alias("keep"))

"""Quality classifier by compression.

Two zstandard dictionaries are built from good and from bad labelled text.  A text is compressed with each; the difference of the
two sizes over their sum says which it resembles, and a logistic curve fitted on held-out rows turns it into the chance that
the text is good.  The curve also sees how far the text shrank, since one that repeats itself does so alike with either
dictionary, and its length, on which both depend.  Dictionaries are digested once in each task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.labels import logistic, sample
from wordloom.llm.text import slices, utf8

#: bound of the training sample, rows of each label; one row in HELD_OUT of it is kept for calibration
PER_CLASS = 1500
HELD_OUT = 4
DICT_BYTES = 1 << 18
LEVEL = 3
#: a document is kept if its chance of being good is at least this
KEEP = 0.5


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: np.ndarray  # of difference, logarithm of the ratio, logarithm of the length
    bias: float

    def __post_init__(self):
        self._pair: list | None = None

    def __getstate__(self):
        return {"good": self.good, "bad": self.bad, "weights": self.weights, "bias": self.bias, "_pair": None}

    def measures(self, column: pa.Array) -> np.ndarray:
        """Of each text: (bad - good) / (bad + good) of the compressed sizes, above 0 if it is more like the good ones; the mean of the two over its own size; its size."""
        if self._pair is None:
            self._pair = []
            for data in (self.good, self.bad):
                known = zstandard.ZstdCompressionDict(data)
                known.precompute_compress(level=LEVEL)
                self._pair.append(zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_dict_id=False, write_checksum=False))
        raw, off = utf8(column)
        view = memoryview(raw)
        good, bad = self._pair
        out = np.tile([0.0, 1.0, 1.0], (len(column), 1))
        for i in range(len(column)):
            text = view[off[i] : off[i + 1]]
            if len(text):
                g, b = len(good.compress(text)), len(bad.compress(text))
                out[i] = (b - g) / (b + g), (b + g) / 2 / len(text), len(text)
        return out

    def chance(self, column: pa.Array) -> np.ndarray:
        return self.chance_of(self.measures(column))

    def chance_of(self, measured: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_inputs(measured) @ self.weights + self.bias, -500, 500)))


def _inputs(measured: np.ndarray) -> np.ndarray:
    return np.stack([measured[:, 0], np.log(measured[:, 1]), np.log(measured[:, 2])], axis=1)


def _dictionary(texts: list[str]) -> bytes:
    """A trained dictionary; of too few texts for training, the texts themselves, which then are few."""
    data = [t.encode() for t in texts]
    try:
        return zstandard.train_dictionary(DICT_BYTES, data).as_bytes()
    except zstandard.ZstdError:
        return (b"\n".join(data) or b"\n" * 8).rjust(8)


def train(texts: list[str], y: np.ndarray, prior: float) -> Model:
    """Without rows of both labels on both sides of the split every text has the chance prior."""
    held = np.zeros(len(y), bool)
    for label in (0, 1):
        held[np.flatnonzero(y == label)[::HELD_OUT]] = True
    fit, rest = np.flatnonzero(~held), np.flatnonzero(held)
    model = Model(*[_dictionary([texts[i] for i in fit if y[i] == label]) for label in (1, 0)], np.zeros(3), float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9))))
    if len(set(y[fit].tolist())) == 2 and len(set(y[rest].tolist())) == 2:
        model.weights, model.bias = logistic(_inputs(model.measures(pa.array([texts[i] for i in rest], pa.string()))), y[rest], prior)
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    return train(*sample(docs, labels, "quality", per_class))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, difference, ratio, p_good) for each row of docs(doc_id, text).

    Whole texts are compressed, however long.  Null and empty texts count as of difference 0, ratio 1 and length 1.  Repeated
    rows and texts of equal sizes score alike, null ids are kept, other columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(iter(batches), "text"):
            found = shared.value.measures(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x) for x in (found[:, 0], found[:, 1], shared.value.chance_of(found)))], names=["doc_id", "difference", "ratio", "p_good"])

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, "doc_id bigint, difference double, ratio double, p_good double")


def op3_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its scores; keep: whether it scores at least KEEP.  Nulls, empty and long texts, ties, repeats and
    other columns as score() says; labels as labels.sample() does."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).withColumn("keep", F.col("p_good") >= KEEP)

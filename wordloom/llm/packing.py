"""Best-fit packing of documents into fixed-length training sequences.

Bounded-space online best-fit: documents arrive in table order; at most open_bins bins are open in a task, kept in a
bitset keyed by free space, so the tightest bin that still takes a piece is one shift and one lowest-set-bit away.  When a
new bin is needed and all are open, the fullest closes first.  There is no shuffle: each task packs the rows it reads, and
a bin never spans tasks, so a lost task is packed again alone.  A task leaves at most open_bins bins partly filled.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from wordloom.llm.text import slices, utf8

CAPACITY = 2048
OPEN_BINS = 64
BATCH_BYTES = 1 << 22

ITEM = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("n_tokens", pa.int32()), ("text", pa.string())])
SCHEMA = pa.schema([("bin", pa.int64()), ("used", pa.int32()), ("free", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("items", pa.list_(ITEM))])
DDL = "bin bigint, used int, free int, doc_ids array<bigint>, items array<struct<doc_id:bigint,piece:int,n_tokens:int,text:string>>"


class BestFit:
    """The packer of one task.  add() returns the bins that close; close() the rest, fullest first."""

    def __init__(self, capacity: int, open_bins: int):
        if capacity < 1 or open_bins < 1:
            raise ValueError("capacity and open_bins must be positive")
        self.capacity, self.open_bins = capacity, open_bins
        self.mask = 0
        self.count = 0
        self.by_free: list[deque] = [deque() for _ in range(capacity + 1)]

    def _take(self, free: int) -> list:
        bins = self.by_free[free]
        out = bins.popleft()
        if not bins:
            self.mask &= ~(1 << free)
        self.count -= 1
        return out

    def _put(self, free: int, items: list) -> None:
        self.by_free[free].append(items)
        self.mask |= 1 << free
        self.count += 1

    def add(self, length: int, item) -> list[tuple[int, list]]:
        closed = []
        fits = self.mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            items = self._take(free)
        else:
            if length < self.capacity and self.count == self.open_bins:
                free = (self.mask & -self.mask).bit_length() - 1
                closed.append((free, self._take(free)))
            free, items = self.capacity, []
        items.append(item)
        if free == length:
            closed.append((0, items))
        else:
            self._put(free - length, items)
        return closed

    def close(self) -> Iterator[tuple[int, list]]:
        while self.mask:
            free = (self.mask & -self.mask).bit_length() - 1
            yield free, self._take(free)


def pieces(text: memoryview, starts: np.ndarray, capacity: int) -> Iterator[tuple[int, memoryview]]:
    """(tokens, bytes) of at most capacity tokens each; the bytes of all pieces together are the whole text."""
    n = len(starts)
    for k in range(0, n, capacity):
        a = 0 if k == 0 else int(starts[k])
        b = len(text) if k + capacity >= n else int(starts[k + capacity])
        yield min(capacity, n - k), text[a:b]


def token_starts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Byte offsets at which a token, a run without ASCII white space, begins."""
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    first = ~space
    first[1:] &= space[:-1]
    at = off[:-1][off[:-1] < len(raw)]
    first[at] = ~space[at]
    return np.flatnonzero(first)


def _pack(batches: Iterable[pa.RecordBatch], capacity: int, open_bins: int) -> Iterator[pa.RecordBatch]:
    packer = BestFit(capacity, open_bins)
    base = TaskContext.get().partitionId() << 33 if TaskContext.get() else 0
    made, held, ready = 0, 0, []

    def flush() -> pa.RecordBatch:
        nonlocal held
        sizes = np.array([len(items) for _, _, items in ready], np.int64)
        off = np.zeros(len(ready) + 1, np.int32)
        np.cumsum(sizes, out=off[1:])
        flat = [x for _, _, items in ready for x in items]
        ids = pa.array([x[0] for x in flat], pa.int64())
        item = pa.StructArray.from_arrays([ids, pa.array([x[1] for x in flat], pa.int32()), pa.array([x[2] for x in flat], pa.int32()), pa.array([x[3] for x in flat], pa.string())], fields=list(ITEM))
        free = np.array([f for _, f, _ in ready], np.int32)
        out = pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in ready], pa.int64()), pa.array(capacity - free, pa.int32()), pa.array(free), pa.ListArray.from_arrays(pa.array(off), ids), pa.ListArray.from_arrays(pa.array(off), item)], schema=SCHEMA)
        ready.clear()
        held = 0
        return out

    for part in slices(iter(batches), "text"):
        raw, off = utf8(part.column("text"))
        starts = token_starts(raw, off)
        first = np.searchsorted(starts, off)
        view = memoryview(raw)
        for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
            a, b = int(off[i]), int(off[i + 1])
            for k, (length, text) in enumerate(pieces(view[a:b], starts[first[i] : first[i + 1]] - a, capacity)):
                held += len(text)
                for free, items in packer.add(length, (doc_id, k, length, bytes(text))):
                    ready.append((base + made, free, items))
                    made += 1
            if held > BATCH_BYTES and ready:
                yield flush()
    for free, items in packer.close():
        ready.append((base + made, free, items))
        made += 1
    if ready:
        yield flush()


def best_fit(docs: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Pack docs(doc_id, text) into bins of capacity white-space tokens; one row a bin.

    Texts of more than capacity tokens are cut into full pieces and a remainder; joined in order of piece, the pieces
    give back the text byte for byte.  Null, empty and blank texts have no tokens and go into no bin.  A null doc_id is
    kept as null; repeated rows are packed as often as they come; equal free space goes to the bin that has had it longest.
    An empty table gives no rows.  Other columns are ignored, whatever their names.
    """
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text")).mapInArrow(lambda it: _pack(it, capacity, open_bins), DDL)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in bins; nulls, empty and long texts, ties, repeats, empty tables and other columns as best_fit() says."""
    return best_fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))

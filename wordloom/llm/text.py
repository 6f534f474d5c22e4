"""Vectorised access to the bytes and words of an Arrow string column.

A *word* is a maximal run of ASCII letters or digits and of non-ASCII characters, without the punctuation and space
blocks U+0080-U+00BF, U+2000-U+207F and U+3000-U+303F (WORD is the same as a regular expression).  Words compare after
folding ASCII and Latin-1 capitals; folding keeps byte lengths, so word offsets hold in the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORD = re.compile("[A-Za-z0-9À-῿₀-⿿぀-\U0010ffff]+")
SLICE_BYTES = 1 << 19

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_B_INV = np.uint64(pow(int(_B), -1, 1 << 64))
_powers: list[np.ndarray] = []

_ASCII = np.zeros(256, bool)
_ASCII[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def fold(text: str) -> str:
    """The folding of the module in plain Python, for brute-force comparison."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" or ("À" <= c <= "Þ" and c != "×") else c for c in text)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        m = max(n, 1 << 16)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m - 1, b, np.uint64)])) for b in (_B, _B_INV)]
    return _powers[0][:n], _powers[1][:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over values modulo 2**64; span() reads the hash of any range from them.  Values count from one, so that zeros count too."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values + np.uint64(1)) * _pow(len(values))[0], out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges [start, end), independent of where the range stands."""
    return mix64((sums[end] - sums[start]) * _pow(len(sums))[1][start] + (end - start).astype(np.uint64))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, nulls as empty, and each row's offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of a slice hold about limit bytes; a longer single text is a slice of its own."""
    for batch in batches:
        off = utf8_offsets(batch.column(column))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def utf8_offsets(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(column.type)
    offsets = column.buffers()[1]
    if len(column) == 0 or offsets is None:
        return np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)


class Words:
    """The words of each row: s and e are byte ranges, h hashes, first[i]:first[i + 1] the words of row i."""

    def __init__(self, column: pa.Array):
        raw, self.off = utf8(column)
        n = len(raw)
        self.raw = raw
        folded = _FOLD[raw]
        word = _ASCII[raw]
        high = raw >= 128
        if high.any():
            lead = np.flatnonzero((raw == 0xC2) | (raw == 0xC3) | (raw == 0xE2) | (raw == 0xE3))
            lead = lead[lead + 1 < n]
            b0, b1 = raw[lead], raw[lead + 1]
            two = lead[b0 == 0xC2]
            three = lead[((b0 == 0xE2) & ((b1 == 0x80) | (b1 == 0x81))) | ((b0 == 0xE3) & (b1 == 0x80))]
            word[two] = word[two + 1] = False
            for k in range(3):
                word[three + k] = False
            capital = lead[(b0 == 0xC3) & (b1 >= 0x80) & (b1 <= 0x9E) & (b1 != 0x97)] + 1
            folded[capital] += 32
        before, after = np.empty(n, bool), np.empty(n, bool)
        if n:
            before[0], after[-1] = False, False
            before[1:], after[:-1] = word[:-1], word[1:]
            inner = self.off[(self.off > 0) & (self.off < n)]
            before[inner] = False
            after[inner - 1] = False
        self.folded = folded
        self.s = np.flatnonzero(word & ~before)
        self.e = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.s, self.off)
        self._h: np.ndarray | None = None

    @property
    def h(self) -> np.ndarray:
        if self._h is None:
            self._h = span(prefix(self.folded.astype(np.uint64) + np.uint64(1)), self.s, self.e)
        return self._h

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def char_index(raw: np.ndarray) -> np.ndarray:
    """For each byte offset, 0 to len(raw), how many characters begin before it."""
    out = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=out[1:])
    return out

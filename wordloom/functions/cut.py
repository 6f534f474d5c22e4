"""Tokens of Arrow texts, cut in NumPy: the same that PATTERN finds, without a regular expression.

Every character that is no separator is in one token, so tokens are where runs of letters begin and end, but for what joins a run with its neighbours: a
possessive ('s), a decimal point, a dollar before a number, the point of an abbreviation, a sharp.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from wordloom.functions.tokens import ABBREVIATIONS

#: bytes of text whose tokens are counted together; a longer text is counted alone
PIECE = 4 << 20
#: bytes of text that are cut at a time, so that they stay in the cache
FEW = 1 << 20
SEPARATOR, MARK, LETTER, DIGIT = range(4)
_KINDS: dict[str, bytes] = {}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LENGTH = np.ones(256, np.int32)
_LENGTH[0xC0:0xE0], _LENGTH[0xE0:0xF0], _LENGTH[0xF0:] = 2, 3, 4
_SHARP = np.isin(np.arange(256), [*b"abcdefgjx"])
_SHORT = np.array(sorted(int.from_bytes(x.encode(), "little") for x in ABBREVIATIONS), np.int64)


def kinds(spark: SparkSession) -> bytes:
    """What each code point is, by the classes of the JVM's regular expressions, whose version of Unicode may not be Python's; packed."""
    if "packed" not in _KINDS:
        some = [*range(0xD800), *range(0xE000, 0x110000)]
        text = "".join(map(chr, some))
        for what, by in ((r"[\p{L}\p{M}\p{Pc}]", "a"), (r"\p{Nd}", "0"), (r"\p{Z}", " "), ("[^a0 ]", ".")):
            text = spark._jvm.java.util.regex.Pattern.compile(what).matcher(text).replaceAll(by)
        of = np.full(0x110000, MARK, np.uint8)
        as_kind = np.zeros(256, np.uint8)
        as_kind[[*b" .a0"]] = SEPARATOR, MARK, LETTER, DIGIT
        of[some] = as_kind[np.frombuffer(text.encode(), np.uint8)]
        _KINDS["packed"] = zlib.compress(of.tobytes())
    return _KINDS["packed"]


@cache
def unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def pieces(batches: Iterable[pa.RecordBatch], most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The rows of batches, whose first column is a text, anew in batches of about most bytes of text."""
    held: list[pa.RecordBatch] = []
    room = most
    for batch in batches:
        until = np.cumsum(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < len(until):
            before = until[a - 1] if a else 0
            b = int(np.searchsorted(until, before + room, "right"))
            if b == a and not held:
                b += 1
            held.append(batch.slice(a, b - a))
            room -= until[b - 1] - before if b > a else 0
            a = b
            if a < len(until) or room <= 0:
                yield pa.concat_batches(held)
                held, room = [], most
    if held:
        yield pa.concat_batches(held)


def _kind_of_bytes(raw: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The kind of the character that each byte is of; the last three bytes are ASCII."""
    kind = np.r_[of[:128], np.zeros(128, np.uint8)][raw]
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        b, c, d, e = (raw[lead + k].astype(np.int32) for k in range(4))
        point = np.where(b < 0xE0, (b & 31) << 6 | c & 63, np.where(b < 0xF0, (b & 15) << 12 | (c & 63) << 6 | d & 63, (b & 7) << 18 | (c & 63) << 12 | (d & 63) << 6 | e & 63))
        found = of[point]
        for k, least in ((0, 0), (1, 0), (2, 0xE0), (3, 0xF0)):
            some = b >= least
            kind[lead[some] + k] = found[some]
    return kind


def _spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs begin and end; neither the first nor the last is inside."""
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return change[::2], change[1::2]


def cut(texts: pa.Array, of: np.ndarray) -> pa.ListArray:
    """The tokens of each text; none for null.  of: kinds(), unpacked."""
    few = pieces([pa.RecordBatch.from_arrays([texts], ["text"])], FEW)
    return pa.concat_arrays([_cut(x.column(0), of) for x in few] or [pa.array([], pa.list_(pa.string()))])


def _cut(texts: pa.Array, of: np.ndarray) -> pa.ListArray:
    texts = pc.fill_null(texts, "")
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:  # as Java does
        texts = pa.array([x.decode(errors="replace") for x in texts.cast(pa.binary()).to_pylist()], pa.string())
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    row = 1 + np.cumsum(size + 1) - size - 1
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), " ")
    raw = np.frombuffer(b" " + joined[0].as_buffer().to_pybytes() + b"    ", np.uint8)
    kind = _kind_of_bytes(raw, of)
    start, end = _spans(kind >= LETTER)
    first, last = _spans(kind == DIGIT)

    # a run that begins with digits, until there; with a dollar before it.  Few runs are looked at more closely, and only these are
    number = np.flatnonzero(kind[start] == DIGIT)
    until = start.copy()
    until[number] = last[np.searchsorted(first, start[number])]
    dollar = np.zeros(len(start), bool)
    dollar[number[raw[start[number] - 1] == ord("$")]] = True
    # what joins a run with the next, unless an earlier token took the run, or its digits went with the dollar
    after = raw[end]
    some = np.flatnonzero(after == ord("'"))
    some = some[_LOWER[raw[end[some] + 1]] == ord("s")]
    possessive = np.zeros(len(start), bool)
    possessive[some] = True
    link = possessive.copy()
    link[number[(until[number] == end[number]) & (after[number] == ord(".")) & (kind[end[number] + 1] == DIGIT)]] = True
    active = link.copy()
    some = some[dollar[some]]
    active[some[until[some] == end[some]]] = False
    # digits behind the s of a possessive may begin a decimal
    late = np.flatnonzero(possessive[:-1]) + 1
    late = late[(kind[start[late] + 1] == DIGIT) & (raw[end[late]] == ord(".")) & (kind[end[late] + 1] == DIGIT)]
    link[late[last[np.searchsorted(first, start[late] + 1)] == end[late]]] = True
    for r in (np.flatnonzero(link[1:] & link[:-1]) + 1).tolist():
        if active[r - 1]:
            active[r] = (start[r] + 1 if possessive[r - 1] else until[r]) < end[r]
    by = np.flatnonzero(active)
    head = start.copy()
    head[by + 1] = np.where(possessive[by], start[by + 1] + 1, until[by + 1])

    stop = np.zeros(len(raw), np.int32 if len(raw) < 1 << 31 else np.int64)  # at a token's first byte, its end
    alone = (kind == MARK) & ((raw & 0xC0) != 0x80)
    alone[end[by]] = False
    alone[start[dollar] - 1] = False
    both = by[possessive[by] & dollar[by]]
    stop[start[both] - 1] = until[both]
    one = by[possessive[by]]
    stop[np.where(dollar[one], until[one], head[one])] = end[one] + 2
    one = by[~possessive[by]]
    stop[head[one] - dollar[one]] = until[one + 1]

    rest = np.flatnonzero(~active & (head < end))
    begin, finish = head[rest], end[rest]
    some = np.flatnonzero(kind[begin] == DIGIT)
    digits = last[np.searchsorted(first, begin[some])]
    stop[begin[some] - dollar[rest[some]]] = digits
    begin[some] = digits
    some = begin < finish
    begin, finish = begin[some], finish[some]
    long, after = finish - begin, raw[finish]
    sharp = np.zeros(len(begin), bool)
    some = np.flatnonzero(after == ord("#"))
    sharp[some[(long[some] == 1) & _SHARP[_LOWER[raw[begin[some]]]]]] = True
    dots = np.flatnonzero((after == ord(".")) & (long <= 4))
    code = np.zeros(len(dots), np.int64)
    for k in range(4):
        code += np.where(k < long[dots], _LOWER[raw[np.minimum(begin[dots] + k, len(raw) - 1)]].astype(np.int64) << 8 * k, 0)
    sharp[dots[np.isin(code, _SHORT)]] = True
    alone[finish[sharp]] = False
    stop[begin] = finish + sharp

    at = np.flatnonzero(alone)
    stop[at] = at + _LENGTH[raw[at]]
    at = np.flatnonzero(stop != 0)
    offsets = np.r_[0, np.cumsum(stop[at] - at)].astype(np.int32)
    data = raw[kind != SEPARATOR]
    assert offsets[-1] == len(data)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data))
    return pa.ListArray.from_arrays(pa.array(np.r_[np.searchsorted(at, row), len(at)], pa.int32()), words)

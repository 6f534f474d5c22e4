"""SimHash near-duplicates through Golay-code fuzzy hashing.

A text's fingerprint is the sign of a sum of random +-1 vectors, one for each distinct word: 12 segments of 23 bits.  The
binary Golay code [23, 12, 7] covers the 23-bit words perfectly, so each segment decodes to nearby codewords, named by 12-bit
indices.  Decoding is soft: a bit counts as much as its sum is far from zero, since near copies differ in the bits that were
close calls; the LIST nearest codewords of each segment are kept.  Segments go in 4 groups of 3.  By pigeonhole the errors of
a near copy leave some group with few; a group's key is its three indices, 36 bits, and the PROBES best combinations of the
segments' lists are its keys.  Texts that share a key are compared in full: near copies differ in at most MAX_BITS of all bits.

A text's keys go to their places grouped by prefix, so its fingerprint is sent once for each of some eleven prefixes, not for
each key; prefixes that a sample shows to be heavy are longer.  36-bit keys keep chance meetings rare: at a billion texts about one a text for each group.  Inside a key's texts the search
goes from pivot to unvisited texts until none is left, which finds the same connected groups as comparing all pairs, and
takes one pass over a bucket of close copies however many there are.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.llm.spark_tools import checkpoint, components
from wordloom.llm.text import Words, mix64, slices, utf8

SEGMENTS = 12
GROUP = 3
LIST = 5
PROBES = 16
BITS = SEGMENTS * 23
MAX_BITS = 46
LANES = -(-BITS // 64)

#: prefixes that hold more than HEAVY of all rows of a sample, one text in SAMPLED, or more than PREFIX_ROWS rows, are split by the next index
SAMPLED = 64
HEAVY = 1 / 2048
PREFIX_ROWS = 1 << 18
HEAVY_LEAST = 32
#: texts of which a task remembers that they went out
SEEN_TEXTS = 1 << 20
DEEP = 1 << 60
SECOND = 77

KEY_DDL = "p bigint, t bigint, f binary, r binary"
EDGE_DDL = "a bigint, b bigint"
EDGE_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64())])
STEPS = np.array([k * 0x9E3779B97F4A7C15 % 2**64 for k in range(1, LANES + 1)], np.uint64)


def golay() -> np.ndarray:
    """The 4096 codewords as rows of +-1, by index; index i and 4095 - i of the first half are not related, see HALF."""
    words = []
    for message in range(4096):
        rest = message << 11
        for i in range(22, 10, -1):
            if rest >> i & 1:
                rest ^= 0xC75 << (i - 11)
        words.append(message << 11 | rest)
    bits = (np.array(words)[:, None] >> np.arange(23)) & 1
    return (bits * 2 - 1).astype(np.float32)


CODE = golay()
# The code holds the all-ones word, so codewords come in opposite pairs: scores of one half give those of both.
HALF = np.flatnonzero(CODE[:, 0] > 0)
_names = {tuple(row): i for i, row in enumerate(CODE.astype(int).tolist())}
OPPOSITE = np.array([_names[tuple((-CODE[i]).astype(int).tolist())] for i in HALF])
HALF_T = np.ascontiguousarray(CODE[HALF].T)
COMBOS = np.array(sorted(itertools.product(range(LIST), repeat=GROUP), key=lambda c: (sum(c), c)))
# a combination can be among the PROBES best only if fewer than PROBES others are at least as good in every place
COMBOS = np.array([c for c in COMBOS if sum((o <= c).all() for o in COMBOS) <= PROBES])


def sums(words: Words) -> np.ndarray:
    """BITS sums for each row of words: over its distinct words, +1 or -1 by a hash of the word."""
    n = len(words.first) - 1
    out = np.zeros((n, BITS), np.float32)
    if not len(words.s):
        return out
    seen = np.unique((words.row.astype(np.uint64) << np.uint64(40)) | (words.h >> np.uint64(24)))
    row, word = (seen >> np.uint64(40)).astype(np.int64), seen & np.uint64((1 << 40) - 1)
    cut = np.flatnonzero(np.diff(row, prepend=-1))
    ends = np.append(cut[1:], len(row))
    step = 1 << 13
    i = 0
    while i < len(cut):
        j = max(i + 1, int(np.searchsorted(ends, cut[i] + step, "right")))
        for a in range(cut[i], ends[j - 1], step * 8):  # one very long text comes in parts
            b = min(ends[j - 1], a + step * 8)
            bits = np.unpackbits(mix64(word[a:b, None] + STEPS).view(np.uint8), axis=1, bitorder="little")[:, :BITS]
            at = np.maximum(cut[i:j] - a, 0) if j > i + 1 else np.zeros(1, np.int64)
            out[row[cut[i:j]]] += np.add.reduceat(bits, at, axis=0, dtype=np.int32)
        i = j
    count = np.zeros(n, np.float32)
    count[row[cut]] = ends - cut
    return 2 * out - count[:, None]


def fingerprints(total: np.ndarray) -> np.ndarray:
    packed = np.packbits(total > 0, axis=1, bitorder="little")
    return np.pad(packed, ((0, 0), (0, LANES * 8 - packed.shape[1]))).view(np.uint64)


def keys(total: np.ndarray) -> np.ndarray:
    """PROBES keys for each of the SEGMENTS // GROUP groups, one row a text."""
    n = len(total)
    index, score = np.empty((SEGMENTS, n, LIST), np.int64), np.empty((SEGMENTS, n, LIST), np.float32)
    for s in range(SEGMENTS):
        half = total[:, s * 23 : s * 23 + 23] @ HALF_T
        size = np.abs(half)
        top = np.argpartition(size, size.shape[1] - LIST, axis=1)[:, -LIST:]
        value = np.take_along_axis(size, top, 1)
        order = np.lexsort((top, -value), axis=1)
        top, value = np.take_along_axis(top, order, 1), np.take_along_axis(value, order, 1)
        index[s] = np.where(np.take_along_axis(half, top, 1) >= 0, HALF[top], OPPOSITE[top])
        score[s] = value
    out = []
    for g in range(SEGMENTS // GROUP):
        part = range(g * GROUP, g * GROUP + GROUP)
        worth = sum(score[s][:, COMBOS[:, k]] for k, s in enumerate(part))
        name = sum(index[s][:, COMBOS[:, k]] << (12 * (GROUP - 1 - k)) for k, s in enumerate(part)) + (g << 36)
        best = np.argsort(-worth, axis=1, kind="stable")[:, :PROBES]
        out.append(np.take_along_axis(name, best, 1))
    return np.concatenate(out, axis=1)


def prefixes(total: np.ndarray) -> np.ndarray:
    """Of each text, the (group, first index) pairs of its keys, repeats left in."""
    return keys(total) >> 24


def _prefixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(iter(batches), "text"):
        words = Words(part.column("text"))
        p = np.concatenate([np.unique(x) for x in prefixes(sums(words)[np.diff(words.first) > 0])] or [np.zeros(0, np.int64)])
        p, n = np.unique(p, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(n)], names=["p", "n"])


def _fresh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows without texts that this task has met before, told by t: a copied text is sent once a task, not once a copy."""
    seen: set[int] = set()
    for batch in batches:
        t = batch.column("t").to_pylist()
        new = [x not in seen and not seen.add(x) for x in t]
        if len(seen) > SEEN_TEXTS:
            seen.clear()
        yield batch if all(new) else batch.filter(pa.array(new))


def _keys(batches: Iterable[pa.RecordBatch], heavy: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each prefix of a text's keys, with the keys' other bits: r holds 24 bits a key in four bytes."""
    for part in slices(_fresh(batches), "text"):
        words = Words(part.column("text"))
        some = np.flatnonzero(np.diff(words.first))
        if not len(some):
            continue
        total = sums(words)[some]
        k = np.sort(keys(total), axis=1)
        many = k.shape[1]
        doc, k = np.repeat(np.arange(len(some)), many), k.ravel()
        p = np.where(np.isin(k >> 24, heavy), DEEP | (k >> 12), k >> 24)
        first = np.flatnonzero((np.diff(p, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
        off = (np.append(first, len(k)) * 4).astype(np.int32)
        r = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(off), pa.py_buffer((k & 0xFFFFFF).astype(np.uint32))])
        prints = np.ascontiguousarray(fingerprints(total)[doc[first]])
        f = pa.FixedSizeBinaryArray.from_buffers(pa.binary(LANES * 8), len(prints), [None, pa.py_buffer(prints)])
        yield pa.RecordBatch.from_arrays([pa.array(p[first]), pa.array(np.asarray(part.column("t"))[some][doc[first]]), f.cast(pa.binary()), r], names=["p", "t", "f", "r"])


def _bits(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[2], np.uint64)[column.offset * LANES : (column.offset + len(column)) * LANES].reshape(-1, LANES)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1)


def _linked(text: np.ndarray, bits: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges that span the groups of one bucket: breadth first from each text to those not yet visited."""
    left = np.arange(len(text))
    while len(left) > 1:
        front, left = [int(left[0])], left[1:]
        root = text[front[0]]
        while front and len(left):
            near = _distance(bits[left], bits[front.pop()]) <= MAX_BITS
            for i in left[near]:
                yield int(text[i]), int(root)
            front += left[near].tolist()
            left = left[~near]


def _meet(k: np.ndarray, t: np.ndarray, f: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Edges among texts that share a key; row[i] is the row of t and f that has key k[i]."""
    order = np.lexsort((t[row], k))
    k, row = k[order], row[order]
    text = t[row]
    fresh = np.ones(len(k), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (text[1:] != text[:-1])
    k, text, row = k[fresh], text[fresh], row[fresh]
    starts = np.flatnonzero(np.diff(k, prepend=k[0] - 1))
    size = np.diff(np.append(starts, len(k)))
    head = np.repeat(starts, size)
    rest = np.flatnonzero(np.arange(len(k)) != head)
    near = _distance(f[row[rest]], f[row[head[rest]]]) <= MAX_BITS
    a, b = [text[rest[near]]], [text[head[rest[near]]]]
    for s in np.unique(head[rest[~near]]):
        n = size[np.searchsorted(starts, s)]
        if n > 2:
            more = list(_linked(text[s : s + n], f[row[s : s + n]]))
            a.append(np.array([x for x, _ in more], np.int64))
            b.append(np.array([x for _, x in more], np.int64))
    return np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)


def _edges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by prefix; those of one prefix are held together."""
    held: list[pa.RecordBatch] = []

    def work() -> pa.RecordBatch:
        p, t = (np.concatenate([np.asarray(x.column(c)) for x in held]) for c in "pt")
        f = np.concatenate([_bits(x.column("f")) for x in held])
        raw, off = zip(*[utf8(x.column("r")) for x in held], strict=True)
        row = np.repeat(np.arange(len(p)), np.concatenate([np.diff(x) for x in off]) // 4)
        rest = np.concatenate(raw).view(np.uint32).astype(np.int64)
        p = p[row]
        pair = _meet(np.where(p >= DEEP, (p - DEEP) >> 12, p) << 24 | rest, t, f, row)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], schema=EDGE_SCHEMA)

    for batch in batches:
        if not batch.num_rows:
            continue
        p = np.asarray(batch.column("p"))
        last = int(np.searchsorted(p, p[-1], "left"))
        if held and (last or held[-1].column("p")[0].as_py() != p[-1]):
            if last:
                held.append(batch.slice(0, last))
            yield work()
            held = [batch.slice(last)]
        elif last:
            held.append(batch.slice(0, last))
            yield work()
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield work()


def _pairs(words: Words) -> Words:
    """words with each word's hash replaced by one of it and the next: texts that only have their words in common differ."""
    after = np.append(words.h[1:], np.zeros(min(1, len(words.h)), np.uint64))
    after[words.first[1:][np.diff(words.first) > 0] - 1] = 0
    words._h = mix64(words.h * np.uint64(3) + after)
    return words


def distinct_texts(texts: list[str]) -> np.ndarray:
    """Of a small list of texts, the places of those that are no near copy of an earlier one, by their word pairs: all are compared with all."""
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    parts = [_pairs(Words(part.column("text"))) for part in slices(iter([batch]), "text")]
    bits = np.concatenate([fingerprints(sums(w)) for w in parts] or [np.zeros((0, LANES), np.uint64)])
    some = np.concatenate([np.diff(w.first) > 0 for w in parts] or [np.zeros(0, bool)])
    keep = np.ones(len(texts), bool)
    for a in range(0, len(texts), 64):
        near = _distance(bits[a : a + 64, None], bits[None, : a + 64]) <= MAX_BITS
        earlier = np.arange(near.shape[1])[None, :] < np.arange(a, min(a + 64, len(texts)))[:, None]
        keep[a : a + 64] = ~(near & earlier & some[None, : a + 64]).any(axis=1) | ~some[a : a + 64]
    return np.flatnonzero(keep)


def text_hash(text: Column) -> Column:
    """What names a text among the fingerprints."""
    return F.xxhash64(text)


def _names(docs: DataFrame) -> list[Column]:
    """t, and u, a second hash: texts are equal if both are."""
    return [text_hash(docs["text"]).alias("t"), F.xxhash64(F.lit(SECOND), docs["text"]).alias("u")]


def clashes(docs: DataFrame) -> DataFrame:
    """The t that several texts share: some 70 among 5 * 10**10 texts.  Their fingerprints link nothing."""
    both = docs.where(docs["text"].isNotNull()).select(*_names(docs)).groupBy("t").agg(F.min("u").alias("lo"), F.max("u").alias("hi"))
    return checkpoint(both.where("lo != hi").select("t"))


def text_groups(docs: DataFrame, clash: DataFrame) -> DataFrame:
    """(t, g) for each text that is near another one: t hashes the text, g names its group."""
    texts = docs.select(text_hash(docs["text"]).alias("t"), docs["text"].alias("text")).where("text is not null")
    some = texts.where(F.pmod("t", F.lit(SAMPLED)) == 0).mapInArrow(_prefixes, "p bigint, n bigint").groupBy("p").agg(F.sum("n").alias("n"))
    counts = {r.p: r.n for r in some.where(F.col("n") > HEAVY_LEAST).union(some.agg(F.lit(-1).cast("bigint").alias("p"), F.sum("n").alias("n"))).collect()}  # as many as there are prefixes, at most
    heavy = np.array(sorted(p for p, n in counts.items() if p >= 0 and n > min((counts[-1] or 0) * HEAVY, PREFIX_ROWS / SAMPLED)), np.int64)
    found = texts.mapInArrow(lambda it: _keys(it, heavy), KEY_DDL)
    edges = found.repartition("p").sortWithinPartitions("p").mapInArrow(_edges, EDGE_DDL)
    for end in "ab":
        edges = edges.join(clash.withColumnRenamed("t", end), end, "left_anti")
    return components(edges.select("a", "b")).select(F.col("node").alias("t"), F.col("label").alias("g"))


def members(docs: DataFrame) -> DataFrame:
    """(t, u, doc_id, g, n, kept_id, kept_t, kept_u) for each row of a group of two rows or more, exact copies included.  Copies are counted before they move."""
    clash = clashes(docs)
    rows = docs.where(docs["text"].isNotNull() & docs["text"].rlike(r"[\p{L}\p{N}]")).select(docs["doc_id"].alias("doc_id"), *_names(docs))
    texts = rows.groupBy("t", "u").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("d"))).alias("first"))
    named = texts.join(text_groups(docs, clash), "t", "left").join(clash.withColumn("alone", F.lit(True)), "t", "left")
    named = named.select("t", "u", "n", "first", F.struct(F.coalesce("g", "t").alias("g"), F.when(F.col("alone"), F.col("u")).alias("u")).alias("g"))
    groups = named.groupBy("g").agg(F.sum("n").alias("n"), F.min(F.struct("first", "t", "u")).alias("f")).where("n > 1")
    groups = groups.select("g", "n", F.col("f.first.d").alias("kept_id"), F.col("f.t").alias("kept_t"), F.col("f.u").alias("kept_u"))
    return rows.join(named.select("t", "u", "g").join(groups, "g"), ["t", "u"])


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) with one document left of each group of near copies: the one with the least doc_id, null last; of
    those with the same doc_id, the one of least hash.

    Groups are connected: two texts are near if their fingerprints differ in at most MAX_BITS bits and they share a key;
    texts equal in all are near.  Whole texts count, however long.  Of repeated rows, equal in doc_id and text, one stays.  Null texts, and texts without a
    letter or digit, have no fingerprint: they are in no group and all stay.  Texts whose first hash is that of another text, though the second
    differs, are near nothing but their exact copies.  An empty table stays empty.  All columns are kept as they are.
    """
    groups = checkpoint(members(docs).select("t", "u", "kept_id", "kept_t", "kept_u").distinct())
    t, u = _names(docs)
    tagged = docs.withColumns({"_wl_t": t, "_wl_u": u})
    found = tagged.join(groups.select(F.col("t").alias("_wl_t"), F.col("u").alias("_wl_u"), F.col("kept_id").alias("_wl_k"), F.col("kept_t").alias("_wl_kt"), F.col("kept_u").alias("_wl_ku"), F.lit(1).alias("_wl_in")), ["_wl_t", "_wl_u"], "left")
    number = F.row_number().over(Window.partitionBy("_wl_t", "_wl_u", "doc_id").orderBy(F.lit(1)))
    stays = F.col("_wl_in").isNull() | (F.col("doc_id").eqNullSafe(F.col("_wl_k")) & (F.col("_wl_t") == F.col("_wl_kt")) & (F.col("_wl_u") == F.col("_wl_ku")) & (F.col("_wl_n") == 1))
    return found.withColumn("_wl_n", number).where(stays).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, kept_doc_id, group_size): every document that drop_near_copies() drops, beside the one that stays for it.

    Nulls, empty and long texts, ties, empty tables and other columns count as there; rows equal to the one that stays, in doc_id too, have no row here.
    """
    rows = members(docs)
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("t") == F.col("kept_t")) & (F.col("u") == F.col("kept_u"))
    return rows.where(~same).select("doc_id", F.col("kept_id").alias("kept_doc_id"), F.col("n").alias("group_size"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All near copies among the documents; nulls, empty and long texts, ties, repeats, empty tables and other columns as near_copies() says."""
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))

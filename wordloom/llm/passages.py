"""Repeated passages by prefix-free parsing and suffix arrays.

A passage of LENGTH words that stands at several places of the corpus is kept at the first place, in order of doc_id, and cut
from the others.  All windows of LENGTH words are compared, word by word, a word being a 64-bit hash, as follows.

Parse.  A place whose next WINDOW words have a rolling hash divisible by MODULUS is a trigger; triggers cut each document
into phrases that overlap in a trigger, so no phrase suffix longer than a trigger is a prefix of another.  A window belongs
to its first trigger, equal windows to equal triggers, and a trigger's windows lie in its context: from the trigger before
to LENGTH words after.  So one short row for each trigger, not for each word, meets its equals: triggers seen once drop out,
and of equal contexts all but the first are repeats at once, which is where highly repetitive text shrinks.  The few
windows that hold no trigger are rows of their own, keyed by all their words.

Suffix arrays.  Contexts that share a trigger but differ are fetched and parsed again in each shuffle partition: the suffix
array of the distinct phrases and that of the parse, which sees a phrase as one letter, combine into the order of all windows;
neighbours that agree in LENGTH words are repeats.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.llm.text import Words, char_index, mix64, prefix, slices, span, utf8

LENGTH = 50
WINDOW = 8
MODULUS = 12
CHUNK_WORDS = 1 << 18
#: bits of a place that hold how many windows a context has
GAP = 16

ANCHOR_DDL = "k bigint, c bigint, d bigint, t bigint, p bigint"
SORTED_DDL = "d bigint, t bigint, p bigint, k bigint, src bigint"
CONTEXT_DDL = "k bigint, d bigint, t bigint, p bigint, w binary"
SPAN_DDL = "d bigint, t bigint, a int, b int, src bigint"
SPAN_SCHEMA = pa.schema([("d", pa.int64()), ("t", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("src", pa.int64())])


def triggers(hashes: np.ndarray, first: np.ndarray, sums: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of triggers, and the triggers' hashes; first has the word offsets of the documents."""
    if len(hashes) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = prefix(hashes) if sums is None else sums
    at = np.arange(len(hashes) - WINDOW + 1)
    h = span(sums, at, at + WINDOW)
    end = np.repeat(first[1:], np.diff(first))[: len(at)]
    hit = np.flatnonzero((h % np.uint64(MODULUS) == 0) & (at + WINDOW <= end))
    return hit, h[hit]


def anchors(words: Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, context hash, first window, last window) of each trigger with windows and of each window without trigger; windows counted from the document's start."""
    h, first = words.h, words.first
    sums = prefix(h)
    hit, key = triggers(h, first, sums)
    row = words.row
    r = row[hit]
    before = np.concatenate([[-1], hit[:-1]]) if len(hit) else hit
    lo = np.maximum(np.maximum(before + 1, first[r]), hit + WINDOW - length)
    hi = np.minimum(hit, first[r + 1] - length)
    ok = lo <= hi
    r, key, lo, hi = r[ok], key[ok], lo[ok], hi[ok]
    covered = np.zeros(len(h) + 1, np.int32)
    np.add.at(covered, lo, 1)
    np.add.at(covered, hi + 1, -1)
    at = np.flatnonzero((np.cumsum(covered[:-1]) == 0) & (np.arange(len(h)) + length <= first[row + 1])) if len(h) else np.zeros(0, np.int64)
    free = mix64(span(sums, at, at + length) + np.uint64(1))
    context = np.concatenate([span(sums, lo, hi + length), free])
    r = np.concatenate([r, row[at]])
    return r, np.concatenate([key, free]), context, np.concatenate([lo, at]) - first[r], np.concatenate([hi, at]) - first[r]


def _anchors(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for part in slices(iter(batches), "text"):
        r, k, c, lo, hi = anchors(Words(part.column("text")), length)
        if len(r):
            d, t = np.asarray(part.column("d")), np.asarray(part.column("t"))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k.view(np.int64), c.view(np.int64), d[r], t[r], (lo << GAP) + hi - lo)], names=["k", "c", "d", "t", "p"])


def _meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, context and place: repeats of a context (k null, src the document of the first), and the first of each context whose key has several (src null).  Holds one batch and one row."""
    last = None  # k, c, d, t, p of the last row; document of its context's first row; first row of its key, None once it is given
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        k, c, d, t, p = (np.asarray(batch.column(x)) for x in "kcdtp")
        before = [np.concatenate([[last[i] if last else 0], x[:-1]]) for i, x in enumerate((k, c, d, t, p))]
        new_key = k != before[0]
        new = new_key | (c != before[1])
        if last is None:
            new_key[0] = new[0] = True
        again = ~new & (d == before[2]) & (t == before[3]) & (p == before[4])
        repeat = np.flatnonzero(~new & ~again)
        at = np.arange(n)
        first = np.maximum.accumulate(np.where(new, at, -1))
        head = np.maximum.accumulate(np.where(new_key, at, -1))
        source = np.where(first >= 0, d[first], last[5] if last else 0)
        several = np.flatnonzero(new & ~new_key)
        heads = np.unique(head[several])
        give = np.concatenate([several, heads[heads >= 0]])
        rows = [(d[repeat], t[repeat], p[repeat], None, source[repeat]), (d[give], t[give], p[give], k[give], None)]
        pending = last[6] if last else None
        if len(heads) and heads[0] < 0:
            if pending is not None:
                rows.append((*(np.array([x]) for x in pending), None))
            pending = None
        if head[-1] >= 0:
            pending = None if head[-1] in heads else (d[head[-1]], t[head[-1]], p[head[-1]], k[head[-1]])
        last = (k[-1], c[-1], d[-1], t[-1], p[-1], source[-1], pending)
        for x in rows:
            m = len(x[0])
            if m:
                yield pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1]), pa.array(x[2]), pa.nulls(m, pa.int64()) if x[3] is None else pa.array(x[3]), pa.nulls(m, pa.int64()) if x[4] is None else pa.array(x[4])], names=["d", "t", "p", "k", "src"])


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... size[0] of them, then start[1] ..."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def _contexts(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for part in slices(iter(batches), "text"):
        words = Words(part.column("text"))
        wanted = part.column("_wl_wanted")
        many = np.diff(np.asarray(wanted.offsets))
        flat = wanted.flatten()
        k, p = np.asarray(flat.field("k")), np.asarray(flat.field("p"))
        r = np.repeat(np.arange(part.num_rows), many)
        size = p % (1 << GAP) + length
        hashes = words.h[_ranges(words.first[r] + (p >> GAP), size)]
        off = np.zeros(len(size) + 1, np.int32)
        np.cumsum(size * 8, out=off[1:])
        w = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(off), pa.py_buffer(hashes)])
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.asarray(part.column("_wl_d"))[r]), pa.array(np.asarray(part.column("_wl_t"))[r]), pa.array(p), w], names=["k", "d", "t", "p", "w"])


def suffix_ranks(letters: np.ndarray, first: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix among the suffixes of all strings, by its first depth letters at least: prefix doubling.

    letters are any numbers; first has the strings' offsets.  A string's end sorts before every letter; equal suffixes have equal rank.
    """
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(letters))
    rank = np.unique(letters, return_inverse=True)[1].astype(np.int64) + 1
    k = 1
    while k < depth and len(rank):
        nxt = np.zeros_like(rank)
        some = np.flatnonzero(left > k)
        nxt[some] = rank[some + k]
        rank = np.unique(rank * (len(rank) + 1) + nxt, return_inverse=True)[1].astype(np.int64) + 1
        k *= 2
    return rank


def corpus_order(letters: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """All windows of length letters in suffix order, as places in letters: suffix arrays of dictionary and parse, combined."""
    n = len(letters)
    hit, _ = triggers(mix64(letters.astype(np.uint64)), first)
    # phrases: from each trigger, or the string's start, to the end of the next trigger, or of the string
    begin = np.union1d(first[:-1][np.diff(first) > 0], hit)
    string = np.searchsorted(first, begin, "right") - 1
    follow = np.append(begin[1:], n)
    end = np.where(follow < first[string + 1], follow + WINDOW, first[string + 1])
    sums = prefix(letters.astype(np.uint64))
    name = span(sums, begin, end)
    _, example, phrase = np.unique(name, return_index=True, return_inverse=True)
    size = (end - begin)[example]
    dictionary = letters[_ranges(begin[example], size)]
    d_first = np.concatenate([[0], np.cumsum(size)])
    suffix = suffix_ranks(dictionary, d_first, int(size.max(initial=1)))
    order = suffix[d_first[:-1]]  # phrases in the order of their letters
    p_first = np.searchsorted(begin, first)
    parse = suffix_ranks(order[phrase], p_first, length)
    # a place's suffix is its phrase's suffix, then the parse from the next phrase on
    place = np.arange(n)
    mine = np.searchsorted(begin, place, "right") - 1
    inner = suffix[d_first[phrase[mine]] + place - begin[mine]]
    more = mine + 1 < np.repeat(p_first[1:], np.diff(first))
    after = np.zeros(n, np.int64)
    after[more] = parse[mine[more] + 1]
    window = np.flatnonzero(place + length <= np.repeat(first[1:], np.diff(first)))
    return window[np.lexsort((after[window], inner[window]))]


def repeats(letters: np.ndarray, first: np.ndarray, rank: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows whose letters stand in a string of less rank too, and for each the string of least rank that has them."""
    at = corpus_order(letters, first, length)
    if not len(at):
        return at, at
    same = np.ones(len(at) - 1, bool)
    left = np.arange(len(at) - 1)
    for i in range(length):  # the common prefix of neighbours, as far as it matters
        left = left[letters[at[left] + i] == letters[at[left + 1] + i]]
    same[:] = False
    same[left] = True
    group = np.concatenate([[0], np.cumsum(~same)])
    string = np.searchsorted(first, at, "right") - 1
    best = np.lexsort((rank[string], group))
    lead = best[np.flatnonzero(np.diff(group[best], prepend=-1))]
    source = string[lead][group]
    later = rank[string] > rank[source]
    return at[later], source[later]


def _suffixes(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = 0

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        k, d, t, p = (np.asarray(batch.column(x)) for x in "kdtp")
        raw, off = utf8(batch.column("w"))
        letters = raw.view(np.int64)
        first = off // 8
        o = np.lexsort((p, t, d))
        rank = np.empty(len(k), np.int64)  # rows that are equal in all are one place
        rank[o] = np.cumsum((np.diff(d[o], prepend=0) != 0) | (np.diff(t[o], prepend=0) != 0) | (np.diff(p[o], prepend=0) != 0))
        at, source = repeats(letters, first, rank, length)
        if not len(at):
            return
        o = np.argsort(at)
        at, source = at[o], source[o]
        string = np.searchsorted(first, at, "right") - 1
        head = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(string) != 0) | (np.diff(d[source]) != 0)]))
        tail = np.append(head[1:], len(at)) - 1
        s = string[head]
        a = (p[s] >> GAP) + at[head] - first[s]
        yield pa.RecordBatch.from_arrays([pa.array(d[s]), pa.array(t[s]), pa.array(a.astype(np.int32)), pa.array((a + at[tail] - at[head] + length).astype(np.int32)), pa.array(d[source[head]])], schema=SPAN_SCHEMA)

    for batch in batches:
        while batch.num_rows:
            k = np.asarray(batch.column("k"))
            cut = batch.num_rows
            if size >= CHUNK_WORDS * 8:  # enough: up to the end of the key
                tail = held[-1].column("k")[-1].as_py()
                cut = int(np.argmax(k != tail)) if (k != tail).any() else batch.num_rows
                if cut < batch.num_rows:
                    if cut:
                        held.append(batch.slice(0, cut))
                    yield from work(_whole(held))
                    held, size, batch = [], 0, batch.slice(cut)
                    continue
            held.append(batch)
            size += batch.column("w").nbytes
            break
    if held:
        yield from work(_whole(held))


def _whole(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(held)
    table = table.set_column(4, "w", table.column("w").cast(pa.large_binary()))  # a key's contexts may pass 2 GB
    return pa.RecordBatch.from_arrays([x.combine_chunks() for x in table.columns], names=table.column_names)


def _identity(docs: DataFrame) -> list[Column]:
    """d, doc_id with null as the greatest, and t, a hash of the text: what tells rows apart."""
    return [F.coalesce(docs["doc_id"].cast("bigint"), F.lit((1 << 63) - 1)).alias("d"), F.xxhash64(docs["text"]).alias("t")]


def _moved(docs: DataFrame) -> DataFrame:
    """docs with _wl_d and _wl_t, shuffled by them.  Contexts are fetched from it and the cuts are made on it: both readers take all of
    its columns, so that Spark shuffles the texts once."""
    d, t = _identity(docs)
    return docs.withColumns({"_wl_d": d, "_wl_t": t}).repartition("_wl_d", "_wl_t")


def spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(d, t, a, b, src): words a to b of the text repeat what stands in document src, or earlier in the same one.  May overlap."""
    if not WINDOW <= length < 1 << GAP:
        raise ValueError(f"length must be at least {WINDOW} and less than {1 << GAP}")
    texts = docs.select(*_identity(docs), docs["text"].alias("text"))
    rows = texts.where("text is not null").mapInArrow(lambda it: _anchors(it, length), ANCHOR_DDL)
    met = rows.repartition("k").sortWithinPartitions("k", "c", "d", "t", "p").mapInArrow(_meet, SORTED_DDL)
    wanted = met.where("k is not null").groupBy("d", "t").agg(F.collect_list(F.struct("k", "p")).alias("wanted"))
    moved = _moved(docs)
    contexts = moved.join(wanted.select(F.col("d").alias("_wl_d"), F.col("t").alias("_wl_t"), F.col("wanted").alias("_wl_wanted")), ["_wl_d", "_wl_t"]).mapInArrow(lambda it: _contexts(it, length), CONTEXT_DDL)
    finer = contexts.repartition("k").sortWithinPartitions("k").mapInArrow(lambda it: _suffixes(it, length), SPAN_DDL)
    first = F.shiftright("p", GAP)
    whole = met.where("k is null").select("d", "t", first.cast("int").alias("a"), (first + F.col("p") % (1 << GAP) + length).cast("int").alias("b"), "src")
    return whole.union(finer)


def _union(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts, ends, strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


CUT = "struct<text:string,n_words:int,n_repeated:int,spans:array<struct<start:int,end:int>>>"
CUT_TYPE = pa.struct([("text", pa.string()), ("n_words", pa.int32()), ("n_repeated", pa.int32()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def _cut(text: pa.Array, found: pa.Array, again: pa.Array) -> pa.Array:
    """The text without the words of the spans found, or without any if it is a row met before; spans in characters of the text."""
    out = []
    at = 0
    for part in slices(iter([pa.RecordBatch.from_arrays([text], names=["text"])]), "text"):
        words = Words(part.column("text"))
        raw = words.raw.tobytes()
        for i in range(part.num_rows):
            known, seen = found[at], again[at].as_py()
            at += 1
            if not known.is_valid and not seen:
                out.append(None)
                continue
            lo, hi, base = int(words.off[i]), int(words.off[i + 1]), int(words.first[i])
            n = int(words.first[i + 1]) - base
            ranges = [(0, n)] if seen else _union(known.values.field("a").to_pylist(), known.values.field("b").to_pylist())
            keep, chars, done = [], [], lo
            index = char_index(words.raw[lo:hi])
            for a, b in ranges:
                start, end = int(words.s[base + a]), int(words.s[base + b]) if b < n else hi
                keep.append(raw[done:start])
                chars.append({"start": int(index[start - lo]), "end": int(index[end - lo])})
                done = end
            keep.append(raw[done:hi])
            out.append({"text": b"".join(keep).decode(), "n_words": n, "n_repeated": sum(b - a for a, b in ranges), "spans": chars})
    return pa.array(out, CUT_TYPE)


def _tagged(docs: DataFrame, length: int) -> DataFrame:
    """docs with _wl_cut, what _cut() makes of rows with repeats, else null, and _wl_src, the documents that have the first copies."""
    found = spans(docs, length).groupBy("d", "t").agg(F.collect_list(F.struct("a", "b")).alias("_wl_f"), F.sort_array(F.collect_set("src")).alias("_wl_src"))
    joined = _moved(docs).join(found.select(F.col("d").alias("_wl_d"), F.col("t").alias("_wl_t"), "_wl_f", "_wl_src"), ["_wl_d", "_wl_t"], "left")
    number = F.row_number().over(Window.partitionBy("_wl_d", "_wl_t").orderBy(F.lit(1)))
    joined = joined.withColumn("_wl_n", number > 1)
    cut = F.arrow_udf(_cut, CUT)
    hit = F.col("_wl_n") | F.col("_wl_f").isNotNull()
    return joined.withColumn("_wl_cut", F.when(hit, cut(F.when(hit, F.col("text")), F.col("_wl_f"), F.col("_wl_n") & F.col("text").isNotNull())))


def drop_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs(doc_id, text, ...) with every passage of length words or more left at its first place in order of doc_id, then text, then position.

    Words are compared as text.py folds them.  A passage goes from its first word to the word that follows it, or to the
    text's end.  Documents of which no word is left go; rows equal in doc_id and text to another row go whatever their
    length.  Null, empty and short texts are otherwise left alone; a null doc_id counts as the greatest.  Equal passages
    inside one document count too.  Whole texts count, however long.  An empty table stays empty.  All columns are kept, text is the only one changed; their
    types must be such as Arrow takes.
    """
    rows = _tagged(docs, length)
    left = (F.col("_wl_cut.n_repeated") < F.col("_wl_cut.n_words")) & ~F.col("_wl_n")
    return rows.where(F.col("_wl_cut").isNull() & ~F.col("_wl_n") | left).select(*[F.coalesce("_wl_cut.text", "text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def repeated_passages(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Documents with repeated passages: doc_id, first_doc_ids (where the copies that stay are), n_words, n_repeated, spans (in characters) and the text without them.

    Nulls, empty, short and very long texts, ties, rows alike in doc_id and text and empty tables count as in drop_repeats(): a row that is
    there already is one repeat as a whole, whatever its length.  Other columns are ignored, whatever their names.
    """
    rows = _tagged(docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")), length).where("_wl_cut is not null")
    sources = F.when(F.col("_wl_n"), F.array("doc_id")).otherwise(F.transform("_wl_src", lambda x: F.nullif(x, F.lit((1 << 63) - 1))))
    return rows.select("doc_id", sources.alias("first_doc_ids"), "_wl_cut.n_words", "_wl_cut.n_repeated", "_wl_cut.spans", F.col("_wl_cut.text").alias("text"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold repeated passages; nulls, empty and long texts, ties, repeats, empty tables and other columns as repeated_passages() says."""
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from wordloom.llm import simhash
from wordloom.llm.spark_tools import components
from wordloom.llm.text import Words

SCHEMA = "doc_id bigint, text string, t string, lang string"


def edited(rng, words, share):
    return [rng.choice(words) + "x" if rng.random() < share else w for w in words]


def corpus(seed=1, groups=25):
    rng = random.Random(seed)
    texts = []
    for _ in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(30, 400))]
        texts += [" ".join(base)] + [" ".join(edited(rng, base, rng.choice((0, 0.02, 0.05, 0.08)))) for _ in range(rng.randrange(0, 8))]
    texts += [" ".join(f"w{rng.randrange(5000)}" for _ in range(200)) for _ in range(100)]
    rng.shuffle(texts)
    return [(i, t, "clash", "en") for i, t in enumerate(texts)]


def brute(rows):
    """Pairs of texts within MAX_BITS, comparing all with all."""
    texts = sorted({r[1] for r in rows if r[1]})
    bits = simhash.fingerprints(simhash.sums(Words(pa.array(texts))))
    return texts, [(i, j) for i in range(len(texts)) for j in range(i) if np.bitwise_count(bits[i] ^ bits[j]).sum() <= simhash.MAX_BITS]


def test_golay_code():
    weights = np.unique((simhash.CODE > 0).sum(1), return_counts=True)
    assert dict(zip(*[x.tolist() for x in weights], strict=True)) == {0: 1, 7: 253, 8: 506, 11: 1288, 12: 1288, 15: 506, 16: 253, 23: 1}
    assert (simhash.CODE[simhash.OPPOSITE] == -simhash.CODE[simhash.HALF]).all()


def test_recall_and_groups_against_all_pairs(spark):
    rows = corpus()
    texts, pairs = brute(rows)
    keys = [set(x) for x in simhash.keys(simhash.sums(Words(pa.array(texts)))).tolist()]
    assert len(pairs) > 100
    assert sum(bool(keys[i] & keys[j]) for i, j in pairs) >= 0.9 * len(pairs)
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in pairs:
        parent[find(i)] = find(j)
    number = {t: k for k, t in enumerate(texts)}
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(find(number[text]), []).append(doc_id)
    want = {d for g in groups.values() for d in sorted(g)[1:]}
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.kept_doc_id for r in simhash.near_copies(df).collect()}
    assert len(set(got) ^ want) <= 0.05 * len(want)
    assert not set(got) - want  # clean documents are left alone
    out = simhash.drop_near_copies(df)
    assert out.columns == df.columns
    assert {r.doc_id for r in out.collect()} == {r[0] for r in rows} - set(got)


def test_linked_finds_the_groups_of_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = 24
        base = rng.integers(0, 2**63, (4, simhash.LANES)).astype(np.uint64)
        bits = base[rng.integers(0, 4, n)].copy()
        for row in bits:  # walks away from the base, so groups are chains
            for b in rng.integers(0, 276, rng.integers(0, 60)):
                row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        a, b = np.arange(n), np.arange(n)
        for i in range(n):
            for j in range(i):
                if np.bitwise_count(bits[i] ^ bits[j]).sum() <= simhash.MAX_BITS:
                    a[a == a[i]] = a[j]
        for x, y in simhash._linked(np.arange(n), bits):
            b[b == b[x]] = b[y]
        assert len({(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)}) == len(set(a.tolist())) == len(set(b.tolist()))


def test_awkward_rows(spark):
    rows = [(1, None, "a", "en"), (2, "", "a", "en"), (3, "", None, "en"), (4, " .. ", None, None), (None, "one two three", "b", "en"), (7, "One, two three!", "c", "en"), (7, "One, two three!", "c", "en"), (8, "word " * 50_000, None, "en"), (None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = simhash.drop_near_copies(df).collect()
    assert sorted(out, key=str) == sorted([r for i, r in enumerate(rows) if i not in (4, 6)], key=str)
    assert sorted(map(tuple, simhash.near_copies(df).collect()), key=str) == [(None, 7, 3)]
    assert simhash.drop_near_copies(df.limit(0)).collect() == [] and simhash.near_copies(df.limit(0)).collect() == []


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (5, 5), (101, 100)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_split_prefixes_find_the_same(spark, monkeypatch):
    """All prefixes heavy, or none: the same copies."""
    df = spark.createDataFrame(corpus(4), SCHEMA)
    light = sorted(map(tuple, simhash.near_copies(df).collect()))
    for name, value in (("HEAVY", 0), ("PREFIX_ROWS", 0), ("HEAVY_LEAST", 0), ("SAMPLED", 1)):
        monkeypatch.setattr(simhash, name, value)
    assert sorted(map(tuple, simhash.near_copies(df).collect())) == light and len(light) > 20


def test_texts_that_share_a_hash_are_no_copies(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(simhash, "text_hash", lambda c: F.pmod(F.length(c), F.lit(3)).cast("bigint"))
    rows = [(1, "one two three", "a", "en"), (2, "four five six seven", "a", "en"), (3, "eight nine ten", "a", "en"), (4, "one two three", "a", "en"), (5, "one two three four", "a", "en"), (6, "a b", "a", "en")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, simhash.near_copies(df).collect())) == [(4, 1, 2)]
    assert sorted(r.doc_id for r in simhash.drop_near_copies(df).collect()) == [1, 2, 3, 5, 6]

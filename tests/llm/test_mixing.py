from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from wordloom.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, shard string"


def rows():
    out = [(i, f"text {i}", "big" if i % 3 else "mid" if i % 2 else "small", "old") for i in range(3000)]
    return out + [(None, "no id", None, "old"), (1, None, None, None), (2, "", "", "old"), (7, "twice", "mid", "a"), (7, "twice", "mid", "a")]


def test_quotas_are_exact_and_shards_even(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    weights = {"big": 0.5, "mid": 0.25, "small": 0.25}
    out = mixing.mix(df, weights, block_rows=8, shards=5).collect()
    counts = Counter(r[2] for r in rows())
    quota = mixing.block_quotas(counts, weights, 8)
    got = Counter(r.source for r in out)
    for s in counts:
        assert quota[s] * 8 - 8 < got[s] <= quota[s] * 8 or got[s] == quota[s] == 0
    total = sum(quota.values())
    assert max(abs(quota[s] - w * total) for s, w in weights.items()) <= 1
    plan = mixing.Plan(dict(counts), weights, 8, 5, mixing.SEED)
    blocks = plan.tree.sum(axis=1)
    assert blocks.max() - blocks.min() <= 1
    assert len({(r.shard, r.position) for r in out}) == len(out)
    assert Counter(r.doc_id for r in out).most_common(1)[0][1] <= 2


def test_same_mix_for_any_partitioning(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    a = sorted(map(str, mixing.mix(df).collect()))
    b = sorted(map(str, mixing.mix(df.repartition(7, "text")).collect()))
    assert a == b


def test_against_one_draw_after_the_other():
    """The tree's leaves against direct multivariate draws: equal means, hypergeometric variance."""
    quota = np.array([40, 15, 5])
    leaves = np.array([mixing.splitting_tree(quota, 4, seed) for seed in range(3000)])
    assert (leaves.sum(axis=1) == quota).all()
    assert (leaves.sum(axis=2) == 15).all()
    assert np.abs(leaves.mean(axis=0) - quota / 4).max() < 0.1
    share = quota / 60
    variance = 15 * share * (1 - share) * 45 / 59
    assert np.abs(leaves.var(axis=0) / variance - 1).max() < 0.15


@pytest.mark.parametrize("size", [1, 2, 3, 10, 64, 1000])
def test_permutation(size):
    for key in (0, 5, 2**63):
        got = mixing.permute(np.arange(size), np.full(size, size), np.full(size, key, np.uint64))
        assert sorted(got.tolist()) == list(range(size))


def test_awkward_tables(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    assert mixing.mix(df.limit(0)).collect() == []
    assert mixing.mix(df.limit(0)).columns == ["doc_id", "text", "source", "shard", "position"]
    nulls = spark.createDataFrame([(None, None, None, None)] * 5, SCHEMA)
    assert len(mixing.mix(nulls, names=("s", "p")).collect()) == 5
    assert mixing.mix(df, {"nobody": 1.0}).collect() == []
    long = spark.createDataFrame([(i, "x" * 10**6, "a", None) for i in range(3)], SCHEMA)
    assert len(mixing.mix(long).collect()) == 3


@pytest.mark.parametrize("tiny", [{}, {None: 1}, {"typo": 16}, {f"t{i}": 1 for i in range(3000)}])
@pytest.mark.parametrize("scale", [1, 100])
def test_a_tiny_source_does_not_set_the_total(tiny, scale):
    large = {"hot": 50_000 * scale} | {f"s{i}": 2600 * scale for i in range(19)}
    counts = large | tiny
    quota = mixing.block_quotas(counts, mixing.target_weights(counts), 16)
    alone = mixing.block_quotas(large, mixing.target_weights(large), 16)
    assert sum(quota.values()) * 16 >= 0.5 * sum(counts.values())
    assert all(quota[s] * 16 >= n for s, n in tiny.items())
    if sum(tiny.values()) <= mixing.RARE * sum(counts.values()):
        assert {s: quota[s] for s in large} == pytest.approx(alone, abs=1)
        assert quota["hot"] / quota["s0"] == pytest.approx((50_000 / 2600) ** 0.5, rel=0.02)
    assert all(quota[s] <= -(-n // 16) for s, n in counts.items())


def test_derived_weights_draw_a_stated_share():
    counts = {"hot": 1_000_000} | {f"t{i}": 1 for i in range(100_000)}
    quota = mixing.block_quotas(counts, mixing.target_weights(counts), 16)
    assert all(quota[s] == 1 for s in counts if s != "hot")
    assert 0 <= quota["hot"] * 16 - (mixing.LEAST * 1_100_000 - 100_000) <= 16
    assert mixing.block_quotas({"a": 7}, mixing.target_weights({"a": 7}), 16) == {"a": 1}
    even = {s: 1600 for s in "abc"}
    assert mixing.block_quotas(even, mixing.target_weights(even), 16) == dict.fromkeys("abc", 100)


def test_the_drawn_rows_of_a_table_with_one_null_source(spark):
    counts = {"hot": 3000, "s1": 1000, "s2": 1000, None: 1}
    df = spark.createDataFrame([(i, f"{s} {i}", s, None) for s, n in counts.items() for i in range(n)], SCHEMA)
    got = Counter(r.source for r in mixing.mix(df).collect())
    assert got[None] == 1 and got["s1"] == got["s2"] == 1000 and 1700 < got["hot"] < 1760
    target, share, drawn, there = mixing.Plan(counts, None, 16, 4, 1).reached()["hot"]
    assert abs(share - target) < 0.02 and drawn < there


def test_given_weights_leave_no_source_out():
    assert mixing.block_quotas({"s": 1, "": 1, None: 2}, {"s": 1, "": 1, None: 2}, 16) == {"s": 1, "": 1, None: 1}
    # 20 rows are a full and a quarter block; the others give as many rows, not as many blocks
    assert mixing.block_quotas({"a": 20, "b": 1000, "c": 1000}, {"a": 1, "b": 1, "c": 2}, 16) == {"a": 2, "b": 1, "c": 3}
    assert mixing.block_quotas({"a": 10, "b": 10}, {"a": 1.0}, 16) == {"a": 1, "b": 0}


def test_large_draws_follow_the_distribution():
    """Inversion against exact chances where these can be counted, and the moments where they can't."""
    from math import comb

    rng = np.random.default_rng(3)
    got = Counter(mixing.inverted(rng, 7, 12, 8) for _ in range(4000))
    for k in range(8):
        assert abs(got[k] / 4000 - comb(7, k) * comb(12, 8 - k) / comb(19, 8)) < 0.03
    good, bad, draws = 4 * 10**9, 9 * 10**9, 5 * 10**9
    mean, var = draws * good / (good + bad), draws * good / (good + bad) * bad / (good + bad) * (good + bad - draws) / (good + bad)
    x = np.array([mixing.inverted(rng, good, bad, draws) for _ in range(200)], float)
    assert abs(x.mean() - mean) < 5 * (var / 200) ** 0.5 and 0.7 < x.var() / var < 1.4

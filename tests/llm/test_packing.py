from __future__ import annotations

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from wordloom.llm import packing

SCHEMA = "doc_id bigint, text string, bin string, items int"


def brute(lengths, capacity, most):
    """Online best fit with a plain list of open bins in the order in which they got their free space."""
    open_, closed = [], []
    for k, n in enumerate(lengths):
        fit = [b for b in open_ if b[0] >= n]
        if fit:
            best = min(fit, key=lambda b: b[0])
            open_.remove(best)
        else:
            if n < capacity and len(open_) == most:
                full = min(open_, key=lambda b: b[0])
                open_.remove(full)
                closed.append(full)
            best = [capacity, []]
        best[0] -= n
        best[1].append(k)
        (open_ if best[0] else closed).append(best)
    return closed + sorted(open_, key=lambda b: b[0])


@given(st.lists(st.integers(1, 12), max_size=80), st.integers(1, 5))
@settings(max_examples=200, deadline=None)
def test_bitset_against_a_plain_list(lengths, most):
    packer = packing.BestFit(12, most)
    got = []
    for k, n in enumerate(lengths):
        got += packer.add(n, k)
        assert packer.count <= most
    got += packer.close()
    assert [[f, i] for f, i in got] == brute(lengths, 12, most)


def test_round_trip_and_capacity(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice(("a", "é ", "  ", "\n", "word ")) for _ in range(rng.randrange(0, 400))), "x", 1) for i in range(300)]
    rows += [(1000, None, None, None), (1001, "", "y", 2), (1002, " \n ", "y", 2), (None, "no id here", "z", 3), (5, rows[5][1], "x", 1), (2000, "long " * 100_000, None, None)]
    bins = packing.best_fit(spark.createDataFrame(rows, SCHEMA).coalesce(1), 64, 4).collect()
    assert all(b.used + b.free == 64 and b.used == sum(x.n_tokens for x in b.items) and b.doc_ids == [x.doc_id for x in b.items] for b in bins)
    assert len({b.bin for b in bins}) == len(bins)
    pieces = {}
    for b in bins:
        for x in b.items:
            pieces.setdefault(x.doc_id, []).append((x.piece, x.text))
            assert len(x.text.split()) == x.n_tokens <= 64
    for doc_id, text, *_ in rows:
        if text is None or not text.split():
            assert doc_id not in pieces
        elif doc_id != 5:
            assert "".join(t for _, t in sorted(pieces[doc_id])) == text
    assert len(pieces[5]) == 2 * len({p for p, _ in pieces[5]})
    lengths = [min(64, n - k) for _, t, *_ in rows for n in [len((t or "").split())] for k in range(0, n, 64)]
    assert sorted(b.free for b in bins) == sorted(f for f, _ in brute(lengths, 64, 4))


def test_empty_table(spark):
    assert packing.best_fit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_token_starts_at_row_borders():
    raw = np.frombuffer(b"ab" b"cd e" b" f", np.uint8)
    assert packing.token_starts(raw, np.array([0, 2, 2, 6, 8])).tolist() == [0, 2, 5, 7]

from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from wordloom.llm.text import WORD, Words, fold, prefix, slices, span


def words_of(texts):
    w = Words(pa.array(texts, pa.string()))
    return [[w.folded[a:b].tobytes().decode() for a, b in zip(w.s[i:j], w.e[i:j], strict=True)] for i, j in zip(w.first[:-1], w.first[1:], strict=True)]


@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.characters(codec="utf-8")), st.text("ab ÀÞ×ß “. 　日İ")), max_size=6))
@settings(max_examples=300, deadline=None)
def test_words_agree_with_the_regular_expression(texts):
    assert words_of(texts) == [[fold(x) for x in WORD.findall(t or "")] for t in texts]


@given(st.lists(st.integers(0, 3), max_size=30))
@settings(max_examples=100, deadline=None)
def test_spans_are_equal_exactly_where_values_are(values):
    v = np.array(values, np.uint64)
    sums = prefix(v)
    n = len(v)
    at = [(i, j) for i in range(n + 1) for j in range(i, n + 1)]
    h = span(sums, np.array([i for i, _ in at]), np.array([j for _, j in at]))
    seen = {}
    for (i, j), x in zip(at, h.tolist(), strict=True):
        assert seen.setdefault(x, tuple(values[i:j])) == tuple(values[i:j])
    assert len(seen) == len({tuple(values[i:j]) for i, j in at})


def test_slices_keep_all_rows_in_order():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (0, 5, 300, 2, 2, 2)] + [None])], names=["x"])
    parts = list(slices(iter([batch, batch.slice(2, 3)]), "x", 6))
    assert [v for p in parts for v in p.column(0).to_pylist()] == batch.column(0).to_pylist() + batch.slice(2, 3).column(0).to_pylist()
    assert all(p.num_rows == 1 or sum(len(v or "") for v in p.column(0).to_pylist()) <= 6 for p in parts)


def test_sliced_arrays_read_their_own_rows():
    a = pa.array(["one two", "three", None, "four five six"])
    w = Words(a.slice(1, 3))
    assert np.diff(w.first).tolist() == [1, 0, 3]

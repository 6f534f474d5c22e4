from __future__ import annotations

import random

import numpy as np
import pytest
from wordloom.llm import passages
from wordloom.llm.text import WORD, fold

SCHEMA = "doc_id bigint, text string, lang string, d string, wanted int"


def brute(rows, length):
    """(doc_id, text) -> words that stand in an earlier window, by comparing all windows."""
    seen, out = set(), {}
    for doc_id, text in sorted({(d, t) for d, t, *_ in rows if t is not None}, key=lambda x: (x[0] is None, x[0] or 0)):
        words = [fold(x) for x in WORD.findall(text)]
        flag = [False] * len(words)
        for i in range(len(words) - length + 1):
            key = tuple(words[i : i + length])
            if key in seen:
                flag[i : i + length] = [True] * length
            seen.add(key)
        out[doc_id, text] = flag
    return out


def corpus(seed, docs=40, vocabulary=400, length=50):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    shared = [" ".join(word() for _ in range(rng.choice((length - 1, length, length + 1, 2 * length, 5 * length)))) for _ in range(6)]
    rows = []
    for i in range(docs):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 90))) if rng.random() < 0.6 else rng.choice(shared) for _ in range(rng.randrange(0, 6))]
        rows.append((i, rng.choice((" ", ".\n")).join(parts), "en", "x", 1))
    rows += [(docs + 1, "same " * 300, "en", None, None), (docs + 2, rows[3][1], "en", "y", 2)]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_all_windows(spark, seed):
    rows = corpus(seed)
    want = {d: sum(f) for (d, _), f in brute(rows, 50).items() if any(f)}
    got = {r.doc_id: r for r in passages.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {d: r.n_repeated for d, r in got.items()} == want
    for d, r in got.items():
        text = next(x[1] for x in rows if x[0] == d)
        flags = next(f for (i, _), f in brute(rows, 50).items() if i == d)
        assert [fold(x) for x in WORD.findall(r.text)] == [fold(x) for x, f in zip(WORD.findall(text), flags, strict=True) if not f]
        assert sum(len(WORD.findall(text[s.start : s.end])) for s in r.spans) == r.n_repeated
        assert r.first_doc_ids and all(x <= d for x in r.first_doc_ids)


def test_stage_keeps_columns_and_awkward_rows(spark):
    long = " ".join(f"v{i}" for i in range(80))
    rows = [(None, long, "en", "a", 1), (2, long, None, "b", None), (2, long, None, "b", None), (3, None, "de", None, 1), (4, "", "de", None, 1), (5, "short text", "de", None, 1), (5, "short text", "de", None, 1), (6, "tail " + long + "!", "fr", "c", 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = passages.drop_repeats(df)
    assert out.columns == df.columns
    assert sorted(out.collect(), key=str) == sorted([(2, long, None, "b", None), (3, None, "de", None, 1), (4, "", "de", None, 1), (5, "short text", "de", None, 1), (6, "tail ", "fr", "c", 3)], key=str)
    assert passages.drop_repeats(df.limit(0)).collect() == [] and passages.repeated_passages(df.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_suffix_order_is_the_order_of_the_letters(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 60, 12)
    letters = rng.integers(1, 4, int(sizes.sum())).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    at = passages.corpus_order(letters, first, 5)
    assert sorted(at.tolist()) == [i for a, b in zip(first[:-1], first[1:], strict=True) for i in range(a, b - 4)]
    windows = [tuple(letters[i : i + 5].tolist()) for i in at]
    groups = [w for k, w in enumerate(windows) if k == 0 or windows[k - 1] != w]
    assert len(groups) == len(set(groups))  # equal windows stand together


def test_a_long_text(spark):
    text = " ".join(f"n{i * i % 99991}" for i in range(120_000))
    rows = [(1, text, "en", None, 1), (2, text[: len(text) // 2], "en", None, 1)]
    got = passages.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()
    want = {d: sum(f) for (d, _), f in brute(rows, 50).items() if any(f)}
    assert {r.doc_id: r.n_repeated for r in got} == want


@pytest.mark.parametrize("length", [8, 72, 200])
def test_other_lengths_against_all_windows(spark, length):
    rows = corpus(7, length=length)
    want = {d: sum(f) for (d, _), f in brute(rows, length).items() if any(f)}
    got = {r.doc_id: r.n_repeated for r in passages.repeated_passages(spark.createDataFrame(rows, SCHEMA), length).collect()}
    assert got == want


def test_lengths_that_cannot_be_kept(spark):
    df = spark.createDataFrame(corpus(1), SCHEMA)
    for length in (passages.WINDOW - 1, 1 << passages.GAP):
        with pytest.raises(ValueError):
            passages.spans(df, length)


def test_texts_are_shuffled_once(spark, tmp_path):
    rows = corpus(2)
    for make in (passages.drop_repeats, passages.repeated_passages):
        out = make(spark.createDataFrame(rows, SCHEMA))
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        moves = [x for x in plan.splitlines() if "Exchange hashpartitioning(_wl_d" in x and "REPARTITION_BY_COL" in x]
        assert len(moves) == 2 and sum("ReusedExchange" in x for x in moves) == 1

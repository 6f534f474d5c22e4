from __future__ import annotations

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from wordloom.llm import compression, labels, quality_rules, toxicity
from wordloom.llm.text import WORD, Words, fold

SCHEMA = "doc_id bigint, text string, p_good string, lang string"
LABELS = "doc_id bigint, quality int, toxic int, text int"


def corpus(n=400, seed=2):
    rng = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        good = i % 3 > 0
        words = [rng.choice("river stone house garden walk light under between morning evening table".split()) for _ in range(rng.randrange(20, 80))]
        text = " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words) if i % 2 else " | ".join([rng.choice(words)] * 40)
        toxic = i % 5 == 0
        if toxic:
            text += " You worthless moron."
        rows.append((i, text, "clash", "en"))
        marks.append((i, int(good), int(toxic), None))
    return rows, marks


@pytest.fixture(scope="module")
def tables(spark):
    rows, marks = corpus()
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, LABELS), rows, marks


def test_sample_is_bounded_and_fixed(spark, tables):
    docs, marks, rows, _ = tables
    texts, y, share = labels.sample(docs, marks, "quality", 30)
    assert (y == 0).sum() == (y == 1).sum() == 30 and abs(share - 2 / 3) < 0.01
    again = labels.sample(docs.repartition(7), marks.repartition(3), "quality", 30)
    assert again[0] == texts and (again[1] == y).all()
    both = spark.createDataFrame([(0, 1, 0, None), (0, 0, 0, None), (1, None, None, None), (None, 1, 1, None), (2, 1, 0, None), (2, 1, 0, None)], LABELS)
    assert labels.sample(docs, both, "quality", 30)[0] == [rows[2][1]]


def test_a_labelled_id_that_stands_often_counts_once(spark):
    docs = spark.createDataFrame([(1, f"text {i % 7}", None, None) for i in range(500)] + [(2, "other", None, None)], SCHEMA)
    marks = spark.createDataFrame([(1, 1, 0, None), (2, 0, 0, None)], LABELS)
    texts, y, _ = labels.sample(docs, marks, "quality", 30)
    assert list(zip(texts, y.tolist(), strict=True)) == [("other", 0), ("text 0", 1)]


def test_platt_finds_the_curve():
    rng = np.random.default_rng(0)
    x = rng.normal(size=20000)
    y = (rng.random(20000) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(int)
    a, b = labels.platt(x, y, y.mean())
    assert abs(a - 2) < 0.1 and abs(b + 1) < 0.1
    a, b = labels.platt(np.array([-1.0, -2, 1, 2]), np.array([0, 0, 1, 1]), 0.5)
    assert math.isfinite(a) and a > 0


@pytest.mark.parametrize("module", [quality_rules, compression])
def test_held_out_accuracy(tables, module):
    docs, marks, rows, truth = tables
    model = module.fit(docs.where("doc_id < 300"), marks)
    late = [(t, m[1]) for (i, t, *_), m in zip(rows, truth, strict=True) if i >= 300]
    chance = model.chance(pa.array([t for t, _ in late]))
    y = np.array([q for _, q in late])
    assert ((chance >= 0.5) == y).mean() > 0.95
    assert labels.auc(chance, y) > 0.97


def test_quality_scores_agree_with_plain_sums(tables):
    docs, marks, rows, _ = tables
    model = quality_rules.fit(docs, marks, 50)
    for text in [rows[0][1], rows[1][1], "", "a", "ab", "abc", "é!", "one two"]:
        raw = text.encode()
        margin = model.bias
        for kind, n in enumerate(quality_rules.CHARS):
            grams = [raw[i : i + n] for i in range(len(raw) - n + 1)]
            slots = [(int.from_bytes(g, "big") * 0x9E3779B97F4A7C15 % 2**64) >> (64 - quality_rules.BITS) for g in grams]
            margin += quality_rules.SCALE * sum(float(model.weights[s + kind * quality_rules.SLOTS]) for s in slots) / max(1, len(slots))
        h = [int(x) for x in Words(pa.array([text])).h]
        for kind, values in ((3, h), (4, [int(x) for x in quality_rules.mix64(np.array([(a * 3 + b) % 2**64 if a != b else 0 for a, b in zip(h, h[1:], strict=False)], np.uint64))])):
            slots = [v >> (64 - quality_rules.BITS) for v in values]
            margin += quality_rules.SCALE * sum(float(model.weights[s + kind * quality_rules.SLOTS]) for s in slots) / max(1, len(slots))
        assert model.margin(pa.array(["before", text, "after"]))[1] == pytest.approx(margin, abs=1e-6)


def test_quality_keeps_columns_and_awkward_rows(spark, tables):
    docs, marks, *_ = tables
    kept = quality_rules.keep_good(docs, marks)
    assert kept.columns == docs.columns
    good = {r.doc_id for r in marks.where("quality = 1").collect()}
    assert len({r.doc_id for r in kept.collect()} ^ good) <= 0.05 * len(good)
    model = quality_rules.fit(docs, marks)
    odd = spark.createDataFrame([(None, None, "x", None), (1, "", "x", None), (2, "dup", "x", "en"), (2, "dup", "x", "en"), (3, "very long " * 200_000, None, None)], SCHEMA)
    out = quality_rules.score(odd, model).collect()
    assert len(out) == 5 and all(0 <= r.p_good <= 1 for r in out) and quality_rules.score(odd.limit(0), model).collect() == []
    assert len(compression.score(odd, compression.fit(docs, marks)).collect()) == 5
    assert compression.score(odd.limit(0), compression.fit(docs, marks)).collect() == []


def test_compressed_sizes_against_plain_zstandard(tables):
    docs, marks, rows, _ = tables
    model = compression.fit(docs, marks)
    texts = [rows[0][1], rows[1][1], "", None, "é", "again and again " * 5000]
    for text, (difference, ratio, size) in zip(texts, model.measures(pa.array(texts, pa.string())).tolist(), strict=True):
        raw = (text or "").encode()
        if not raw:
            assert (difference, ratio, size) == (0, 1, 1)
            continue
        packed = []
        for known in (model.good, model.bad):
            known = zstandard.ZstdCompressionDict(known)
            packed.append(zstandard.ZstdCompressor(level=compression.LEVEL, dict_data=known, write_content_size=False, write_dict_id=False, write_checksum=False).compress(raw))
            assert zstandard.ZstdDecompressor(dict_data=known).decompress(packed[-1], max_output_size=len(raw)) == raw
        g, b = map(len, packed)
        assert (difference, ratio, size) == pytest.approx(((b - g) / (b + g), (b + g) / 2 / len(raw), len(raw)))
        z = float(model.weights @ np.array([difference, math.log(ratio), math.log(size)])) + model.bias
        assert model.chance(pa.array([text]))[0] == pytest.approx(1 / (1 + math.exp(-max(min(z, 500), -500))))


def test_held_out_bad_documents_by_compression(spark, sf):
    """sf0.1, one half for the other: nearly all good documents stay, few bad ones."""
    docs, marks = spark.read.parquet(f"{sf}/../sf0.1/documents.parquet"), spark.read.parquet(f"{sf}/../sf0.1/labels.parquet")
    model = compression.fit(docs, marks.where("doc_id % 2 = 0"))
    rows = compression.score(docs.join(marks.where("doc_id % 2 = 1"), "doc_id"), model).join(marks, "doc_id").collect()
    kept = {q: np.mean([r.p_good >= compression.KEEP for r in rows if r.quality == q]) for q in (0, 1)}
    assert kept[1] >= 0.98 and kept[0] <= 0.1


@pytest.mark.parametrize("module", [quality_rules, compression])
def test_without_labels_the_share_is_the_chance(spark, tables, module):
    docs, marks, *_ = tables
    for some in (marks.limit(0), marks.where("quality = 1")):
        model = module.fit(docs, some)
        p = model.chance(pa.array(["anything", None]))
        assert p[0] == pytest.approx(p[1]) and 0 <= p[0] <= 1


@pytest.mark.parametrize("module, query", [(quality_rules, "op5_quality_rules"), (compression, "op3_compression_quality")])
def test_queries_return_rejected_documents_too(spark, sf, module, query):
    out = getattr(module, query)(spark, sf).collect()
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.keep == (r.p_good >= module.KEEP) for r in out) and {r.keep for r in out} == {True, False}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


TERMS = ["moron", "morons", "worthless", "disgusting", "scum", "trash", "übel", "idiot"]


@given(st.one_of(st.text("abcdimnorstuhlwegüb", max_size=12), st.tuples(st.sampled_from(TERMS), st.integers(0, 12), st.sampled_from("aeou")).map(lambda x: x[0][: x[1]] + x[2] + x[0][x[1] + 1 :])))
@settings(max_examples=400, deadline=None)
def test_automaton_and_filter_against_all_distances(word):
    want = sorted((distance(word, t), t) for t in TERMS if distance(word, t) <= toxicity.edits(t))
    rooms = {t: toxicity.edits(t) for t in TERMS}
    assert toxicity.Trie(rooms).near(word) == want
    lexicon = toxicity.Lexicon(rooms, ())
    hits = lexicon.hits(Words(pa.array([f"a {word} b"])))
    assert [(d, t) for _, d, t in hits if d is not None][:1] == want[:1] or not WORD.fullmatch(word)


@pytest.mark.parametrize("word", ["sc\U00020000mm", "ｓcumm", "scu\U00020000m", "\U00020000cumm", "scum\u4e00m"])
def test_an_edit_may_be_a_character_of_several_bytes(word):
    lexicon = toxicity.Lexicon({"scumm": 1}, ())
    assert distance(fold(word), "scumm") <= 1
    assert [h[1:] for h in lexicon.hits(Words(pa.array([word])))] == [lexicon.match(fold(word))]


def test_learned_lexicon_and_context(spark, tables):
    docs, marks, *_ = tables
    lexicon = toxicity.fit(docs, marks)
    assert {"worthless", "moron"} <= set(lexicon.terms)
    rows = [(1, "you are a moron and worthless", None, "en"), (2, "you w0rthless thing", None, "en"), (3, 'she said "moron" to him', None, "en"), (4, "a calm river", None, "en"), (5, None, None, None), (6, "", None, None), (None, "MORON!", "x", None), (7, "moron", None, None), (7, "moron", None, None), (8, "calm " * 200_000 + "worthles", None, "en"), (9, "er rief „moron“ laut", None, "de")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = toxicity.detect(df, lexicon).collect()
    assert sorted((r.doc_id or 0) for r in out) == [0, 1, 2, 7, 7, 8]
    assert all(r.toxic and 0.5 <= r.toxicity <= 1 and r.terms for r in out)
    low = {r.doc_id: r for r in toxicity.detect(df, lexicon, 0.01).collect()}
    assert low[3].n_quoted == 1 and low[9].n_quoted == 1 and low[2].n_misspelled == 1
    assert toxicity.detect(df.limit(0), lexicon).collect() == [] and toxicity.detect(df, toxicity.Lexicon({}, ())).collect() == []


def test_short_words_are_learned():
    rng = random.Random(6)
    common = "the and a of in to is it we on".split()
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = [" ".join([word() for _ in range(30)] + rng.sample(common, 5) + ["zog"] * (i < 100)) for i in range(400)]
    lexicon = toxicity.learn(texts, np.array([1] * 100 + [0] * 300), 0.1)
    assert lexicon.terms == {"zog": 0}
    assert [x[0] for x in toxicity.assess(Words(pa.array(["you zog", "the dog", "zo zogg"])), lexicon)] == [0]


def test_stems_are_learned():
    rng = random.Random(5)
    syllables = "ba ke lo mi nu ra so ti vo za".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(3))
    texts = [" ".join(word() for _ in range(30)) + (f" lowei{word()} x" if i < 100 else "") for i in range(400)]
    lexicon = toxicity.learn(texts, np.array([1] * 100 + [0] * 300), 0.1)
    assert any("lowei".startswith(s) or s.startswith("lowei") for s in lexicon.stems)
    found = toxicity.assess(Words(pa.array(["ba loweineunoch ke", "bake lomi"])), lexicon)
    assert [x[0] for x in found] == [0]


def test_toxicity_held_out_with_few_labels(spark, sf):
    """16 distinct toxic documents to learn from: 21 of 35 others are found, as README says; the bound of chance lets no more terms pass."""
    docs, marks = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet"), spark.read.parquet(f"{sf}/../sf0.01/labels.parquet")
    lexicon = toxicity.fit(docs, marks.where("doc_id % 2 = 0"))
    got = {r.doc_id for r in toxicity.detect(docs, lexicon).collect()}
    late = marks.where("doc_id % 2 = 1").collect()
    assert sum(r.doc_id in got for r in late if r.toxic == 0) <= 0.02 * len(late)
    assert sum(r.doc_id in got for r in late if r.toxic) >= 0.55 * sum(r.toxic for r in late)


def plainly_quoted(before, after):
    before, after = before.rpartition("\n")[2], after.partition("\n")[0]
    return before.count('"') % 2 == 1 and '"' in after or any(before.rfind(a) > before.rfind(b) and b in after for a, b in toxicity.MARKS.items())


def plain_score(text, terms):
    """The score of a document from all distances and whole lines."""
    clear = 1.0
    for m in WORD.finditer(text):
        near = sorted((distance(fold(m[0]), t), t) for t in terms if distance(fold(m[0]), t) <= toxicity.edits(t))
        if near:
            weight, before = toxicity.WEIGHT[near[0][0]], text[: m.start()]
            if plainly_quoted(before, text[m.end() :]):
                weight *= toxicity.QUOTED
            elif {fold(x).encode() for x in WORD.findall(re.split(r"[.!?\n]", before)[-1])[-toxicity.CUE_WORDS :]} & toxicity.CUES:
                weight *= toxicity.REPORTED * 0.9
            clear *= 1 - min(weight, 0.999)
    return 1 - clear


BITS = st.sampled_from(["moron", "scumm", "Worthles", "calm", "said", "he", " ", " ", '"', "“", "”", "„", "«", "»", ".", "\n", "übel", "nannte", "x" * 500])


@given(st.lists(st.lists(BITS, max_size=30).map(" ".join), max_size=4))
@settings(max_examples=300, deadline=None)
def test_scores_against_plain_ones(texts):
    terms = ["moron", "worthless", "scumm", "übel"]
    lexicon = toxicity.Lexicon({t: toxicity.edits(t) for t in terms}, ())
    found = {r: score for r, score, *_ in toxicity.assess(Words(pa.array(texts, pa.string())), lexicon)}
    for i, text in enumerate(texts):
        assert found.get(i, 0.0) == pytest.approx(plain_score(text, terms))


def test_a_quotation_opened_far_before():
    lexicon = toxicity.Lexicon({"moron": 0}, ())
    text = 'He read: "' + "calm river " * 200 + "moron " + "calm river " * 200 + '" and left.'
    assert [x[4] for x in toxicity.assess(Words(pa.array([text, text.replace('"', "")])), lexicon)] == [1, 0]


def test_toxicity_held_out_with_more_labels(spark, sf):
    docs, marks = spark.read.parquet(f"{sf}/../sf0.1/documents.parquet"), spark.read.parquet(f"{sf}/../sf0.1/labels.parquet")
    lexicon = toxicity.fit(docs, marks.where("doc_id % 2 = 0"))
    got = {r.doc_id for r in toxicity.detect(docs, lexicon).collect()}
    late = marks.where("doc_id % 2 = 1").collect()
    assert sum(r.doc_id in got for r in late if r.toxic == 0) <= 0.005 * len(late)
    assert sum(r.doc_id in got for r in late if r.toxic) >= 0.8 * sum(r.toxic for r in late)


def test_fold_is_what_words_use():
    assert fold("ÀÉÞ×ABC") == "àéþ×abc"

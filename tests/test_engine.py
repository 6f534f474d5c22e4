from __future__ import annotations

import gzip
import inspect
import io
import json
import math
import random
import shutil
import threading
import urllib.request
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from wordloom import queries
from wordloom.api import Engine, serve
from wordloom.errors import QueryError
from wordloom.functions import cut
from wordloom.functions.stem import _STEP2, _STEP3, _STEP4, beginning, porter
from wordloom.functions.timefields import derive, parse_date
from wordloom.functions.tokens import PATTERN, all_grams, fold_accents, gram_count, ngrams, tokens
from wordloom.plans.corpus import HITS, Corpus, TableWords, TextWords, _distinct, folded, gram_counts, listed_runs, pair_code, pair_hash, phrase_test, ranked, runs, vocabulary
from wordloom.plans.fields import Field, infer, join_path, parse_descriptions
from wordloom.plans.spec import normalise, phrases
from wordloom.sources import formats, readers
from wordloom.streaming.ingest import append_counts, stream_texts

TEXTS = [("a", "The cat sat on the mat. The dog ran.", "hamilton", "1", ["x", "y"], "1787-11-27"), ("b", "A dog and a cat; THE end.", "madison", "2", ["x"], "1788"), ("c", "Don't stop upon the 3rd mat $4.50!", "hamilton", "10", [], None), ("d", "ᎠᏂᏴᏫ ᏣᎳᎩ الكتاب \"قال\" café", None, "n/a", ["y", "y"], "1788-02")]
DDL = "filename string, text string, author string, number string, tags array<string>, date string"
FIELDS = [Field("author"), Field("number"), Field("tags", unique=False), Field("date", "time", derived=(("year", None), ("day", "year")))]


@pytest.fixture(scope="module")
def lazy(spark):
    return Corpus.from_documents("fed", spark.createDataFrame(TEXTS, DDL), FIELDS)


@pytest.fixture(scope="module")
def built(lazy, tmp_path_factory):
    return lazy.build(str(tmp_path_factory.mktemp("corpus") / "fed"))


@pytest.fixture(scope="module", params=["lazy", "built"])
def engine(request):
    return Engine(request.getfixturevalue(request.param))


def ask(engine, **q):
    out = engine.query({"database": "fed", "groups": [], "counttype": "WordCount"} | q)
    assert out["status"] == "success", out
    return out["data"]


def test_tokens(spark):
    def cut(text):
        return spark.createDataFrame([(text,)], "t string").select(tokens(F.col("t"))).first()[0]

    assert cut("Don't stop, Mr. O'Neil's 3rd $4.50 c# 1,000 cats\n") == ["Don", "'", "t", "stop", ",", "Mr.", "O", "'", "Neil's", "3", "rd", "$4.50", "c#", "1", ",", "000", "cats", "\n"]
    assert cut("كِتَاب ᏣᎳᎩ") == ["كِتَاب", "ᏣᎳᎩ"]
    assert cut("") == [] and cut(None) == []


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    assert [r[0] for r in df.select(ngrams(F.col("t"), 2)).collect()] == [["a b", "b c"], [], []]
    assert [r[0] for r in df.select(ngrams(F.col("t"), 3)).collect()] == [["a b c"], [], []]


def test_gram_count_is_the_number_of_grams(spark):
    df = spark.createDataFrame([(list("abcdefgh"),), (list("abc"),), (["a"],), ([],)], "t array<string>")
    rows = df.select(gram_count(F.col("t"), 6), F.size(all_grams(F.col("t"), 6))).collect()
    assert [r[0] for r in rows] == [r[1] for r in rows] == [33, 6, 1, 0]


@pytest.mark.parametrize("name", ["allgrams_sizes", "ngrams_trigram_counts", "bigram_structs"])
def test_texts_are_cut_once(spark, sf, name):
    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    assert name != "allgrams_sizes" or "zip_with" not in plan


def test_groups_and_words(engine):
    assert ask(engine, groups=["author"], counttype="TextCount") == {"": [1], "hamilton": [2], "madison": [1]}
    assert ask(engine, search_limits={"word": ["the"]}, counttype=["WordCount", "TextCount"]) == [5, 3]
    assert ask(engine, search_limits={"word": ["the"]}, words_collation="Case_Sensitive") == [2]
    assert ask(engine, search_limits={"word": ["THE"]}, words_collation="casesens") == [1]
    assert ask(engine, search_limits={"word": "cat"}) == [2]
    assert ask(engine, search_limits={"word": ["on", "upon"]}) == [2]
    assert ask(engine, search_limits={"word": ["the mat"]}) == [1]
    assert ask(engine, search_limits={"word": ["ᏣᎳᎩ"]}) == [1] and ask(engine, search_limits={"word": ["قال"]}) == [1]
    assert ask(engine, search_limits={"word": ["cafe"]}, words_collation="accent_insensitive") == [1]
    assert ask(engine, search_limits={"word": ["stopping"]}, words_collation="stem") == [1]
    assert ask(engine, search_limits={"word": ["absent"]}) == [None]
    assert ask(engine, search_limits={"word": ["the absent"]}, groups=["author"]) == {}


def test_filters(engine):
    count = lambda limits: ask(engine, search_limits=limits, counttype="TextCount")[0]
    assert count({"author": "hamilton"}) == 2 and count({"author": ["hamilton", "madison"]}) == 3
    assert count({"author": {"$ne": "hamilton"}}) == 2 and count({"author": {"$ne": ["hamilton", "madison"]}}) == 1
    assert count({"$or": [{"author": "madison"}, {"number": "1"}]}) == 2
    assert count({"$and": [{"author": "madison"}, {"author": "hamilton"}]}) == 0
    assert count({"number": {"$gte": 2, "$lte": 10}}) == 2 and count({"number": {"$gt": 1, "$lt": 10}}) == 1
    assert count({"author": {"$grep": "^HAM"}}) == 2 and count({"author": []}) == 4
    assert count({"author": [{"number": "1"}, {"author": "hamilton"}]}) == 1
    assert count({"hasword": ["cat", "dog"]}) == 2 and count({"hasword": ["cat", "mat"]}) == 1
    assert count({"date_year": 1788}) == 2


def test_multivalued_filters_choose_documents(engine):
    assert ask(engine, groups=["tags"], counttype="TextCount") == {"x": [2], "y": [2]}
    assert ask(engine, groups=["tags"], counttype="TextCount", search_limits={"tags": "x"}) == {"x": [2], "y": [1]}
    assert ask(engine, groups=["tags"], counttype="TextCount", search_limits={"tags": "x", "word": ["the"]}) == {"x": [2], "y": [1]}


def test_comparisons(engine):
    star = ask(engine, search_limits={"word": ["the"], "*author": "hamilton"}, groups=["number"], counttype="WordsPerMillion")
    same = ask(engine, search_limits={"word": ["the"], "author": "hamilton"}, compare_limits={"word": ["the"]}, groups=["number"], counttype="WordsPerMillion")
    assert star == same and star["1"] == [1e6] and star["2"] == [0.0]
    x, total, both = ask(engine, search_limits={"word": ["the"]}, counttype=["WordCount", "TotalWords", "SumWords"])
    assert x + total == both
    rows = ask(engine, search_limits={"word": ["the"]}, groups=["author"], counttype=["WordCount", "TotalWords"])
    assert sum(r[0] for r in rows.values()) == x and sum(r[1] for r in rows.values()) == total
    only = ask(engine, groups=["*author"], counttype="WordsRatio")
    assert math.isclose(sum(r[0] for r in only.values()), 1)
    assert ask(engine, search_limits={"word": ["absent"]}, groups=["author"], counttype=["TextPercent", "HitsPerText", "TFIDF"])["madison"] == [0.0, 0.0, 0.0]


def g2(a, b, c, d):
    a, b = a or 0.5, b or 0.5
    e1, e2 = c * (a + b) / (c + d), d * (a + b) / (c + d)
    g = 2 * (a * math.log(a / e1) + b * math.log(b / e2))
    return -g if math.log(a / e1) < math.log(b / e2) else g


def test_dunning_and_order_of_counttypes(engine):
    q = {"search_limits": {"author": "hamilton"}, "compare_limits": {"author": "madison"}, "groups": ["unigram"]}
    rows = ask(engine, **q, counttype=["WordCount", "TotalWords", "Dunning", "SumWords"])
    c, d = (sum(r[k] or 0.5 for r in rows.values()) for k in (0, 1))
    for a, b, g, both in rows.values():
        assert math.isclose(g, g2(a, b, c, d), rel_tol=1e-9, abs_tol=1e-12) and both == a + b
    assert {k: r[2] for k, r in rows.items()} == {k: r[0] for k, r in ask(engine, **q, counttype="Dunning").items()}


def test_multi_search(engine):
    limits = [{"word": ["the"]}, {"word": ["cat"]}]
    assert ask(engine, search_limits=limits, groups=["author"]) == [ask(engine, search_limits=x, groups=["author"]) for x in limits]
    text = engine.query({"database": "fed", "search_limits": limits, "groups": [], "counttype": "WordCount", "format": "csv"})
    assert text == "WordCount,Search\n5,0\n2,1\n"


def test_supplementary_metadata(engine, spark):
    corpus = engine.corpora["fed"].add_metadata(spark.createDataFrame([("1", "odd"), ("2", "even"), ("99", "odd")], "number string, oddness string"), "number")
    corpus = corpus.add_metadata(spark.createDataFrame([("odd", "O"), ("even", "E")], "oddness string, letter string"), "oddness")
    more = Engine(corpus)
    assert ask(more, groups=["letter"], counttype="TextCount") == {"E": [1], "O": [1]}
    assert ask(more, search_limits={"letter": "O"}, counttype="TextCount") == [1]
    assert [f.name for f in join_path(corpus.fields, "letter")] == ["oddness", "letter"]


def test_search_and_schema(engine):
    assert ask(engine, method="search", search_limits={"word": ["cat"]}) == ["b", "a"]
    assert ask(engine, method="search", search_limits={"word": ["absent"]}) == ["<empty results>"]
    assert sorted(ask(engine, method="search")) == ["a", "b", "c", "d"]
    assert [x["name"] for x in ask(engine, method="schema")] == ["author", "date_day_year", "date_year", "number", "tags"]


@pytest.mark.parametrize("q", [{"counttype": "Nope"}, {"groups": ["nope"]}, {"search_limits": {"nope": 1}}, {"search_limits": {"a;b": 1}}, {"search_limits": {"$or": []}}, {"search_limits": {"author": None}}, {"search_limits": {"word": ["a b c"]}}, {"search_limits": {"word": ["a", "a b"]}}, {"search_limits": {"$or": [{"word": ["a"]}]}}, {"method": "nope"}, {"format": "nope"}, {"database": "nope"}, {"words_collation": "nope", "search_limits": {"word": ["a"]}}, {"groups": ["author", "*author"]}])
def test_errors_are_objects(engine, q):
    out = engine.query({"database": "fed", "groups": [], "counttype": "WordCount"} | q)
    assert out["status"] == "error" and out["code"] in (400, 404) and out["message"]


def test_missing_keys_and_bad_json(engine):
    for q in ({}, {"database": "fed"}, {"database": "fed", "groups": []}, "not json", "[]"):
        assert engine.query(q)["status"] == "error"


def test_queries_are_not_changed():
    q = {"database": "fed", "groups": ["*a"], "counttype": "WordsRatio", "search_limits": {"*b": [1], "c": []}}
    before = json.dumps(q)
    normalise(q)
    assert json.dumps(q) == before
    assert phrases({"word": "two words"}) == [["two", "words"]]


def test_formats(engine):
    q = {"database": "fed", "groups": ["author"], "counttype": ["TextCount"]}
    assert engine.query(q | {"format": "csv"}) == 'author,TextCount\n"",1\nhamilton,2\nmadison,1\n' or engine.query(q | {"format": "csv"}).startswith("author,TextCount\n")
    assert engine.query(q | {"format": "tsv"}).splitlines()[0] == "author\tTextCount"
    assert engine.query(q | {"format": "json_c"})["data"] == {"author": ["", "hamilton", "madison"], "TextCount": [1, 2, 1]}
    assert pd.read_feather(io.BytesIO(engine.query(q | {"format": "feather"})))["TextCount"].tolist() == [1, 2, 1]
    assert "<td>hamilton</td><td>2</td>" in engine.query(q | {"format": "html"})
    assert engine.query(q | {"method": "return_json"}) == {"": [1], "hamilton": [2], "madison": [1]}


def test_run_lengths_and_nulls():
    assert formats.run_lengths([]) == [] and formats.run_lengths([1, 1, 2, 2, 2, 1, 1.0, None]) == [[2, 1], [3, 2], 1, 1.0, None]
    df = pd.DataFrame({"g": ["a", "b"], "x": [float("inf"), 1.0], "y": [float("nan"), 2.0]})
    assert formats.nested(df, ["g"], ["x", "y"]) == {"a": [None, None], "b": [1.0, 2.0]}
    assert formats.table(pd.DataFrame({"a": ["<b>"], "searchstring": ["<i>"]})).endswith("<td>&lt;b&gt;</td><td><i></td></tr></tbody></table>")


def test_vocabulary_limit(lazy, tmp_path):
    small = lazy.build(str(tmp_path / "small"), 3)
    words = {r.word: r.wordid for r in small.spark.read.parquet(str(tmp_path / "small/words")).collect()}
    found = Counter(r.word for r in lazy.source.words(lazy.catalog.select("bookid", "_text"), 1).collect())
    assert words == {w: k for k, (w, _) in enumerate(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:3])}
    assert small.catalog.agg(F.sum("nwords")).first()[0] == small.source.unigrams.agg(F.sum("count")).first()[0]
    assert all({r.word1, r.word2} <= set(words) for r in small.source.bigrams.collect())
    counts = lazy.spark.createDataFrame([("b", 2), ("a", 2), ("c", 1)], "word string, count bigint")
    assert [(r.wordid, r.word) for r in vocabulary(counts, 2).orderBy("wordid").collect()] == [(0, "a"), (1, "b")]


def test_word_limit_reaches_the_scan(built):
    plan = Engine(built).frame({"database": "fed", "groups": [], "counttype": "WordCount", "search_limits": {"word": ["the"]}})._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "EqualTo(folded,the)" in plan.replace(" ", "") or "In(folded" in plan


def test_no_word_limit_reads_no_words(built, lazy):
    plan = Engine(built).frame({"database": "fed", "groups": ["author"], "counttype": "TextCount"})._jdf.queryExecution().toString()
    assert "unigrams" not in plan
    plan = Engine(lazy).frame({"database": "fed", "groups": ["author"], "counttype": "WordCount", "search_limits": {"word": ["the"]}})._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_time_fields(spark):
    rows = [("1970-01-01",), ("1788",), ("1788-02",), ("1788-02-11 13:05:00",), ("rubbish",), ("",), (None,)]
    got = spark.createDataFrame(rows, "d string").select(parse_date(F.col("d")).cast("string").alias("t"), *[derive(F.col("d"), *k).alias("_".join(x for x in k if x)) for k in (("day", None), ("week", None), ("month", "year"), ("minute", "day"), ("day", "week"))]).collect()
    assert [r.t for r in got] == ["1970-01-01 00:00:00", "1788-01-01 00:00:00", "1788-02-01 00:00:00", "1788-02-11 13:05:00", None, None, None]
    assert got[0].day == 719528 and got[0].week == 719528 // 7 * 7 and got[3].month_year == 32 and got[3].minute_day == 785 and got[0].day_week == 4
    with pytest.raises(QueryError):
        derive(F.lit("x"), "century")


def test_fields():
    found = {f.name: f for f in infer([{"filename": "a", "author": "x", "tags": ["p", "q"], "date": "1", "time_of": "z", "searchstring": "s", "word": 1}, {"filename": "b", "date": "2", "time_of": "z"}, {"time_of": "z"}])}
    assert set(found) == {"author", "tags", "date", "time_of", "searchstring"}
    assert not found["tags"].unique and found["author"].unique and found["date"].datatype == "time" and found["time_of"].datatype == "categorical" and found["searchstring"].datatype == "searchstring"
    text = '[{"field": "date", "datatype": "time", "type": "character", "unique": true, "derived": [{"resolution": "year"}, {"resolution": "day", "aggregate": "year"}]}, {"field": "words", "datatype": "etc", "type": "text"}]'
    assert parse_descriptions(text) == [Field("date", "time", "character", derived=(("year", None), ("day", "year")))]


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("dog's", "dog"), ("café", "café")])
def test_porter(word, stem):
    assert porter(word) == stem


def test_sources(spark, tmp_path):
    (tmp_path / "in.txt").write_text("a\tone\ttwo\nno tab here\nb\t\n")
    with gzip.open(tmp_path / "in.txt.gz", "wt") as f:
        f.write("c\tthree\n")
    assert sorted(map(tuple, readers.texts(spark, [str(tmp_path / "in.txt"), str(tmp_path / "in.txt.gz")]).collect())) == [("a", "one\ttwo"), ("b", ""), ("c", "three")]
    assert tuple(readers.bad_lines(spark, str(tmp_path / "in.txt")).first()) == (3, 1, True)
    (tmp_path / "cat.json").write_text('{"filename": "a", "x": 1}\nrubbish\n{"filename": "b", "x": 2}\n')
    assert readers.catalog(spark, str(tmp_path / "cat.json")).count() == 2
    assert readers.catalog(spark, str(tmp_path / "cat.json"), "filename string, x int").count() == 2
    (tmp_path / "cat.csv").write_text("filename,x\na,1\n")
    assert readers.catalog(spark, str(tmp_path / "cat.csv")).first().x == "1"
    (tmp_path / "m.tsv").write_text("para\todd\n1\todd\n")
    df, key = readers.metadata(spark, str(tmp_path / "m.tsv"))
    assert key == "para" and df.first().odd == "odd"
    lines = spark.createDataFrame([("a\tNA,3\fx,y,2\fx,y,1\fbad\f\"q\",5",), ("no tab",)], "value string")
    assert sorted(map(tuple, readers.counted_words(lines).collect())) == [("a", "NA", 3), ("a", "q", 5), ("a", "x,y", 3)]
    pairs = spark.createDataFrame([("a\tof the,3\fone,1",)], "value string")
    assert list(map(tuple, readers.counted_words(pairs, 2).collect())) == [("a", "of", "the", 3)]
    assert readers.gram_size("x.bigrams.txt") == 2 and readers.gram_size("x") == 1
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "one.txt").write_text("whole\ntext")
    assert tuple(readers.whole_files(spark, str(folder)).first()) == ("one", "whole\ntext")


def test_stream_counts_like_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, lines in enumerate(("a\tone two one\n", "b\ttwo\nno tab\n")):
        (tmp_path / f"in/{k}.txt").write_text(lines)
    for _ in range(2):
        append_counts(stream_texts(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("filename", "word", "count").collect()
    assert sorted(map(tuple, got)) == [("a", "one", 2), ("a", "two", 1), ("b", "two", 1)]
    (tmp_path / "more").mkdir()
    (tmp_path / "more/0.txt").write_text("c\tthree\n")
    append_counts(stream_texts(spark, str(tmp_path / "more")), str(tmp_path / "out"), str(tmp_path / "check2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_http(lazy):
    server = serve(Engine(lazy), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/?" + urllib.request.quote(json.dumps({"database": "fed", "groups": [], "counttype": "TextCount"}))
        with urllib.request.urlopen(url, timeout=60) as r:
            assert json.load(r) == {"status": "success", "data": [4]} and r.headers["Access-Control-Allow-Origin"] == "*"
    finally:
        server.shutdown()


def test_accents(spark):
    assert spark.range(1).select(fold_accents(F.lit("ÉàÜñ"))).first()[0] == "eaun"


@given(st.lists(st.sampled_from(["a", "b", "y", "l", "s", "bl", "at", "iz", "ed", "ing", "eed", "sses", "ies", "'s", "é", "K", *_STEP2, *_STEP3, *_STEP4]), max_size=6).map("".join))
@settings(max_examples=3000, deadline=None)
def test_words_begin_as_their_stems_do(word):
    assert word.lower().startswith(beginning(porter(word)))


def test_stems_are_counted_within_a_row(lazy, spark):
    docs = spark.createDataFrame([("a", "Being bees be's BE been, the being"), ("b", ""), ("c", None), ("a", "beings"), ("d", "e b")], "bookid string, _text string")
    source = TextWords()
    for terms in ([["being"]], [["being"], ["bee"]], [["The", "bes"]], [["w" * 31]]):
        n = len(terms[0])
        parts = [F.col(p) for p in (["word"] if n == 1 else ["word1", "word2"])]
        want = source.words(docs, n).where(phrase_test(parts, terms, "stem")).groupBy("bookid").agg(F.sum(HITS)).collect()
        got = source.hits(docs, terms, "stem").groupBy("bookid").agg(F.sum(HITS).alias("n")).where("n > 0").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and (want or len(terms[0][0]) == 31)
    plan = Engine(lazy).frame({"database": "fed", "search_limits": {"word": ["being"]}, "words_collation": "stem", "groups": ["author"], "counttype": "WordCount"})._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and plan.count("regexp_extract_all") == 1


def test_porter_takes_words_of_any_length():
    assert porter("y" * 100_001 + "ed") == "y" * 99_999 + "i" and porter("yyyyyed") == "yyyi" and porter("a" * 100_000 + "ing") == "a" * 100_000
    assert porter("syzygy") == "syzygi" and porter("yes") == "ye" and porter("toying") == "toi" and porter("boyish") == "boyish"


@given(st.lists(st.text(st.sampled_from("abgmrst'’.#$0129 _é\u0301ıİſﬀᏣ١\n-,") | st.sampled_from("abc 1.'s#"), max_size=40), min_size=1, max_size=40))
@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_fast_pattern_is_the_same_language(spark, texts):
    df = spark.createDataFrame([(t,) for t in [*texts, "3rd's Mr. st. a# ab# $4.50 x's 1'2 don't etc.", "mr", "12.5.6"]], "t string")
    both = df.select(tokens(F.col("t")).alias("a"), F.regexp_extract_all("t", F.lit(PATTERN), F.lit(0)).alias("b"))
    assert both.where("a != b").count() == 0


def test_counts_within_a_row(spark):
    texts = [("a", "x y x y x"), ("b", ""), ("c", None), ("d", "one"), ("e", ": 1: 11:1 : 1:1"), ("a", "y y")]
    docs = spark.createDataFrame(texts, "bookid string, _text string")
    source = TextWords()
    for n, names in ((1, ["word"]), (2, ["word1", "word2"])):
        got = source.counted(docs, n).groupBy("bookid", *names).agg(F.sum("_hits").alias("n"))
        want = source.words(docs, n).groupBy("bookid", *names).agg(F.count("*").alias("n"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_grams_are_counted_in_batches(spark, n):
    rows = spark.createDataFrame([(list("abcabcab"),), (list("abc"),), (["a"],), ([],), (None,), (["b"],), (["é", " x", "é", " x", "é"],), (list("cab"),)], "_tokens array<string>").coalesce(1)
    want = Counter(r[0] for r in rows.where("_tokens is not null").select(F.explode(ngrams(F.col("_tokens"), n))).collect())
    assert {r.gram: r["count"] for r in gram_counts(rows, n).collect()} == want
    plan = queries.QUERIES["ngrams_trigram_counts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan


def test_both_sides_are_one_pass(lazy):
    q = {"database": "fed", "search_limits": {"word": ["the"], "*author": "hamilton"}, "groups": ["number"], "counttype": ["WordsPerMillion", "TextPercent"]}
    df = Engine(lazy).frame(q)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("regexp_extract_all") == 1 and plan.count("Scan") == 1 and "Join" not in plan


def test_search_over_several_limits(engine):
    limits = [{"word": ["cat"]}, {"word": ["absent"]}, {"author": "madison", "word": ["dog"]}]
    assert ask(engine, method="search", search_limits=limits) == [["b", "a"], ["<empty results>"], ["b"]]


def test_hasword_beside_a_comparison(engine):
    got = ask(engine, search_limits={"word": ["the"], "hasword": ["dog"]}, groups=["author"], counttype=["WordCount", "TextCount", "TotalTexts"])
    assert got == {"hamilton": [3, 1, 1], "madison": [1, 1, 1]}


def test_a_build_goes_on_where_it_stopped(lazy, tmp_path):
    path = str(tmp_path / "c")
    lazy.build(path)
    for gone in ("bigrams", "catalog", "fields"):
        shutil.rmtree(f"{path}/{gone}")
    before = (tmp_path / "c/unigrams/_SUCCESS").stat().st_mtime_ns
    again = lazy.build(path, resume=True)
    assert (tmp_path / "c/unigrams/_SUCCESS").stat().st_mtime_ns == before and ask(Engine(again), search_limits={"word": ["the mat"]}) == [1]
    other = lazy.build(path, vocabulary_size=3, resume=True)  # another corpus: nothing is kept
    assert other.vocabulary.count() == 3 and (tmp_path / "c/unigrams/_SUCCESS").stat().st_mtime_ns != before


def test_facts_can_be_built_one_kind_after_the_other(lazy, tmp_path):
    path = str(tmp_path / "c")
    words = Engine(lazy.build(path, kinds=(1,)))
    assert ask(words, search_limits={"word": ["the"]}) == [5]
    assert words.query({"database": "fed", "groups": [], "counttype": "WordCount", "search_limits": {"word": ["the mat"]}})["status"] == "error"
    both = Engine(lazy.build(path, resume=True))
    assert ask(both, search_limits={"word": ["The Mat"]}) == [1] and ask(both, search_limits={"word": ["the"]}) == [5]
    pairs = lazy.build(str(tmp_path / "p"), kinds=(2,))
    assert ask(Engine(pairs), search_limits={"word": ["the mat", "the absent"]}) == [1] and pairs.vocabulary is None
    assert sorted(map(tuple, pairs.catalog.select("bookid", "nwords").collect())) == sorted(map(tuple, both.corpora["fed"].catalog.select("bookid", "nwords").collect()))


def test_the_vocabulary_is_built_when_asked_for(lazy, tmp_path):
    """the facts of words were built with ranks and stems of all words, which no query by words reads."""
    path = str(tmp_path / "c")
    words = lazy.build(path, kinds=(1,))
    assert words.vocabulary is None and ask(Engine(words), search_limits={"word": ["the"]}) == [5]
    before = (tmp_path / "c/unigrams/_SUCCESS").stat().st_mtime_ns
    named = lazy.build(path, resume=True, kinds=(0,))
    assert (tmp_path / "c/unigrams/_SUCCESS").stat().st_mtime_ns == before and named.source.bigrams is None
    assert {r.word: r["count"] for r in named.vocabulary.collect()} == {r.word: r.n for r in named.source.unigrams.groupBy("word").agg(F.sum("count").alias("n")).collect()}
    assert lazy.build(str(tmp_path / "v"), kinds=(0,)).vocabulary.count() == named.vocabulary.count()


@pytest.mark.parametrize("n", [1, 2])
@pytest.mark.parametrize("key", ["string", "bigint"])
def test_lists_of_documents_hold_what_rows_hold(spark, n, key):
    """a build shuffled a row for each word of each document."""
    texts = ["x y x y x", "y", "", None, ": 1: 11:1 : 1:1 x", "y y x", "é É x y", "x"]
    docs = spark.createDataFrame([(k if k != 5 else 0, t) for k, t in enumerate(texts)] + [(None, "x y")], "k int, t string").coalesce(1)
    rows = docs.select(F.col("k").cast(key).alias("bookid"), F.split("t", " ").alias("_tokens"))
    words = ["word"] if n == 1 else ["word1", "word2"]
    lists = listed_runs(rows, n)
    assert lists.count() == lists.select(*words).distinct().count() > 0
    got = lists.select(*words, F.explode(F.arrays_zip("ids", "n")).alias("e")).select("e.ids", *words, "e.n")
    want = runs(rows, ["bookid"], n).select("bookid", *words, HITS)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    assert listed_runs(rows.where("bookid = 99"), n).count() == 0


def test_a_build_keeps_all_words(spark, tmp_path, monkeypatch):
    """The vocabulary was cut at 1,500,000 words unless a build asked for another cut."""
    assert inspect.signature(Corpus.build).parameters["vocabulary_size"].default is None
    monkeypatch.setattr("wordloom.plans.corpus.ONE_PLACE", 10)  # ranks by cells
    docs = spark.createDataFrame([("a", " ".join(f"w{k} " * (1 + k % 3) for k in range(500)))], "filename string, text string")
    corpus = Corpus.from_documents("x", docs, [])
    found = sorted(((f"w{k}", 1 + k % 3) for k in range(500)), key=lambda x: (-x[1], x[0]))
    whole = corpus.build(str(tmp_path / "x"))
    assert [(r.wordid, r.word, r["count"]) for r in whole.vocabulary.orderBy("wordid").collect()] == [(k, *x) for k, x in enumerate(found)]
    some = corpus.build(str(tmp_path / "y"), 20)
    assert [(r.wordid, r.word) for r in some.vocabulary.orderBy("wordid").collect()] == [(k, w) for k, (w, _) in enumerate(found[:20])]
    assert some.catalog.first().nwords == sum(n for _, n in found[:20])


def test_long_words_stay_out_of_a_built_corpus(spark, tmp_path):
    long = "w" * 31
    docs = spark.createDataFrame([("a", f"one {long} two one"), ("b", long)], "filename string, text string")
    built = Corpus.from_documents("x", docs, []).build(str(tmp_path / "x"))
    assert sorted(map(tuple, built.source.unigrams.select("bookid", "word", "count").collect())) == [("a", "one", 2), ("a", "two", 1)]
    assert [(r.word1, r.word2) for r in built.source.bigrams.collect()] == [("two", "one")]
    assert {r.bookid: r.nwords for r in built.catalog.collect()} == {"a": 3, "b": 0}


def test_corpus_from_counts(spark):
    docs = spark.createDataFrame([("a", "x"), ("b", None), ("c", "x")], "filename string, author string")
    counts = spark.createDataFrame([("a", "The", 2), ("a", "The", 1), ("b", "the", 5), ("b", None, 9), ("zz", "the", 7), ("b", "no", 0)], "filename string, word string, count int")
    pairs = spark.createDataFrame([("a", "of", "the", 4)], "filename string, word1 string, word2 string, count int")
    one = Engine(Corpus.from_counts("fed", counts, docs, [Field("author")], pairs=pairs))
    assert ask(one, search_limits={"word": ["the"]}, groups=["author"], counttype=["WordCount", "TextCount", "TotalTexts"]) == {"": [5, 1, 1], "x": [3, 1, 2]}
    assert ask(one, search_limits={"word": ["of the"]}) == [4]
    assert ask(Engine(Corpus.from_counts("fed", counts, docs, [Field("author")])), search_limits={"word": ["of the"]}) == [None]


def test_ranks_in_cells(spark):
    rows = [("b", 2), ("a", 2), ("c", 9), ("ab", 2), ("", 2), ("a", 1), ("é", 2), ("abc", 1)]
    got = {(r.value, r["count"]): r.place for r in ranked(spark.createDataFrame(rows, "value string, count bigint"), "value", "place").collect()}
    assert got == {k: i for i, k in enumerate(sorted(rows, key=lambda x: (-x[1], x[0].encode())), 1)}


def test_metadata_of_new_values_replaces_the_table(lazy, spark, tmp_path):
    path = str(tmp_path / "c")
    lazy.build(path)
    for letter in ("A", "B"):
        corpus = Corpus.open(spark, path)
        more = corpus.add_metadata(spark.createDataFrame([("1", letter)], "number string, mark string"), "number")
        more.save_tables(path, [t for t, df in more.tables.items() if corpus.tables.get(t) is not df])
        assert ask(Engine(Corpus.open(spark, path)), groups=["mark"], counttype="TextCount") == {letter: [1]}
    assert ask(Engine(Corpus.open(spark, path)), groups=["tags"], counttype="TextCount") == {"x": [2], "y": [2]}


def test_pairs_are_built_without_a_shuffle(lazy, spark, tmp_path, monkeypatch):
    """all texts were cut by a regular expression, their tokens written, and a row for each pair of each document shuffled."""
    def cut_by_java(*_):
        raise AssertionError

    monkeypatch.setattr("wordloom.plans.corpus.tokens", cut_by_java)
    path = tmp_path / "p"
    pairs = lazy.build(str(path), kinds=(2,))
    assert not (path / "tokens").exists() and ask(Engine(pairs), search_limits={"word": ["The Mat", "the absent"]}) == [1]
    for file in (path / "bigrams").glob("*.parquet"):
        codes = [r.code for r in spark.read.parquet(str(file)).collect()]
        assert codes == sorted(codes)
    native = pairs.source.bigrams.select("code", folded(2).alias("again"), "word1", "word2").collect()
    assert native and all(r.code == r.again == pair_code(r.word1, r.word2) for r in native)
    old = TableWords(None, pairs.source.bigrams.withColumn("folded", pair_hash(F.col("word1"), F.col("word2"))).drop("code"))  # as builds wrote them before
    assert old.hits(pairs.catalog, [["the", "mat"]], "Case_Insensitive").count() == 1


def test_parts_of_texts_are_joined_and_cut_by_size():
    rows = [pa.RecordBatch.from_arrays([pa.array(x, pa.string())], ["t"]) for x in (["aaa", None, "b" * 50, "", "cc"], [], ["d"], [""], ["e" * 9, "ff", None])]
    parts = list(cut.pieces(rows, 10))
    assert [x for p in parts for x in p.column(0).to_pylist()] == [x for b in rows for x in b.column(0).to_pylist()]
    assert all(len(p) and (p.num_rows == 1 or sum(len(x or "") for x in p.column(0).to_pylist()) <= 10) for p in parts) and len(parts) == 5
    assert list(cut.pieces([])) == []


@pytest.mark.parametrize("groups", [["bigram", "author"], ["author", "unigram"], ["bigram2", "bigram1"]])
def test_groups_are_counted_before_the_shuffle(lazy, groups, monkeypatch):
    """a row for each pair of each document went through a hash table of all of a task's pairs."""
    def rows_of_documents(*_):
        raise AssertionError

    q = {"groups": groups, "counttype": ["WordCount", "TextCount"]}
    docs = lazy.catalog.select("author", "_text").collect()
    want = defaultdict(lambda: [0, 0])
    for author, text in docs:
        toks = cut.cut(pa.array([text]), cut.unpacked(cut.kinds(lazy.spark))).values.to_pylist()
        named = [{"author": author, "unigram": t} for t in toks] if "unigram" in groups else [{"author": author, "bigram": f"{a} {b}", "bigram1": a, "bigram2": b} for a, b in pairwise(toks)]
        for key, n in Counter(tuple(x[g] for g in groups) for x in named).items():
            want[key][0] += n
            want[key][1] += 1
    monkeypatch.setattr(TextWords, "counted", rows_of_documents)
    for rows in (1, 1 << 22):
        monkeypatch.setattr("wordloom.plans.corpus.PIECE", rows)
        got = Engine(lazy).frame({"database": "fed"} | q).collect()
        assert {tuple(r[g] for g in groups): [r.WordCount, r.TextCount] for r in got} == want and len(got) == len(want)


def test_texts_are_cut_as_by_the_pattern(spark):
    """F16: nearly all of tokens_bigram_counts was a regular expression at each token."""
    some = ["'s", "'S", "s", "'", ".", "$", "#", "1", "12", "٣", "a", "k", "mr", "Prof", "etc", "_", "é", "\xa0", "　", " ", "\n", "—", "日本", "😀", "𐐀", "́", "ſ", "K", "�", "Ᲊ", "𝟘", "1.2", "$1"]
    draw = random.Random(7)
    texts = ["".join(draw.choice(some) for _ in range(draw.randint(0, 14))) for _ in range(4000)] + ["", None, " ", "1.2.3.4's", "$12's $12a's it's's's 1's1.1 a's1.1.2", *("".join(map(chr, range(k, k + 64))) for k in range(0, 0x3000, 64))]
    want = spark.createDataFrame([(x,) for x in texts], "t string").select("t", tokens(F.col("t")).alias("w")).collect()
    got = cut.cut(pa.array([r.t for r in want], pa.string()), cut.unpacked(cut.kinds(spark)))
    assert got.to_pylist() == [r.w for r in want]
    broken = pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(np.array([0, 4], np.int32)), pa.py_buffer(b"a\xff b")])
    assert cut.cut(broken, cut.unpacked(cut.kinds(spark))).to_pylist() == [["a", "�", "b"]]
    assert "regexp_extract_all" not in queries.QUERIES["tokens_bigram_counts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["tokens_unigram_counts", "tokens_bigram_counts"])
def test_counted_rows_go_out_as_they_come(spark, sf, name):
    """F16: each row was copied once more to rename its count."""
    df = queries.QUERIES[name](spark, sf)
    assert df.columns[-1] == "count" and df._jdf.queryExecution().optimizedPlan().nodeName() == "MapInArrow"


@pytest.mark.parametrize("words", [50, 70_000])
@pytest.mark.parametrize("apart", [True, False])
def test_runs_are_counted_by_one_sort_of_numbers(words, apart, monkeypatch):
    """F16: runs were sorted by a permutation that three arrays then followed; what is over 63 bits still is."""
    sorts = []
    for what in ("argsort", "lexsort"):
        monkeypatch.setattr(np, what, lambda *a, f=getattr(np, what), **k: sorts.append(a) or f(*a, **k))
    draw = random.Random(words)
    texts = [[f"w{draw.randrange(words)}" for _ in range(draw.choice((0, 1, 2, 3, 60)))] for _ in range(9000 if words > 50 else 300)]
    for size in (1, 2, 3):
        length, found, at, n = _distinct(pa.array(texts, pa.list_(pa.string())), size, apart)
        start, flat = np.cumsum(length) - length, [w for t in texts for w in t]
        got = [(int(d) if apart else 0, tuple(flat[i : i + size])) for d, i in zip(found, at, strict=True)]
        assert dict(zip(got, n.tolist(), strict=True)) == Counter((k if apart else 0, tuple(t[i : i + size])) for k, t in enumerate(texts) for i in range(len(t) - size + 1))
        assert len(set(got)) == len(got) and (at >= start[found]).all() and (at + size <= (start + length)[found]).all()
    assert bool(sorts) == (words > 50)

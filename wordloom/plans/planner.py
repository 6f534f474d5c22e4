"""From a QuerySpec to one DataFrame.

What Catalyst can't know is decided here: without a word limit the per-document word counts are read, not the words; only
tables that a group or filter needs are joined; filters on the catalog are plain filters, those on other tables semi-joins;
over texts a numerator and a denominator with the same groups are sums of one pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.errors import QueryError
from wordloom.functions.statistics import COUNT_TYPES, TX, TY, WX, WY
from wordloom.operators.predicates import WORD_KEYS, names, predicate
from wordloom.plans.corpus import DOCS, HITS, STEMMED, TOKENS, Corpus, TextWords, phrase_test
from wordloom.plans.fields import join_path
from wordloom.plans.spec import WORD_GROUPS, QuerySpec, Side, phrases

TOP = 100


def widen(docs: DataFrame, corpus: Corpus, wanted: list[str]) -> tuple[DataFrame, bool]:
    """docs joined with the tables that hold the wanted fields; whether a document may now have several rows."""
    joined: set[str] = set()
    several = False
    for name in wanted:
        for f in join_path(corpus.fields, name):
            if f.table not in joined:
                joined.add(f.table)
                several = True
                table = corpus.tables[f.table]
                clash = [c for c in table.columns if c != f.anchor and c in docs.columns]
                docs = docs.join(table.drop(*clash), f.anchor)
    return docs, several


def documents(corpus: Corpus, limits: dict, collation: str) -> DataFrame:
    """The catalog's rows that meet the limits on fields and hasword; word limits are not applied."""
    rest = {k: v for k, v in limits.items() if k not in WORD_KEYS and k != "hasword"}
    used = names({k: v for k, v in rest.items() if v != []})
    numeric = {n: corpus.is_number(n) for n in corpus.fields}
    docs = corpus.catalog
    test = predicate(rest, numeric)
    if all(corpus.fields[n].table == "catalog" for n in used):
        docs = docs.where(test)
    else:
        wide, _ = widen(docs.select("bookid", *[n for n in corpus.fields if n in docs.columns]), corpus, sorted(used))
        docs = docs.join(wide.where(test).select("bookid"), "bookid", "left_semi")
    has = limits.get("hasword", [])
    for word in has if isinstance(has, list) else [has]:
        docs = corpus.source.hits(docs, phrases({"word": word}), collation).where(F.col(HITS) > 0).drop(HITS, TOKENS)
    return docs


def population(corpus: Corpus, side: Side, collation: str, words: str, texts: str) -> DataFrame:
    """Counts of one side by its groups, in columns named words and texts."""
    word_groups = [g for g in side.groups if g in WORD_GROUPS]
    fields = [g for g in side.groups if g not in WORD_GROUPS]
    sizes = {WORD_GROUPS[g] for g in word_groups}
    if len(sizes) > 1:
        raise QueryError("single words and pairs can't be grouped together")
    for g in fields:
        if g not in corpus.fields:
            raise QueryError(f"no field {g}")
    docs = documents(corpus, side.limits, collation)
    terms = phrases(side.limits)
    keep = [c for c in docs.columns if c in ("bookid", "nwords", "_text", *[f.name for n in fields for f in join_path(corpus.fields, n)], *[f.anchor for n in fields for f in join_path(corpus.fields, n)], *fields)]
    docs = docs.select(*keep)
    if word_groups:
        n = sizes.pop()
        if terms and len(terms[0]) != n:
            raise QueryError("words and word groups differ in length")
        parts = ["word"] if n == 1 else ["word1", "word2"]
        whole = n == 1 or "bigram" in word_groups or len(word_groups) == 2  # a document's rows are in different groups
        some = corpus.source.grouped(docs, n, fields) if whole and isinstance(corpus.source, TextWords) and all(corpus.fields[f].table == "catalog" for f in fields) else None
        wide, several = (some, False) if some is not None else widen(corpus.source.counted(docs.drop("nwords"), n), corpus, fields)
        if terms:
            wide = wide.where(phrase_test([F.col(p) for p in parts], terms, collation))
        label = {"unigram": F.col("word"), "word": F.col("word")} if n == 1 else {"bigram": F.concat_ws(" ", "word1", "word2"), "bigram1": F.col("word1"), "bigram2": F.col("word2")}
        by = [label[g].alias(g) if g in WORD_GROUPS else F.col(f"`{g}`") for g in side.groups]
        if some is not None:
            rows = wide.select(*by, HITS, DOCS)
            if n == 2:  # nearly all are different, so grouping before the shuffle gains nothing
                rows = rows.repartition(*[F.col(f"`{g}`") for g in side.groups])
            return rows.groupBy(*[F.col(f"`{g}`") for g in side.groups]).agg(F.sum(HITS).alias(words), F.sum(DOCS).alias(texts))
        whole = whole and not several
        return wide.groupBy(*by).agg(F.sum(HITS).alias(words), (F.count("bookid") if whole else F.count_distinct("bookid")).alias(texts))
    by = [F.col(f"`{g}`") for g in fields]
    if terms:
        wide, several = widen(corpus.source.hits(docs, terms, collation).drop("_text", TOKENS), corpus, fields)
        hit = F.col(HITS) > 0
        both = wide.groupBy(*by).agg(F.sum(F.when(hit, F.col(HITS))).alias(words), (F.count_distinct(F.when(hit, F.col("bookid"))) if several else F.count_if(hit)).alias(texts))
        return both.where(F.col(texts) > 0) if by else both
    wide, _ = widen(docs, corpus, fields)
    return wide.groupBy(*by).agg(F.sum("nwords").alias(words), F.count("nwords").alias(texts))


def one_pass(corpus: Corpus, spec: QuerySpec) -> DataFrame | None:
    """Numerator and denominator as sums over the same rows, tokenised once; None where they need joins of their own."""
    sides = {WX: (TX, spec.numerator), WY: (TY, spec.denominator)}
    rest = [{k: v for k, v in s.limits.items() if k not in WORD_KEYS and k != "hasword" and v != []} for _, s in sides.values()]
    used = {*spec.groups, *names(rest[0]), *names(rest[1])}
    if not isinstance(corpus.source, TextWords) or spec.collation in STEMMED or set(spec.denominator.groups) != set(spec.groups):
        return None
    if any(n not in corpus.fields or corpus.fields[n].table != "catalog" for n in used):
        return None
    numeric = {n: corpus.is_number(n) for n in corpus.fields}
    tests = [F.coalesce(predicate(x, numeric), F.lit(False)) for x in rest]
    docs = corpus.catalog.where(tests[0] if rest[0] == rest[1] else tests[0] | tests[1])
    columns = {}
    for (words, (_, side)), test in zip(sides.items(), tests, strict=True):
        has = side.limits.get("hasword", [])
        for word in has if isinstance(has, list) else [has]:
            test = test & (corpus.source.count(phrases({"word": word}), spec.collation) > 0)
        terms = phrases(side.limits)
        columns[f"{words}_n"] = F.when(test, corpus.source.count(terms, spec.collation) if terms else F.col("nwords"))
        columns[f"{words}_in"] = (F.col(f"{words}_n") > 0) if terms else F.col(f"{words}_n").isNotNull()
    keep = docs.select(*[F.col(f"`{n}`") for n in sorted(used)], "_text")
    rows = corpus.source.tokenised(keep)
    for name, column in columns.items():
        rows = rows.withColumn(name, column)
    out = [x for words, (texts, _) in sides.items() for x in (F.sum(F.when(F.col(f"{words}_in"), F.col(f"{words}_n"))).alias(words), F.count_if(F.col(f"{words}_in")).alias(texts))]
    both = rows.groupBy(*[F.col(f"`{g}`") for g in spec.groups]).agg(*out)
    return both.where(f"{TX} > 0 or {TY} > 0") if spec.groups else both


def compare(corpus: Corpus, spec: QuerySpec) -> DataFrame:
    """The numerator beside its denominator: matched on the groups both have, a missing side as zeros."""
    both = one_pass(corpus, spec)
    both = _two_passes(corpus, spec) if both is None else both
    return both.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in (WX, TX, WY, TY)})


def _two_passes(corpus: Corpus, spec: QuerySpec) -> DataFrame:
    x = population(corpus, spec.numerator, spec.collation, WX, TX)
    y = population(corpus, spec.denominator, spec.collation, WY, TY)
    shared = [g for g in spec.denominator.groups if g in spec.groups]
    if not shared:
        both = x.crossJoin(F.broadcast(y))  # the total stands beside every row
    else:
        other = y.select(*[F.col(f"`{g}`").alias(f"_y_{g}") if g in shared else F.col(f"`{g}`") for g in spec.denominator.groups], WY, TY)
        match: Column = reduce(lambda a, b: a & b, [x[g].eqNullSafe(other[f"_y_{g}"]) for g in shared])
        both = x.join(other, match, "full_outer")
        both = both.select(*[F.coalesce(F.col(f"`{g}`"), F.col(f"`_y_{g}`")).alias(g) if g in shared else F.col(f"`{g}`") for g in spec.groups], WX, TX, WY, TY)
    return both


def data(corpus: Corpus, spec: QuerySpec) -> DataFrame:
    """Groups, then count types, in the order of the query."""
    if spec.denominator is None:
        df = population(corpus, spec.numerator, spec.collation, WX, TX)
    else:
        df = compare(corpus, spec)
    out = []
    for t in spec.counttypes:
        df, column = COUNT_TYPES[t].column(df, list(spec.groups))
        out.append(column.alias(t))
    return df.select(*[F.col(f"`{g}`") for g in spec.groups], *out)


def bibliography(corpus: Corpus, spec: QuerySpec, order: str = "frequency", limit: int = TOP, seed: int = 0) -> DataFrame:
    """(bookid, searchstring, score) of the documents that answer a query: those where the words are the most frequent; at
    random, each alike; or at random with a chance that grows with their count (Efraimidis and Spirakis, 2006)."""
    docs = documents(corpus, spec.numerator.limits, spec.collation)
    terms = phrases(spec.numerator.limits)
    title = F.col("searchstring") if "searchstring" in docs.columns else F.col("bookid").cast("string")
    if terms:
        docs = corpus.source.hits(docs, terms, spec.collation)
        score = F.try_divide(F.col(HITS) * F.lit(10000.0), F.col("nwords"))
        weight = F.col(HITS)
    else:
        order = "random" if order == "frequency" else order
        score, weight = F.lit(0.0), F.col("nwords")
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("bookid").cast("string"))), 1, 13), 16, 10).cast("double")  # 52 bits
    chance = F.lit(None) if order == "frequency" else (drawn + 0.5) / float(1 << 52)
    if order == "random":
        score = chance
    elif order == "weighted":
        score = F.try_divide(F.ln(chance), weight)
    elif order != "frequency":
        raise QueryError(f"no order {order}")
    found = docs.select("bookid", title.alias("searchstring"), score.alias("score"), (F.col(HITS) > 0 if terms else F.lit(True)).alias("_in"))
    found = found.select("bookid", "searchstring", F.when(F.col("_in"), F.col("score")).alias("score"), "_in")
    return found.orderBy(F.desc("_in"), F.desc_nulls_last("score"), "bookid").limit(limit).where("_in").drop("_in")

"""A query as JSON, validated and normalised; nothing of the caller's dictionary is changed."""

from __future__ import annotations

import copy
from dataclasses import dataclass

from wordloom.errors import QueryError
from wordloom.functions.statistics import ALIASES, COUNT_TYPES
from wordloom.operators.predicates import WORD_KEYS, check_keys

WORD_GROUPS = {"unigram": 1, "word": 1, "bigram": 2, "bigram1": 2, "bigram2": 2}


@dataclass(frozen=True)
class Side:
    """One population: a numerator or a denominator."""

    limits: dict
    groups: tuple[str, ...]


@dataclass(frozen=True)
class QuerySpec:
    database: str
    method: str
    format: str
    counttypes: tuple[str, ...]
    groups: tuple[str, ...]  # in the order asked for, without stars
    numerator: Side
    denominator: Side | None
    collation: str


def _as_list(value) -> list:
    return list(value) if isinstance(value, (list, tuple)) else [value]


def normalise(query: dict) -> list[QuerySpec]:
    """One spec for each object of search_limits."""
    if not isinstance(query, dict):
        raise QueryError("a query is an object")
    q = copy.deepcopy(query)
    method = q.get("method", "data")
    need = ("database",) if method in ("schema", "search", "returnPossibleFields") else ("database", "counttype", "groups")
    for key in need:
        if key not in q:
            raise QueryError(f"the query has no {key}")
    limits = q.get("search_limits") or {}
    return [_one(q, x, method) for x in (limits if isinstance(limits, list) else [limits])]


def _one(q: dict, limits: dict, method: str) -> QuerySpec:
    if not isinstance(limits, dict):
        raise QueryError("search_limits is an object or a list of objects")
    check_keys(limits)
    compare = q.get("compare_limits")
    if compare is not None:
        check_keys(compare)
    types = [ALIASES.get(t, t) for t in _as_list(q.get("counttype", "WordCount"))]
    for t in types:
        if t not in COUNT_TYPES:
            raise QueryError(f"no counttype {t}")
    groups = _as_list(q.get("groups", []))
    if not all(isinstance(g, str) for g in groups):
        raise QueryError("groups are names")
    plain = tuple(g.removeprefix("*") for g in groups)
    if len(set(plain)) < len(plain):
        raise QueryError("a group stands twice")
    top = {k.removeprefix("*"): v for k, v in limits.items()}
    numerator = Side(top, plain)
    denominator = None
    if any(COUNT_TYPES[t].compare for t in types):
        if compare is None:
            starred = any(k.startswith("*") for k in limits)
            compare = {k: v for k, v in limits.items() if not k.startswith("*")} if starred else {k: v for k, v in limits.items() if k not in WORD_KEYS}
        denominator = Side({k.removeprefix("*"): v for k, v in compare.items()}, tuple(g for g in groups if not g.startswith("*")))
    return QuerySpec(q["database"], method, q.get("format", "json"), tuple(types), plain, numerator, denominator, q.get("words_collation", "Case_Insensitive"))


def phrases(limits: dict) -> list[list[str]]:
    """The word limit as phrases of one length, 1 or 2; none if there is no word limit."""
    found = [p for k in ("word", "unigram", "bigram") for p in _as_list(limits.get(k, []))]
    if any(not isinstance(p, str) or not p.split() for p in found):
        raise QueryError("words are non-empty texts")
    out = [p.split() for p in found]
    if len({len(p) for p in out}) > 1:
        raise QueryError("all phrases of a query must have the same number of words")
    if out and len(out[0]) > 2:
        raise QueryError("phrases of more than two words are not indexed")
    return out

"""search_limits as a Spark predicate."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordloom.errors import QueryError

KEY = re.compile(r"[A-Za-z_$*0-9]+")
WORD_KEYS = frozenset(("word", "unigram", "bigram"))
_COMPARE = {"$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v}


def check_keys(limits) -> None:
    """Keys at any depth must look like names."""
    if isinstance(limits, dict):
        for key, value in limits.items():
            if not isinstance(key, str) or not KEY.fullmatch(key):
                raise QueryError(f"bad key {key!r}")
            check_keys(value)
    elif isinstance(limits, list):
        for value in limits:
            check_keys(value)


def names(limits: dict) -> set[str]:
    """The fields a predicate reads."""
    out: set[str] = set()
    for key, value in limits.items():
        if key.lower() in ("$or", "$and"):
            for x in _list(value):
                out |= names(x)
        elif isinstance(value, list) and value and all(isinstance(x, dict) for x in value):
            for x in value:
                out |= names(x)
        else:
            out.add(key)
    return out


def predicate(limits: dict, numeric: dict[str, bool]) -> Column:
    """The conjunction of limits; numeric says of each known field whether it holds numbers.

    A list means any of its values, but all of them for $ne.  A number compared with a text field compares as numbers, and
    texts that aren't numbers don't match.  An empty list sets no limit, an empty object is true.
    """
    return reduce(and_, [_term(k, v, numeric) for k, v in limits.items()], F.lit(True))


def _list(value) -> list:
    out = value if isinstance(value, list) else [value]
    if not out:
        raise QueryError("an alternative of nothing")
    return out


def _term(key: str, value, numeric: dict[str, bool]) -> Column:
    if key.lower() in ("$or", "$and"):
        parts = _list(value)
        if not all(isinstance(x, dict) for x in parts):
            raise QueryError(f"{key} takes objects")
        return reduce(or_ if key.lower() == "$or" else and_, [predicate(x, numeric) for x in parts])
    if isinstance(value, list) and value and all(isinstance(x, dict) for x in value):
        return reduce(and_, [predicate(x, numeric) for x in value])
    if key in WORD_KEYS or key == "hasword":
        raise QueryError(f"{key} can only stand at the top of search_limits")
    if key not in numeric:
        raise QueryError(f"no field {key}")
    if value is None:
        raise QueryError(f"no value for {key}")
    if isinstance(value, dict):
        return reduce(and_, [_operator(key, op, v, numeric[key]) for op, v in value.items()], F.lit(True))
    return _operator(key, "$eq", value, numeric[key]) if value != [] else F.lit(True)


def _pair(key: str, value, is_number: bool) -> tuple[Column, Column]:
    """The field and the value as comparable columns."""
    field = F.col(f"`{key}`")
    if isinstance(value, bool) or not isinstance(value, (str, int, float)):
        raise QueryError(f"bad value for {key}: {value!r}")
    if isinstance(value, str):
        return (field, F.lit(value).try_cast("double")) if is_number else (field, F.lit(value))
    return (field if is_number else field.try_cast("double")), F.lit(value)


def _operator(key: str, op: str, value, is_number: bool) -> Column:
    values = _list(value)
    if op == "$eq":
        return reduce(or_, [a == b for a, b in (_pair(key, v, is_number) for v in values)])
    if op == "$ne":
        return reduce(and_, [a != b for a, b in (_pair(key, v, is_number) for v in values)])
    if op in _COMPARE:
        return reduce(or_, [_COMPARE[op](*_pair(key, v, is_number)) for v in values])
    if op == "$grep":
        return reduce(or_, [F.col(f"`{key}`").cast("string").rlike(f"(?i){v}") for v in values])
    raise QueryError(f"no operator {op}")

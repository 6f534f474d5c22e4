"""Porter's stemmer (M. F. Porter, An algorithm for suffix stripping, 1980), applied to a vocabulary, not to a text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


_ENDS2, _ENDS3, _ENDS4 = (sorted(x, key=len, reverse=True) for x in (_STEP2, _STEP3, _STEP4))


def _form(word: str) -> str:
    """c for each consonant, v for each vowel; y is a vowel after a consonant."""
    out = []
    for letter in word:
        vowel = letter in "aeiou" or (letter == "y" and bool(out) and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(word: str) -> int:
    return _form(word).count("vc")


def _short_end(word: str) -> bool:
    return len(word) > 2 and _form(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _form(word)[-1] == "c"


def _replace(word: str, ends: list[str], table: dict[str, str]) -> str:
    for end in ends:
        if word.endswith(end):
            stem = word[: -len(end)]
            return stem + table[end] if _measure(stem) > 0 else word
    return word


def porter(word: str) -> str:
    """The stem of an ASCII word, lower case, without a possessive; other words come back in lower case."""
    word = re.sub("'s$", "", word.lower())
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end):
                stem = word[: -len(end)]
                if "v" in _form(stem):
                    if stem.endswith(("at", "bl", "iz")) or (_measure(stem) == 1 and _short_end(stem)):
                        stem += "e"
                    elif _double(stem) and stem[-1] not in "lsz":
                        stem = stem[:-1]
                    word = stem
                break
    if word.endswith("y") and "v" in _form(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, _ENDS2, _STEP2), _ENDS3, _STEP3)
    for end in _ENDS4:
        if word.endswith(end):
            stem = word[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short_end(stem)):
            word = stem
    return word[:-1] if _measure(word) > 1 and _double(word) and word.endswith("l") else word


def beginning(stem: str) -> str:
    """What every word of a stem begins with, in lower case: steps only cut a word's end or change the last letter kept, but for biliti, which becomes ble."""
    return stem[: -2 if stem.endswith("ble") else -1]


def _stems(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else porter(w))


def stem(word: Column) -> Column:
    return F.pandas_udf(_stems, "string")(word)

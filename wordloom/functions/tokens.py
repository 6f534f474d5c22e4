"""Tokens and n-grams as Spark expressions.

The pattern is an ordered alternation; Java's and RE2's character classes are spelled out so that both read it alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTER = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"
DIGIT = r"\p{Nd}"
ABBREVIATIONS = ("mr", "ms", "mrs", "dr", "prof", "rev", "rep", "sen", "st", "sr", "jr", "ft", "gen", "adm", "lt", "col", "etc")
PATTERN = "(?i)" + "|".join((rf"\$?{DIGIT}+\.{DIGIT}+", rf"{LETTER}+'s", rf"\$?{DIGIT}+", rf"(?:{'|'.join(ABBREVIATIONS)})\.", r"[a-gjx]#", r"[^\p{L}\p{M}\p{Nd}\p{Pc}\p{Z}]", rf"{LETTER}+"))


#: the same language for Java: a word, not begun by a digit, that nothing but the last alternative can take is tried first, and is not tried at all its lengths
FAST = rf"(?i)(?!{DIGIT}){LETTER}++(?!['.#])|" + PATTERN.removeprefix("(?i)")


def tokens(text: Column, pattern: str = PATTERN) -> Column:
    """Tokens of a text: decimals, possessives, numbers, abbreviations, sharps, single punctuation marks, words; none for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(FAST if pattern == PATTERN else pattern), F.lit(0)), F.array().cast("array<string>"))


def ngrams(words: Column, n: int) -> Column:
    """All runs of n tokens, joined by one space, in order; they cross punctuation."""
    if n == 1:
        return words
    size = F.greatest(F.size(words) - (n - 1), F.lit(0))
    out = F.slice(words, F.lit(1), size)
    for k in range(2, n + 1):
        out = F.zip_with(out, F.slice(words, F.lit(k), size), lambda a, b: F.concat_ws(" ", a, b))
    return out


def all_grams(words: Column, most: int) -> Column:
    """Runs of 1 to most tokens."""
    return F.concat(*[ngrams(words, n) for n in range(1, most + 1)])


def gram_count(words: Column, most: int) -> Column:
    """How many runs all_grams gives, from the number of tokens: none is made."""
    size = F.size(words)
    return sum((F.greatest(size - (n - 1), F.lit(0)) for n in range(2, most + 1)), size)


def bigrams(words: Column) -> Column:
    """Pairs of neighbouring tokens as structs (word1, word2)."""
    size = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), size), F.slice(words, F.lit(2), size), lambda a, b: F.struct(a.alias("word1"), b.alias("word2")))


def fold_accents(word: Column) -> Column:
    """Lower case without the accents of Latin letters, as accent-insensitive comparison sees a word."""
    accented = "àáâãäåāăąçćčďèéêëēėęěìíîïīįłñńňòóôõöøōőřśšşťţùúûüūůűųýÿźżž"
    plain = "aaaaaaaaacccdeeeeeeeeiiiiiilnnnoooooooorsssttuuuuuuuuyyzzz"
    return F.translate(F.lower(word), accented, plain)

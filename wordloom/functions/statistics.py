"""Count types: column formulas over a numerator's and a denominator's word and text counts.

Zero over zero is 0, anything else over zero is null; the logarithm of zero is null.  All formulas read the untouched
counts, so the order of count types in a query doesn't matter.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WX, TX, WY, TY = "_wx", "_tx", "_wy", "_ty"


def ratio(a: Column, b: Column) -> Column:
    return F.when((a == 0) & (b == 0), F.lit(0.0)).otherwise(F.try_divide(a.cast("double"), b))


@dataclass(frozen=True)
class CountType:
    """compare: whether it needs the denominator; column: the formula, given (frame, groups), which returns the frame it needs and
    the column."""

    compare: bool
    column: Callable[[DataFrame, list[str]], tuple[DataFrame, Column]]


def _plain(f: Callable[[Column, Column, Column, Column], Column]) -> Callable:
    return lambda df, groups: (df, f(*[F.col(x) for x in (WX, TX, WY, TY)]))


def _totals(df: DataFrame, **aggregates: Column) -> DataFrame:
    """df with one-row aggregates of itself beside every row."""
    return df.crossJoin(F.broadcast(df.agg(*[c.alias(name) for name, c in aggregates.items()])))


def _pmi(name: str) -> Callable:
    def column(df: DataFrame, groups: list[str]) -> tuple[DataFrame, Column]:
        total = f"{name}_total"
        out = _totals(df, **{total: F.sum(name)})
        expected = F.col(total).cast("double")
        for k, g in enumerate(groups):  # sums joined back, not windows: a group's rows may be a vocabulary
            key, value = f"{name}_g{k}", f"{name}_s{k}"
            part = df.groupBy(F.col(f"`{g}`").alias(key)).agg(F.sum(name).alias(value))
            out = out.join(part, F.col(f"`{g}`").eqNullSafe(F.col(key))).drop(key)
            expected = expected * (F.col(value) / F.col(total))
        return out, F.when(F.col(name) > 0, F.ln(F.col(name) / expected))

    return column


def _dunning(x: str, y: str, total: Callable[[Column], Column], tag: str) -> Callable:
    def column(df: DataFrame, groups: list[str]) -> tuple[DataFrame, Column]:
        a, b = (F.when(F.col(n) == 0, F.lit(0.5)).otherwise(F.col(n).cast("double")) for n in (x, y))
        df = _totals(df, **{f"{tag}_c": total(a), f"{tag}_d": total(b)})
        c, d = F.col(f"{tag}_c"), F.col(f"{tag}_d")
        left, right = F.ln(a / (c * (a + b) / (c + d))), F.ln(b / (d * (a + b) / (c + d)))
        g = 2 * (a * left + b * right)
        return df, F.when(left < right, -g).otherwise(g)

    return column


COUNT_TYPES: dict[str, CountType] = {
    "WordCount": CountType(False, _plain(lambda wx, tx, wy, ty: wx)),
    "TextCount": CountType(False, _plain(lambda wx, tx, wy, ty: tx)),
    "WordsPerMillion": CountType(True, _plain(lambda wx, tx, wy, ty: ratio(wx * 1000000, wy))),
    "TotalWords": CountType(True, _plain(lambda wx, tx, wy, ty: wy)),
    "TotalTexts": CountType(True, _plain(lambda wx, tx, wy, ty: ty)),
    "SumWords": CountType(True, _plain(lambda wx, tx, wy, ty: wx + wy)),
    "SumTexts": CountType(True, _plain(lambda wx, tx, wy, ty: tx + ty)),
    "WordsRatio": CountType(True, _plain(lambda wx, tx, wy, ty: ratio(wx, wy))),
    "TextPercent": CountType(True, _plain(lambda wx, tx, wy, ty: ratio(tx * 100, ty))),
    "TextRatio": CountType(True, _plain(lambda wx, tx, wy, ty: ratio(tx, ty))),
    "HitsPerText": CountType(True, _plain(lambda wx, tx, wy, ty: ratio(wx, tx))),
    "TextLength": CountType(True, _plain(lambda wx, tx, wy, ty: ratio(wy, ty))),
    "TFIDF": CountType(True, _plain(lambda wx, tx, wy, ty: F.when(tx == 0, F.lit(0.0)).otherwise(ratio(wx, wy) * F.ln(ty / tx)))),
    "PMI_words": CountType(True, _pmi(WX)),
    "PMI_texts": CountType(True, _pmi(TX)),
    "Dunning": CountType(True, _dunning(WX, WY, F.sum, "_dw")),
    "DunningTexts": CountType(True, _dunning(TX, TY, F.max, "_dt")),
}
ALIASES = {"Occurrences_per_Million_Words": "WordsPerMillion", "Raw_Counts": "WordCount", "Percentage_of_Books": "TextPercent", "Number_of_Books": "TextCount"}


def register(name: str, count_type: CountType) -> None:
    """Add a count type of one's own."""
    COUNT_TYPES[name] = count_type

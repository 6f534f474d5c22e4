"""Result formats.  A result is an aggregate, so it is small by the query's own grouping; rows are sorted by group for output."""

from __future__ import annotations

import html
import io
import math

import pandas as pd

from wordloom.errors import QueryError

FORMATS = ("json", "json_c", "csv", "tsv", "feather", "html", "pandas")


def _plain(value):
    value = value.item() if hasattr(value, "item") else value
    if value is None or value is pd.NA or isinstance(value, float) and not math.isfinite(value):
        return None
    return float(value) if type(value).__name__ == "Decimal" else value


def nested(df: pd.DataFrame, groups: list[str], counts: list[str]):
    """Nested objects by group value, in group order; leaves are lists of counts.  Without groups, the list alone."""
    rows = [[_plain(x) for x in row] for row in df[groups + counts].itertuples(index=False, name=None)]
    if not groups:
        return rows[0] if rows else []
    out: dict = {}
    for row in rows:
        at = out
        for g in row[: len(groups) - 1]:
            at = at.setdefault(str(g), {})
        at[str(row[len(groups) - 1])] = row[len(groups) :]
    return out


def run_lengths(values: list) -> list:
    """[a, [3, b], ...]: a value that stands once, or how often it stands and the value."""
    out: list = []
    last, n = None, 0
    for v in [*values, object()]:
        if n and v == last and type(v) is type(last):
            n += 1
            continue
        if n:
            out.append(last if n == 1 else [n, last])
        last, n = v, 1
    return out


def columns(df: pd.DataFrame) -> dict:
    return {c: run_lengths([_plain(x) for x in df[c]]) for c in df.columns}


def table(df: pd.DataFrame) -> str:
    """An HTML table; text is escaped but for searchstring, which is HTML itself."""
    cell = lambda c, x: "" if x is None else str(x) if c == "searchstring" else html.escape(str(x))
    head = "".join(f"<th>{html.escape(str(c))}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{cell(c, _plain(x))}</td>" for c, x in zip(df.columns, row, strict=True)) + "</tr>" for row in df.itertuples(index=False, name=None))
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def render(df: pd.DataFrame, form: str, groups: list[str], counts: list[str]):
    """A result in a format: an object for json and json_c, text for csv, tsv and html, bytes for feather."""
    if groups and len(df):
        df = df.sort_values(groups, kind="stable", key=lambda s: s if s.dtype != object else s.map(lambda x: "" if x is None else str(x))).reset_index(drop=True)
    if form == "json":
        return nested(df, groups, counts)
    if form == "json_c":
        return columns(df)
    if form in ("csv", "tsv"):
        return df.to_csv(index=False, sep="," if form == "csv" else "\t")
    if form == "feather":
        import pyarrow as pa
        from pyarrow import feather

        out = io.BytesIO()
        feather.write_feather(pa.Table.from_pandas(df, preserve_index=False), out, compression="uncompressed")
        return out.getvalue()
    if form == "html":
        return table(df)
    if form == "pandas":
        return df
    raise QueryError(f"no format {form}")

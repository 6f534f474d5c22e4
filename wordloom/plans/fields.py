"""Fields of a corpus: what they are, where they are stored, and how their tables hang together."""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from wordloom.errors import QueryError

RESERVED = frozenset(("word", "words", "nwords", "unigram", "bigram", "bookid", "wordid", "count", "hasword"))
TYPES = {"character": "string", "text": "string", "integer": "bigint", "decimal": "decimal(9,4)", "float": "float"}
INFER_ROWS = 30000


@dataclass(frozen=True)
class Field:
    """datatype: categorical, time, searchstring or etc; unique: one value a document; table 'catalog', or a table joined through anchor."""

    name: str
    datatype: str = "categorical"
    type: str = "character"
    unique: bool = True
    anchor: str = "bookid"
    table: str = "catalog"
    description: str = ""
    derived: tuple[tuple[str, str | None], ...] = ()

    @property
    def public(self) -> bool:
        return self.datatype in ("categorical", "time") or (self.datatype == "etc" and self.type != "text")


def parse_descriptions(text: str) -> list[Field]:
    """Fields from field descriptions in JSON; reserved names are left out."""
    out = []
    for x in json.loads(text):
        if x["field"].lower() in RESERVED:
            continue
        derived = tuple((d["resolution"], d.get("aggregate")) for d in x.get("derived", ()))
        kind = "character" if x.get("datatype") == "categorical" else x.get("type", "character")
        out.append(Field(x["field"], x.get("datatype", "etc"), kind, x.get("unique", True), description=x.get("description", ""), derived=derived))
    return out


def infer(rows: Iterable[dict]) -> list[Field]:
    """Fields from examples: lists make a field non-unique, date or time in a name with mostly distinct values makes it time, all else is categorical."""
    values: dict[str, Counter] = defaultdict(Counter)
    many: set[str] = set()
    for row in rows:
        for k, v in row.items():
            if isinstance(v, list):
                many.add(k)
                values[k].update(str(x) for x in v)
            elif v is not None:
                values[k][str(v)] += 1
            else:
                values[k]  # noqa: B018
    out = []
    for k, seen in values.items():
        if k.lower() in RESERVED or k == "filename":
            continue
        datatype = "categorical"
        if k == "searchstring":
            datatype = "searchstring"
        elif ("date" in k.lower() or "time" in k.lower()) and (not seen or seen.total() / len(seen) <= 2):
            datatype = "time"
        out.append(Field(k, datatype, "text" if datatype == "searchstring" else "character", k not in many))
    return out


def infer_frame(df: DataFrame, rows: int = INFER_ROWS) -> list[Field]:
    """infer() from the first rows of a DataFrame; a bounded number of rows reaches the driver."""
    return infer(r.asDict() for r in df.limit(rows).toLocalIterator())


def join_path(fields: dict[str, Field], name: str) -> list[Field]:
    """The fields whose tables lead from the catalog to the field called name, in the order of joining."""
    out: list[Field] = []
    at = name
    while True:
        if at not in fields:
            raise QueryError(f"no field {at}")
        field = fields[at]
        if field.table == "catalog":
            return out[::-1]
        if any(x.table == field.table for x in out):
            raise QueryError(f"the table of {at} hangs on itself")
        out.append(field)
        if field.anchor == "bookid":
            return out[::-1]
        at = field.anchor


def registry(spark: SparkSession, fields: dict[str, Field], database: str) -> DataFrame:
    """The public fields as rows."""
    rows = [(f.name, f.datatype, f.description or f.name, f.table, database, f.anchor) for f in sorted(fields.values(), key=lambda f: f.name) if f.public]
    return spark.createDataFrame(rows, "name string, type string, description string, tablename string, dbname string, anchor string")

"""Integer time fields derived from dates: <field>_<resolution> or <field>_<resolution>_<aggregate>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordloom.errors import QueryError

DAY_ONE = 366  # the day number of 0001-01-01


def parse_date(value: Column) -> Column:
    """A timestamp from a date, timestamp or text; missing months and days are 1; null where there is no date in it."""
    text = F.trim(value.cast("string"))
    whole = F.try_to_timestamp(text)
    parts = F.regexp_extract(text, r"^(\d{1,4})(?:-(\d{1,2}))?$", 1), F.regexp_extract(text, r"^(\d{1,4})(?:-(\d{1,2}))?$", 2)
    padded = F.concat(F.lpad(parts[0], 4, "0"), F.lit("-"), F.when(parts[1] == "", F.lit("01")).otherwise(F.lpad(parts[1], 2, "0")), F.lit("-01"))
    return F.when(parts[0] != "", F.try_to_timestamp(padded)).otherwise(whole)


def _day(d: Column) -> Column:
    return F.datediff(d, F.lit("0001-01-01").cast("date")) + DAY_ONE


def _weeks(n: Column) -> Column:
    return F.floor(n / 7).cast("int") * 7


FIELDS = {
    ("year", None): lambda t: F.year(t),
    ("month", None): lambda t: _day(F.trunc(t, "MM")),
    ("week", None): lambda t: _weeks(_day(F.to_date(t))),
    ("day", None): lambda t: _day(F.to_date(t)),
    ("day", "year"): lambda t: F.dayofyear(t),
    ("day", "month"): lambda t: F.dayofmonth(t),
    ("day", "week"): lambda t: F.dayofweek(t) - 1,
    ("month", "year"): lambda t: F.dayofyear(F.make_date(F.lit(1), F.month(t), F.lit(1))),
    ("week", "year"): lambda t: _weeks(F.dayofyear(t)),
    ("hour", "day"): lambda t: F.hour(t),
    ("minute", "day"): lambda t: F.hour(t) * 60 + F.minute(t),
}


def derive(value: Column, resolution: str, aggregate: str | None = None) -> Column:
    """The time field of a date or text, null where that holds no date."""
    if (resolution, aggregate) not in FIELDS:
        raise QueryError(f"no time field {resolution}/{aggregate}")
    return FIELDS[resolution, aggregate](parse_date(value)).cast("int")


def derived_name(field: str, resolution: str, aggregate: str | None = None) -> str:
    return "_".join(x for x in (field, resolution, aggregate) if x)

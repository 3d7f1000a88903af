"""Dates, numbers and hashes as Column expressions. What is no date or number gives null."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def strict_date(text: Column) -> Column:
    """A whole ISO date that exists."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def leading_date(text: Column) -> Column:
    """The ISO date at the start of a text."""
    return F.nullif(F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("")).try_cast("date")


def date_or_text(text: Column) -> Column:
    """The ISO date at the start of a text as text, else the text."""
    found = F.regexp_extract(F.trim(text), r"^(\d{4}-\d{2}-\d{2})", 1)
    return F.when(found != "", found).otherwise(F.trim(text))


def zoned_time(text: Column) -> Column:
    """A time with a zone; a time without one is null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}.*(?:Z|[+-]\d{2}:?\d{2})$"), text.try_cast("timestamp"))


def local_day(text: Column, zone: str) -> Column:
    """The date of an ISO time in a zone; a time without a zone counts as UTC."""
    return F.to_date(F.from_utc_timestamp(text.try_cast("timestamp"), zone))


def epoch_day(millis: Column) -> Column:
    """Epoch milliseconds to the UTC date as text; empty where it is no number."""
    return F.coalesce(F.date_format(F.timestamp_millis(millis.try_cast("long")), "yyyy-MM-dd"), F.lit(""))


def lenient_int(text: Column) -> Column:
    return F.trim(text).try_cast("int")


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def leaf_texts(json_text: Column, most_depth: int = 32) -> Column:
    """All texts in a JSON value, in order; nesting deeper than ``most_depth`` gives null."""

    def walk(v: object, depth: int, out: list[str]) -> None:
        if depth > most_depth:
            raise ValueError("too deep")
        if isinstance(v, str):
            out.append(v)
        elif isinstance(v, (list, dict)):
            for x in v.values() if isinstance(v, dict) else v:
                walk(x, depth + 1, out)

    def one(text: str | None) -> list[str] | None:
        out: list[str] = []
        try:
            walk(json.loads(text), 0, out)
        except (TypeError, ValueError, RecursionError):
            return None
        return out

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([one(t) for t in texts], dtype=object)

    return pandas_udf(run, "array<string>")(json_text)

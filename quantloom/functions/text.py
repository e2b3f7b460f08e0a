"""Text helpers: lists of stock codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_codes(text: Column) -> Column:
    """The entries of a list that commas or white space part."""
    return F.filter(F.split(text, r"[,\s]+"), lambda x: x != "")


def is_code(code: Column) -> Column:
    """Six digits."""
    return code.rlike(r"^\d{6}$")


def valid_codes(text: Column) -> Column:
    return F.array_distinct(F.filter(split_codes(text), is_code))


def iso(ts: Column) -> Column:
    """Date and time as ISO 8601 writes them, to the second."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")

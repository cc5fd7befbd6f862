"""Dates of entities and runs.  The time of an import is an argument, so that a query gives the same rows again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def created_on(given: Column, as_of: str) -> Column:
    """Date of creation: the one given, else that of the import."""
    return F.coalesce(given, F.lit(as_of).cast("timestamp")).cast("date")


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Whole seconds from start to end, null if one is missing."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.floor((micros(end) - micros(start)) / 1000000)


def iso(moment: Column) -> Column:
    """A moment as text, to the second."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")

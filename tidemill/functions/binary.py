"""Byte ranges with negative indexes and inclusive ends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bounds(length: Column, start: int, end: int) -> tuple[Column, Column]:
    """0-based first and last place of an inclusive range, negative ones from the end, clamped; empty if last < first."""
    at = lambda i: F.lit(i) if i >= 0 else F.greatest(length + i, F.lit(0)) if i == start else length + i
    return at(start), F.least(at(end) if end >= 0 else length + end, length - 1)


def slice_bytes(value: Column, start: int, end: int) -> Column:
    length = F.octet_length(value)
    first, last = bounds(length, start, end)
    size = F.greatest(last - first + 1, F.lit(0))
    return value.substr((first + 1).cast("int"), size.cast("int"))

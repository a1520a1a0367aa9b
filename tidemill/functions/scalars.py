"""Scalar rules of the dialect: arithmetic that gives NULL, truncating decimals, dates, booleans, UUIDs, coercion on write."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that a boolean column takes.
TRUE_WORDS = ("true", "t", "yes", "y", "1", "on")
FALSE_WORDS = ("false", "f", "no", "n", "0", "off", "")


def add(a: Column, b: Column) -> Column:
    return F.try_add(a, b)


def subtract(a: Column, b: Column) -> Column:
    return F.try_subtract(a, b)


def multiply(a: Column, b: Column) -> Column:
    return F.try_multiply(a, b)


def divide(a: Column, b: Column) -> Column:
    """Always a double; NULL for a zero divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def modulo(a: Column, b: Column) -> Column:
    return F.try_mod(a, b)


def dec_trunc(x: Column, precision: int, scale: int) -> Column:
    """x with `scale` digits, cut toward zero instead of rounded."""
    wide = x.cast(f"decimal(38,{min(18, scale + 8)})")
    cut = F.when(wide < 0, F.ceil(wide, F.lit(scale))).otherwise(F.floor(wide, F.lit(scale)))
    return cut.cast(f"decimal({precision},{scale})")


def avg_decimal(x: Column, scale: int) -> Column:
    """The average of decimals with six digits more, cut toward zero."""
    total, n = F.sum(x).cast(f"decimal(38,{scale})"), F.count(x)
    return dec_trunc(F.try_divide(total.cast("decimal(32,12)"), n.cast("decimal(18,0)")), 38, min(18, scale + 6))


def parse_date(x: Column) -> Column:
    return F.try_to_timestamp(x, F.lit("yyyy-MM-dd")).cast("date")


def parse_timestamp(x: Column) -> Column:
    """Naive UTC; the time may be missing, and a T may stand before it."""
    return x.try_cast("timestamp_ntz")


def parse_time(x: Column) -> Column:
    """Microseconds since midnight of HH:MM[:SS[.ffffff]]."""
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(x, r"^(\d+):(\d+)(?::(\d+))?(?:\.(\d{1,6}))?$", i), F.lit("")), F.lit("0"))
    micros = (part(1).cast("long") * 3600 + part(2).cast("long") * 60 + part(3).cast("long")) * 1_000_000 + F.rpad(part(4), 6, "0").cast("long")
    return F.when(x.rlike(r"^\d+:\d+"), micros)


def render_time(micros: Column) -> Column:
    s = F.floor(micros / 1_000_000).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s / 60).cast("long") % 60, s % 60)


def uuid_text(x: Column) -> Column:
    """The canonical form of 32 or 36 characters; NULL for anything else."""
    bare = F.lower(F.regexp_replace(x, "-", ""))
    parts = F.concat_ws("-", F.substring(bare, 1, 8), F.substring(bare, 9, 4), F.substring(bare, 13, 4), F.substring(bare, 17, 4), F.substring(bare, 21, 12))
    return F.when(bare.rlike("^[0-9a-f]{32}$"), parts)


def boolean(x: Column) -> Column:
    word = F.lower(F.trim(x.cast("string")))
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def coerce(x: Column, type_name: str) -> Column:
    """x as a column of the dialect's type takes it; NULL where it cannot."""
    name = type_name.strip().upper()
    if name.startswith(("DECIMAL", "NUMERIC", "DEC")):
        m = re.search(r"\((\d+)(?:\s*,\s*(\d+))?\)", name)
        p, s = (int(m[1]), int(m[2] or 0)) if m else (10, 0)
        return dec_trunc(x.try_cast(f"decimal(38,{min(18, s + 8)})"), p, s)
    if name in ("BOOLEAN", "BOOL"):
        return boolean(x)
    if name == "DATE":
        return parse_date(x.cast("string"))
    if name == "TIME":
        return parse_time(x.cast("string"))
    if name in ("TIMESTAMP", "TIMESTAMPTZ", "DATETIME"):
        return parse_timestamp(x.cast("string"))
    if name == "UUID":
        return uuid_text(x.cast("string"))
    if name in ("DOUBLE", "FLOAT", "REAL", "DOUBLE PRECISION"):
        return x.try_cast("double")
    if name in ("INT", "BIGINT", "INTEGER", "SMALLINT", "SERIAL", "BIGSERIAL", "SMALLSERIAL"):
        return x.try_cast("bigint")
    if name in ("BLOB", "BYTES", "BYTEA"):
        return x.cast("binary")
    return x.cast("string")

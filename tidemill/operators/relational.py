"""Relational helpers whose defaults differ between engines: null order, two-valued NOT, limits, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Result rows, join sides and groups that the compatible limits allow.
LIMITS = {"rows": 262_144, "groups": 65_536}


class LimitExceeded(RuntimeError):
    """More rows or groups than the compatible limits allow."""


def order_by(df: DataFrame, keys: list[tuple[str, str]], nulls_least: bool = False) -> DataFrame:
    """Ascending keys have nulls last and descending ones first, as a plain SELECT; nulls_least: the other way, as aggregates and joins."""
    cols = []
    for name, direction in keys:
        c, up = F.col(name), direction.lower() == "asc"
        cols.append((c.asc_nulls_first() if nulls_least else c.asc_nulls_last()) if up else (c.desc_nulls_last() if nulls_least else c.desc_nulls_first()))
    return df.orderBy(*cols)


def negate(pred: Column, two_valued: bool = False) -> Column:
    """NOT; two_valued: an unknown predicate counts as false before it is negated."""
    return ~F.coalesce(pred, F.lit(False)) if two_valued else ~pred


def limited(df: DataFrame, kind: str = "rows") -> DataFrame:
    """df, unless it has more rows than the compatible limits allow."""
    most = LIMITS[kind]
    if df.limit(most + 1).count() > most:
        raise LimitExceeded(f"more than {most} {kind}")
    return df


def column_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rows, approx_distinct, min, max), in one pass."""
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(columns):
        aggs += [F.approx_count_distinct(c).alias(f"d{i}"), F.min(c).cast("string").alias(f"a{i}"), F.max(c).cast("string").alias(f"b{i}")]
    one = df.agg(*aggs)
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.col("rows"), F.col(f"d{i}").alias("approx_distinct"), F.col(f"a{i}").alias("min"), F.col(f"b{i}").alias("max")) for i, c in enumerate(columns)))
    return one.select(F.inline(each))

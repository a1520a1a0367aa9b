"""Key-value tables (key, value) as DataFrames: reads are filters and joins, writes are plans that give the next table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions import binary


def scan(kv: DataFrame, start: str | None = None, end: str | None = None, prefix: str | None = None, limit: int | None = None) -> DataFrame:
    """Keys in [start, end) with the prefix, in order if there is a limit."""
    out = kv
    if start is not None:
        out = out.where(F.col("key") >= start)
    if end is not None:
        out = out.where(F.col("key") < end)
    if prefix:
        out = out.where(F.col("key").startswith(prefix))
    return out.orderBy("key").limit(limit) if limit is not None else out


def get_many(kv: DataFrame, keys: DataFrame) -> DataFrame:
    """keys (ordinal, key) with their values; a missing key keeps its place with a null."""
    return keys.join(kv, "key", "left").select("ordinal", "key", "value")


def exists(kv: DataFrame, keys: DataFrame) -> DataFrame:
    """The number of asked keys that are there; a key asked twice counts twice."""
    return keys.join(kv.select("key"), "key", "left_semi").agg(F.count("*").alias("n"))


def put(kv: DataFrame, writes: DataFrame, mode: str = "always") -> DataFrame:
    """kv after writes (key, value[, seq]); the last write of a key wins. mode: always, or absent (only keys that are not there)."""
    if "seq" in writes.columns:
        writes = writes.groupBy("key").agg(F.max_by("value", "seq").alias("value"))
    if mode == "absent":
        return kv.unionByName(writes.join(kv.select("key"), "key", "left_anti"))
    return kv.join(writes.select("key"), "key", "left_anti").unionByName(writes)


def put_all_or_none(kv: DataFrame, writes: DataFrame) -> DataFrame:
    """kv after writes if none of their keys is there, else kv: the number of keys already there is joined in as one row."""
    there = writes.join(kv.select("key"), "key", "left_semi").agg(F.count("*").alias("__there"))
    return kv.unionByName(writes.join(F.broadcast(there)).where("__there = 0").drop("__there"))


def delete(kv: DataFrame, keys: DataFrame) -> DataFrame:
    return kv.join(keys.select("key"), "key", "left_anti")


def increments(kv: DataFrame, deltas: DataFrame) -> DataFrame:
    """kv (long values) after deltas (key, delta) in any order; a missing key starts at 0; overflow is an error."""
    total = deltas.groupBy("key").agg(F.sum("delta").alias("delta"))
    return kv.join(total, "key", "full").select("key", (F.coalesce("value", F.lit(0)) + F.coalesce("delta", F.lit(0))).alias("value"))


def increments_float(kv: DataFrame, deltas: DataFrame) -> DataFrame:
    """kv (numbers) after deltas (key, delta) as doubles; a missing key starts at 0; a sum that is not finite is an error."""
    total = deltas.groupBy("key").agg(F.sum(F.col("delta").cast("double")).alias("delta"))
    value = F.coalesce(F.col("value").cast("double"), F.lit(0.0)) + F.coalesce("delta", F.lit(0.0))
    finite = F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.raise_error(F.lit("the sum is not a finite number")).cast("double")).otherwise(value)
    return kv.join(total, "key", "full").select("key", finite.alias("value"))


def append(kv: DataFrame, writes: DataFrame) -> DataFrame:
    joined = kv.join(writes.withColumnRenamed("value", "more"), "key", "full")
    return joined.select("key", F.concat(F.coalesce("value", F.lit("")), F.coalesce("more", F.lit(""))).alias("value"))


def strlen(value: Column) -> Column:
    return F.coalesce(F.octet_length(value), F.lit(0))


def getrange(value: Column, start: int, end: int) -> Column:
    return binary.slice_bytes(value.cast("binary"), start, end).cast("string")


def setrange(value: Column, offset: int, data: bytes) -> Column:
    """value with data written over it at offset, filled up with zero bytes."""
    raw = F.coalesce(value.cast("binary"), F.lit(b""))
    head = F.rpad(F.substring(raw, 1, offset), offset, F.lit(b"\x00")) if offset else F.lit(b"")
    return F.concat(head, F.lit(data), raw.substr(F.lit(offset + len(data) + 1), F.octet_length(raw)))


def getset(kv: DataFrame, writes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The old values of the written keys, and the next table."""
    old = writes.select("key").join(kv, "key", "left")
    return old, put(kv, writes)


def getdel(kv: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The values of keys, null for those that are not there, and the table without them."""
    return keys.select("key").distinct().join(kv, "key", "left").select("key", "value"), delete(kv, keys)


def kind(kv: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, type): string, or none for a missing key."""
    return keys.join(kv.select("key", F.lit("string").alias("type")), "key", "left").select("key", F.coalesce("type", F.lit("none")).alias("type"))


def typed(value: Column, tag: Column) -> Column:
    """A tagged value as a struct (kind, i, f, s): tags i64, f64, f32, str, doc, raw; any other is unknown."""
    i = F.when(tag == "i64", value.try_cast("bigint"))
    f = F.when(tag.isin("f64", "f32"), value.try_cast("double"))
    s = F.when(tag.isin("str", "doc", "raw"), value.cast("string"))
    return F.struct(F.when(tag.isin("i64", "f64", "f32", "str", "doc", "raw"), tag).otherwise("unknown").alias("kind"), i.alias("i"), f.alias("f"), s.alias("s"))


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """df with a 0-based place within each key."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))


def first_ranked(df: DataFrame, by: list[str], order: list[Column], start: int, end: int, name: str = "rank") -> DataFrame:
    """Rows from place start to end (both included) of each key, with their place. The condition is on the row number itself, so each task passes on end + 1 rows a key."""
    numbered = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    kept = numbered.where(F.col(name) <= end + 1)
    return (kept.where(F.col(name) > start) if start else kept).withColumn(name, (F.col(name) - 1).cast("long"))


#: Cells of a key's scores that are ordered apart.
CELLS = 128


def wide_ranked(df: DataFrame, score: str, ties: list[str], reverse: bool = False, name: str = "rank") -> DataFrame:
    """As ranked by (score, ties) within `key`, without ordering a whole key in one task; with __n, the key's size.

    A key's scores are dealt into CELLS ranges between its least and its largest; places within a range follow the sizes of the ranges before it.
    """
    edges = df.groupBy("key").agg(F.min(score).alias("__least"), (F.max(score) - F.min(score)).alias("__width"))
    share = (F.col(score) - F.col("__least")).cast("double") / F.col("__width")
    cell = F.when(F.col("__width") > 0, F.least(F.floor(share * CELLS), F.lit(CELLS - 1))).otherwise(F.lit(0)).cast("int")
    placed = df.join(edges, "key").withColumn("__cell", F.coalesce(cell, F.lit(-1))).drop("__least", "__width")
    sizes = placed.groupBy("key", "__cell").agg(F.count("*").alias("__size"))
    before = Window.partitionBy("key").orderBy(F.col("__cell").desc() if reverse else F.col("__cell").asc())  # CELLS rows a key
    sizes = sizes.select("key", "__cell", (F.sum("__size").over(before) - F.col("__size")).alias("__before"), F.sum("__size").over(Window.partitionBy("key")).alias("__n"))
    order = [F.col(c).desc() if reverse else F.col(c).asc() for c in (score, *ties)]
    inside = F.row_number().over(Window.partitionBy("key", "__cell").orderBy(*order))
    return placed.withColumn("__at", inside).join(sizes, ["key", "__cell"]).withColumn(name, (F.col("__before") + F.col("__at") - 1).cast("long")).drop("__cell", "__at", "__before")

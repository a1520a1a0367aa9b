"""Hashes, sets, lists and sorted sets in long format: (key, field, value), (key, member), (key, pos, value), (key, member, score).

Reads give DataFrames; writes give the next table. The first or last n of a collection are found by each task before they meet. Places in a sorted set are
counted over ranges of its scores, so no task orders a whole one; a list's places from both ends, and its edits, order that list in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.operators.kv import first_ranked, ranked, wide_ranked


def window_range(df: DataFrame, order: list[Column], back: list[Column], start: int, end: int) -> DataFrame:
    """Rows of each key from place start to place end, both included and negative from the end; with their place. back: the reverse order."""
    if start >= 0 and end >= 0:
        return first_ranked(df, ["key"], order, start, end)
    if start < 0 and end < 0:
        sizes = df.groupBy("key").agg(F.count("*").alias("__n"))
        last = first_ranked(df, ["key"], back, -end - 1, -start - 1).join(sizes, "key")
        return last.withColumn("rank", F.col("__n") - 1 - F.col("rank")).drop("__n")
    out = ranked(df, ["key"], order).withColumn("__n", F.count("*").over(Window.partitionBy("key")))
    at = lambda i: F.lit(i) if i >= 0 else F.col("__n") + i
    return out.where((F.col("rank") >= at(start)) & (F.col("rank") <= at(end))).drop("__n")


# ---- hashes
def hset(h: DataFrame, writes: DataFrame, only_new: bool = False) -> DataFrame:
    on = ["key", "field"]
    if only_new:
        return h.unionByName(writes.join(h.select(*on), on, "left_anti"))
    return h.join(writes.select(*on), on, "left_anti").unionByName(writes)


def hdel(h: DataFrame, gone: DataFrame) -> DataFrame:
    return h.join(gone, ["key", "field"], "left_anti")


def hmget(h: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (key, field) with values; misses are null."""
    return asked.join(h, ["key", "field"], "left")


def hgetall(h: DataFrame) -> DataFrame:
    """(key, entries): fields in byte order."""
    return h.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("field", "value"))).alias("entries"))


def hlen(h: DataFrame) -> DataFrame:
    return h.groupBy("key").agg(F.count("*").alias("n"))


def hincr(h: DataFrame, deltas: DataFrame) -> DataFrame:
    total = deltas.groupBy("key", "field").agg(F.sum("delta").alias("delta"))
    return h.join(total, ["key", "field"], "full").select("key", "field", (F.coalesce("value", F.lit(0)) + F.coalesce("delta", F.lit(0))).alias("value"))


def htake(h: DataFrame, n: int) -> DataFrame:
    """The first n fields of each hash in byte order; a negative n counts as its absolute value."""
    return first_ranked(h, ["key"], [F.col("field")], 0, abs(n) - 1).drop("rank")


def rows_as_hash(df: DataFrame, table: str, pk: str) -> DataFrame:
    """Rows as hashes table:pk, a field for each column that is not null."""
    fields = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in df.columns))
    return df.select(F.concat(F.lit(f"{table}:"), F.col(pk).cast("string")).alias("key"), F.inline(fields)).where(F.col("value").isNotNull())


def hash_as_rows(h: DataFrame, columns: list[str]) -> DataFrame:
    """The inverse: a row for each key."""
    return h.groupBy("key").agg(*(F.max(F.when(F.col("field") == c, F.col("value"))).alias(c) for c in columns))


# ---- sets
def sadd(s: DataFrame, more: DataFrame) -> DataFrame:
    return s.unionByName(more).distinct()


def srem(s: DataFrame, gone: DataFrame) -> DataFrame:
    return s.join(gone, ["key", "member"], "left_anti")


def members_of(s: DataFrame, key: str) -> DataFrame:
    return s.where(F.col("key") == key).select("member")


def sinter(s: DataFrame, keys: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, "member", "left_semi"), [members_of(s, k) for k in keys])


def sunion(s: DataFrame, keys: list[str]) -> DataFrame:
    return s.where(F.col("key").isin(*keys)).select("member").distinct()


def sdiff(s: DataFrame, keys: list[str]) -> DataFrame:
    first, rest = members_of(s, keys[0]), s.where(F.col("key").isin(*keys[1:])).select("member")
    return first.join(rest, "member", "left_anti") if keys[1:] else first


def sintercard(s: DataFrame, keys: list[str], limit: int = 0) -> DataFrame:
    n = F.count("*")
    return sinter(s, keys).agg((F.least(n, F.lit(limit)) if limit else n).alias("n"))


def sstore(s: DataFrame, key: str, result: DataFrame) -> DataFrame:
    """s with key replaced by the members of result."""
    return s.where(F.col("key") != key).unionByName(result.select(F.lit(key).alias("key"), "member"))


def sismember(s: DataFrame, asked: DataFrame) -> DataFrame:
    hit = s.select("key", "member", F.lit(True).alias("there"))
    return asked.join(hit, ["key", "member"], "left").select("key", "member", F.coalesce("there", F.lit(False)).alias("is_member"))


def scard(s: DataFrame) -> DataFrame:
    return s.groupBy("key").agg(F.count("*").alias("n"))


def stake(s: DataFrame, n: int) -> DataFrame:
    """The first n members of each set in order."""
    return first_ranked(s, ["key"], [F.col("member")], 0, abs(n) - 1).drop("rank")


def spop(s: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    taken = stake(s, n)
    return taken, srem(s, taken)


# ---- lists
def push(lst: DataFrame, key: str, values: DataFrame, left: bool) -> DataFrame:
    """values (i, value) pushed one by one; positions need not be dense."""
    edge = lst.where(F.col("key") == key).agg((F.coalesce(F.min("pos"), F.lit(0)) if left else F.coalesce(F.max("pos"), F.lit(-1))).alias("edge"))
    new = values.join(F.broadcast(edge)).select(F.lit(key).alias("key"), (F.col("edge") - F.col("i") - 1 if left else F.col("edge") + F.col("i") + 1).alias("pos"), "value")
    return lst.unionByName(new)


def lrange(lst: DataFrame, start: int, end: int) -> DataFrame:
    return window_range(lst, [F.col("pos").asc()], [F.col("pos").desc()], start, end)


def lindex(lst: DataFrame, i: int) -> DataFrame:
    return lrange(lst, i, i)


def ltrim(lst: DataFrame, start: int, end: int) -> DataFrame:
    return lrange(lst, start, end).select("key", F.col("rank").alias("pos"), "value")


def lpop(lst: DataFrame, n: int, right: bool = False) -> DataFrame:
    """The first (last) n values of each list, in the order in which they are popped."""
    order = F.col("pos").desc() if right else F.col("pos").asc()
    return first_ranked(lst, ["key"], [order], 0, n - 1, "popped")


def lrem(lst: DataFrame, value: Column, count: int) -> DataFrame:
    """Lists without matches: count > 0 from the head, < 0 from the tail, 0 all."""
    match = F.coalesce(F.col("value") == value, F.lit(False))
    order = F.col("pos").desc() if count < 0 else F.col("pos").asc()
    nth = F.sum(match.cast("long")).over(Window.partitionBy("key").orderBy(order))
    gone = match & ((nth <= abs(count)) if count else F.lit(True))
    kept = lst.withColumn("__gone", gone).where(~F.col("__gone")).drop("__gone", "pos0")
    return ranked(kept, ["key"], [F.col("pos")], "new").select("key", F.col("new").alias("pos"), "value")


def lpos(lst: DataFrame, value: Column, rank: int = 1, count: int = 1) -> DataFrame:
    """Places of matches: from the rank-th one on, from the tail if it is negative; count 0: all."""
    placed = ranked(lst, ["key"], [F.col("pos")])
    hits = placed.where(F.col("value") == value)
    order = F.col("rank").desc() if rank < 0 else F.col("rank").asc()
    nth = ranked(hits, ["key"], [order], "nth").where(F.col("nth") >= abs(rank) - 1)
    return (nth.where(F.col("nth") < abs(rank) - 1 + count) if count else nth).select("key", F.col("rank").alias("place"))


def linsert(lst: DataFrame, pivot: Column, value: Column, after: bool = False) -> DataFrame:
    """Lists with value before or after the first pivot; lists without it stay."""
    first = lst.where(F.col("value") == pivot).groupBy("key").agg(F.min("pos").alias("at"))
    new = first.select("key", (F.col("at") * 2 + (1 if after else -1)).alias("p2"), value.alias("value"))
    both = lst.select("key", (F.col("pos") * 2).alias("p2"), "value").unionByName(new)
    return ranked(both, ["key"], [F.col("p2")], "pos").select("key", "pos", "value")


def lset(lst: DataFrame, i: int, value: Column) -> DataFrame:
    """Lists with place i set; a place that a list does not have leaves it."""
    at = ranked(lst, ["key"], [F.col("pos")]).withColumn("__n", F.count("*").over(Window.partitionBy("key")))
    hit = F.col("rank") == (F.lit(i) if i >= 0 else F.col("__n") + i)
    return at.select("key", F.col("rank").alias("pos"), F.when(hit, value).otherwise(F.col("value")).alias("value"))


# ---- sorted sets
UP = ("score", "member")


def zorder(reverse: bool = False) -> list[Column]:
    return [F.col(c).desc() if reverse else F.col(c).asc() for c in UP]


def zadd(z: DataFrame, writes: DataFrame) -> DataFrame:
    return z.join(writes.select("key", "member"), ["key", "member"], "left_anti").unionByName(writes)


def zrem(z: DataFrame, gone: DataFrame) -> DataFrame:
    return z.join(gone.select("key", "member"), ["key", "member"], "left_anti")


def zincr(z: DataFrame, deltas: DataFrame) -> DataFrame:
    total = deltas.groupBy("key", "member").agg(F.sum("delta").alias("delta"))
    return z.join(total, ["key", "member"], "full").select("key", "member", (F.coalesce("score", F.lit(0.0)) + F.coalesce("delta", F.lit(0.0))).alias("score"))


def zmscore(z: DataFrame, asked: DataFrame) -> DataFrame:
    return asked.join(z, ["key", "member"], "left").select("key", "member", "score")


def zrange(z: DataFrame, start: int, end: int, reverse: bool = False) -> DataFrame:
    if start >= 0 and end >= 0 or start < 0 and end < 0:
        return window_range(z, zorder(reverse), zorder(not reverse), start, end)
    at = lambda i: F.lit(i) if i >= 0 else F.col("__n") + i
    return wide_ranked(z, "score", ["member"], reverse).where((F.col("rank") >= at(start)) & (F.col("rank") <= at(end))).drop("__n")


def zrangebyscore(z: DataFrame, least: float, most: float) -> DataFrame:
    return z.where(F.col("score").between(least, most))


def zcount(z: DataFrame, least: float, most: float) -> DataFrame:
    return zrangebyscore(z, least, most).groupBy("key").agg(F.count("*").alias("n"))


def zrank(z: DataFrame, reverse: bool = False) -> DataFrame:
    return wide_ranked(z, "score", ["member"], reverse).drop("__n")


def zpop(z: DataFrame, n: int, largest: bool = False) -> DataFrame:
    return first_ranked(z, ["key"], zorder(largest), 0, n - 1)


def zstore(z: DataFrame, keys: list[str], intersect: bool = False) -> DataFrame:
    """(member, score): sums over keys; intersect: only members of all."""
    out = z.where(F.col("key").isin(*keys)).groupBy("member").agg(F.sum("score").alias("score"), F.countDistinct("key").alias("__n"))
    return (out.where(F.col("__n") == len(set(keys))) if intersect else out).drop("__n")

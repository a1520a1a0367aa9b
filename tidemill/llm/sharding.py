"""Sharding by extendible hashing.

Documents hash to BITS bits. The directory starts with as many leading bits as shards are needed at least; only buckets above the byte
limit split on their next bit, until every one fits. Each round sums only the documents of buckets that are still too large, and several bits at a time
(STRIDE), so a round settles what as many splits would. Nothing but sums by prefix is shuffled, with partial sums first.

Defined results: a null text has 0 bytes; the hash is that of id and text, so rows that repeat both share a bucket that no bit can split, as
does a single text above the limit: such a bucket stops at BITS bits and is marked oversized. A null id hashes as a text of its own. An empty table gives no shard. Columns besides id and text may have
any names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

BITS = 60
STRIDE = 4
LIMIT = 16_000_000


def hash_bits(*columns: Column) -> Column:
    """The first BITS bits of an MD5 as a long, which other engines can compute as well."""
    text = F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def prefix(bits: Column, depth: Column | int) -> Column:
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.call_function("shiftright", bits, (F.lit(BITS) - depth).cast("int"))


def directory(rows: DataFrame, limit: int, first_depth: int | None = None) -> DataFrame:
    """(depth, prefix, bytes, docs) of every bucket; rows: (bits, bytes)."""
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    depth = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit))))) if first_depth is None else first_depth
    done = None
    open_rows = rows.withColumn("p", prefix(F.col("bits"), depth)).withColumn("depth", F.lit(depth))
    while True:
        # Sums at each depth of this stride; a bucket is a leaf at the first depth at which it fits.
        last = min(BITS, depth + STRIDE)
        fine = stored(open_rows.groupBy(prefix(F.col("bits"), last).alias("p")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs")), "shard-sums")
        above = None
        for d in range(depth, last + 1):
            at = fine.groupBy(F.call_function("shiftright", F.col("p"), F.lit(last - d)).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"))
            if above is not None:
                at = at.join(above.select(F.col("prefix").alias("up")), F.call_function("shiftright", F.col("prefix"), F.lit(1)) == F.col("up"), "left_semi")
            fits = (F.col("bytes") <= limit) | F.lit(d == BITS)
            leaf = at.where(fits).select(F.lit(d).alias("depth"), "prefix", "bytes", "docs")
            done = leaf if done is None else done.unionByName(leaf)
            above = at.where(~fits)
        above = stored(above, "shard-open")
        done = stored(done, "shard-directory")
        if last == BITS or above.isEmpty():
            return done
        open_rows = open_rows.join(above.select(F.col("prefix").alias("up")), prefix(F.col("bits"), last) == F.col("up"), "left_semi")
        open_rows = stored(open_rows.select("bits", "bytes"), "shard-rows")
        depth = last + 1
        # Their buckets at the next depth all come from one that is too large.


def assign(rows: DataFrame, leaves: DataFrame, first_depth: int) -> DataFrame:
    """rows with the bucket of each: leaves are grouped by their first bits, as many as the directory started with."""
    head = F.call_function("shiftright", F.col("prefix"), (F.col("depth") - first_depth).cast("int"))
    grouped = leaves.groupBy(head.alias("__head")).agg(F.collect_list(F.struct("depth", "prefix", "bytes", "docs")).alias("__leaves"))
    joined = rows.withColumn("__head2", prefix(F.col("bits"), first_depth)).join(grouped, F.col("__head2") == F.col("__head"))
    mine = F.filter("__leaves", lambda x: x["prefix"] == F.call_function("shiftright", F.col("bits"), (F.lit(BITS) - x["depth"]).cast("int")))
    return joined.withColumn("__leaf", F.get(mine, F.lit(0))).drop("__head", "__head2", "__leaves")


def with_buckets(rows: DataFrame, limit: int) -> DataFrame:
    """rows (bits, bytes and any others) with __leaf and its bits as text."""
    narrow = stored(rows.select("bits", "bytes"), "shard-rows")
    total = narrow.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    first = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))))
    out = assign(rows, directory(narrow, limit, first), first)
    bits = F.lpad(F.conv(F.col("__leaf.prefix").cast("string"), 10, 2), F.col("__leaf.depth"), "0")
    return out.withColumn("__shard", F.when(F.col("__leaf.depth") == 0, F.lit("")).otherwise(bits))


def shards(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, shard, depth, shard_bytes, shard_docs, oversized); shard: the bucket's bits as text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("bytes"), hash_bits(F.col(id_col), text).alias("bits")), "shard-rows")
    out = with_buckets(rows, limit)
    return out.select("doc_id", F.col("bytes").alias("n_bytes"), F.col("__shard").alias("shard"), F.col("__leaf.depth").alias("depth"), F.col("__leaf.bytes").alias("shard_bytes"), F.col("__leaf.docs").alias("shard_docs"), (F.col("__leaf.bytes") > limit).alias("oversized"))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The documents under path, a folder shard=b<bits> for each shard; a task writes whole shards, each of which fits the limit."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.octet_length(text).cast("long").alias("bytes"), hash_bits(F.col(id_col), text).alias("bits"))
    out = with_buckets(rows, limit).select(F.concat(F.lit("b"), "__shard").alias("shard"), "__row.*")
    out.repartition("shard").write.partitionBy("shard").parquet(path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"))


_FIRST = f"(SELECT greatest(0, ceil(log2(greatest(1.0, sum(coalesce(strlen(text), 0)) / {LIMIT}.0))))::INTEGER FROM documents)"
QUERIES = {"op9_sharding": op9_sharding}
ORACLE = {
    "op9_sharding": f"""
WITH r AS (SELECT row_number() OVER () AS rid, doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(0)) || chr(31) || coalesce(text, '')), 1, {BITS // 4}))::BIGINT AS bits FROM documents),
d AS (SELECT r.*, g.depth, (r.bits >> ({BITS} - g.depth)) AS p FROM r, (SELECT unnest(generate_series({_FIRST}, 24))::INTEGER AS depth) g),
s AS (SELECT *, sum(n_bytes) OVER (PARTITION BY depth, p) AS shard_bytes, count(*) OVER (PARTITION BY depth, p) AS shard_docs FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY depth) AS k FROM s WHERE shard_bytes <= {LIMIT})
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(p), 64, '0'), depth) END AS shard, depth, shard_bytes::BIGINT AS shard_docs_bytes, shard_docs::BIGINT AS shard_docs, false AS oversized FROM f WHERE k = 1
""".replace("shard_docs_bytes", "shard_bytes")
}

"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets. Sources by code point, null last, weigh 1, 2, 3, repeating; they share all words in proportion, each at most max_epochs times its
own size, the excess reshared by weight until none is above.

Selection. Every document of a source takes part in each complete epoch. What is then left of the target goes to a weighted sample
without replacement: a document with weight w has the key -ln(u) / w with u from a hash of the seed and its id, and documents are
taken in order of keys until the prefix sum of their sizes reaches what is left; the last one gives only the words that are missing.
The order within a source is found in three steps, so that no task sees a whole source: the keys' ranges (CELLS to a source) are summed, and the
prefix sums of the ranges tell the one that holds the end; the same again within that one; and only the documents of the last range, one of CELLS * CELLS, are sorted.
Targets are windows over a table with a row for each source; nothing of it goes to the driver.

Defined results: a null or wordless text has size 0 and takes 0; a null source is a source of its own, the last one; a null id has a
key of its own text; rows that repeat id and text share a key and follow each other; unlabelled documents and null qualities have
weight 1; with no words at all every target is 0. A very long text is counted whole, and its words are taken as those of others; an empty table gives
no rows; columns besides those named may have any names but the results' and names that begin with two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, stored, table

#: Ranges of keys to a source. Their number bounds what a task sees of the sums.
CELLS = 4096
#: Weight of a document in the draw by its quality label.
WEIGHT_OF_QUALITY = {1: 2.0, 0: 0.5}
CYCLE = 3
MAX_EPOCHS = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes (source, source_size) with target. A source is full if its share of what fuller ones leave is above its cap; so, by the ratio of cap and weight, full ones come first."""
    weight = ((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1) % CYCLE + 1).cast("double")
    cap = (F.col("source_size") * max_epochs).cast("double")
    rows = sizes.withColumn("__w", weight).withColumn("__cap", cap).withColumn("__ratio", F.col("__cap") / F.col("__w"))
    # Windows over the sources, a row each: the words and the weight that are left when all sources before are full.
    order = Window.partitionBy(F.lit(0)).orderBy("__ratio", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum(F.col("source_size").cast("double")).over(Window.partitionBy(F.lit(0))) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
    rows = rows.withColumn("__left", left).withColumn("__weights", F.sum("__w").over(after)).withColumn("__at", F.row_number().over(order))
    free = F.col("__left") * F.col("__w") / F.col("__weights") <= F.col("__cap")
    first = F.min(F.when(free, F.struct("__at", "__left", "__weights"))).over(Window.partitionBy(F.lit(0)))
    rows = rows.withColumn("__first", first)
    share = F.col("__first.__left") * F.col("__w") / F.col("__first.__weights")
    return rows.select("source", "source_size", F.when(F.col("__at") < F.col("__first.__at"), F.col("__cap")).otherwise(share).alias("target"))


def uniform(*parts: Column) -> Column:
    """In (0, 1), the same in every run and in other engines: 52 bits of an MD5."""
    text = F.concat_ws("\x1f", *(p.cast("string") for p in parts))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + F.lit(0.5)) * F.lit(2.0**-52)


def edges(cells: DataFrame) -> DataFrame:
    """cells (__s, __cell, __sum, __left, __from: what earlier cells hold) with the cell that the end of each source's budget falls into, and what is before it."""
    order = Window.partitionBy("__s").orderBy("__cell")  # CELLS rows a source
    upto = F.col("__from") + F.sum("__sum").over(order)
    hit = cells.withColumn("__upto", upto).where((F.col("__upto") >= F.col("__left")) & (F.col("__upto") - F.col("__sum") < F.col("__left")))
    return hit.select("__s", F.col("__cell").alias("__edge"), (F.col("__upto") - F.col("__sum")).alias("__before"))


def mix(docs: DataFrame, weight: Column, seed: int = 17, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """docs (doc_id, source, size, mark, and what else they have) with source_size, target, epochs, taken, copies (epochs it is in, a part of one counting as one) and es_key."""
    quota = targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    quota = quota.withColumnRenamed("source", "__source").withColumn("epochs", epochs)
    # Stored: its size is known then, so it is broadcast only where it is small.
    quota = stored(quota.withColumn("__left", (F.round("target") - F.col("epochs") * F.col("source_size")).cast("long")), "mix-quota")
    u = uniform(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("\x00"), F.col("mark").cast("string"))))
    rows = docs.withColumn("es_key", -F.log(u) / weight)
    # exp(-key) is uniform for weight 1, so equal ranges of it hold about as many documents each; the second digit divides a range again.
    place = F.least(F.greatest((1 - F.exp(-F.col("es_key"))) * (CELLS * CELLS), F.lit(0.0)), F.lit(CELLS * CELLS - 1.0)).cast("long")
    rows = rows.withColumn("__place", place).withColumn("__cell", F.floor(F.col("__place") / CELLS)).withColumn("__fine", F.col("__place") % CELLS).drop("__place")
    rows = rows.join(quota, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    first = rows.groupBy(F.col("source").alias("__s"), "__cell").agg(F.sum("size").alias("__sum"), F.first("__left").alias("__left"))
    first = stored(edges(first.withColumn("__from", F.lit(0).cast("long"))), "mix-edges")
    rows = rows.join(first, F.col("source").eqNullSafe(F.col("__s")), "left").withColumnRenamed("__before", "__from").drop("__s")
    in_edge = F.coalesce(F.col("__cell") == F.col("__edge"), F.lit(False))
    fine = rows.where(in_edge).groupBy(F.col("source").alias("__s"), F.col("__fine").alias("__cell")).agg(F.sum("size").alias("__sum"), F.first("__left").alias("__left"), F.first("__from").alias("__from"))
    fine = stored(edges(fine).select("__s", F.col("__edge").alias("__fine_edge"), "__before"), "mix-edges")
    rows = rows.join(fine, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s", "__from")
    at_edge = in_edge & F.coalesce(F.col("__fine") == F.col("__fine_edge"), F.lit(False))
    order = Window.partitionBy("source").orderBy("es_key", F.col("doc_id").asc_nulls_last(), "mark").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("__before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    edge_rows = rows.where(at_edge).withColumn("__part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("__left") - start)).cast("long"))
    inside = (F.col("__cell") < F.col("__edge")) | in_edge & (F.col("__fine") < F.col("__fine_edge"))
    plain = rows.where(~at_edge).withColumn("__part", F.when((F.col("__left") > 0) & F.coalesce(inside, F.col("__edge").isNull()), F.col("size")).otherwise(F.lit(0)).cast("long"))
    out = plain.unionByName(edge_rows).withColumn("taken", F.col("epochs") * F.col("size") + F.col("__part"))
    out = out.withColumn("copies", F.when(F.col("size") > 0, F.col("epochs") + (F.col("__part") > 0).cast("long")).otherwise(F.lit(0)).cast("int"))
    return out.drop("__left", "__edge", "__fine_edge", "__before", "__cell", "__fine", "__part")


def quality_weight(quality: Column) -> Column:
    w = F.lit(1.0)
    for value, weight in WEIGHT_OF_QUALITY.items():
        w = F.when(quality == value, weight).otherwise(w)
    return w


def weighted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(F.max("quality").alias("quality"))
    return docs.join(labels, F.col("doc_id") == F.col("__id"), "left").drop("__id")


def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix() of all documents, weighted by their quality labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64("text").alias("mark"))
    docs = stored(weighted(spark, docs, sf_dir), "mix-sizes")  # the texts are read and counted once
    return mix(docs, quality_weight(F.col("quality")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(spark, sf_dir).select("doc_id", "size", "source_size", "target", "taken", "source", "epochs")


_SQL = f"""
WITH q AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
d AS (SELECT d.doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
  -ln((('0x' || substr(md5('17' || chr(31) || d.doc_id::VARCHAR), 1, 13))::BIGINT + 0.5) / 4503599627370496) / CASE quality WHEN 1 THEN {WEIGHT_OF_QUALITY[1]} WHEN 0 THEN {WEIGHT_OF_QUALITY[0]} ELSE 1.0 END AS es_key FROM documents d LEFT JOIN q ON d.doc_id = q.doc_id),
s AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY 1),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {CYCLE} + 1)::DOUBLE AS w, ({MAX_EPOCHS} * n)::DOUBLE AS cap FROM s),
l AS (SELECT *, row_number() OVER o AS place, (SELECT sum(n) FROM s) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
f AS (SELECT arg_min(rest, place) AS rest, arg_min(ws, place) AS ws, min(place) AS place FROM l WHERE rest * w / ws <= cap),
t AS (SELECT source, n, CASE WHEN l.place < f.place THEN cap ELSE f.rest * w / f.ws END::DOUBLE AS target FROM l, f),
e AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END::BIGINT AS epochs FROM t)
SELECT doc_id, size, n AS source_size, target, epochs * size + greatest(0, least(size, round(target)::BIGINT - epochs * n - (sum(size) OVER (PARTITION BY d.source ORDER BY es_key, doc_id) - size)))::BIGINT AS taken, d.source, epochs
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""
QUERIES = {"op4_mixing": op4_mixing}
ORACLE = {"op4_mixing": _SQL}

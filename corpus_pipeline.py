"""The corpus pipeline: toxicity, near-duplicates, secrets, mixture, tokens.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns the columns of documents; the last returns tokens.
Texts travel with their id and a hash of themselves, so that rows which share an id are told apart. Columns that a stage does not use travel
in one struct, so that none can have the name of one of its own.

Defined results: a null or empty text is ordinary to the model, a node of its own to the near-duplicates, holds no secret, has size 0 and is taken no time by the
mixture. A null id keeps its row. Rows that repeat id and text count once from the second stage on. Very long texts are worked on whole in every stage. A null
source is a source. Without labels nothing is toxic and all weights are 1; empty tables give no rows. Further columns of documents travel through the first four stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import common, minhash, mixing, pieces, secrets, toxicity
from tidemill.llm.common import table

MARK, REST = "__mark", "__rest"


def using(*needed: str) -> Callable:
    """A stage that sees the needed columns and a struct of all others, and gives back the columns that it got."""

    def wrap(stage: Callable) -> Callable:
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            others = [F.col(f"`{c}`") for c in docs.columns if c not in needed]
            seen = docs.select(*needed, (F.struct(*others) if others else F.lit(0)).alias(REST))
            out = stage(spark, seen, sf_dir)
            return out.select(*(F.col(c) if c in needed else F.col(REST).getField(c).alias(c) for c in docs.columns))

        return run_stage

    return wrap


def marked(docs: DataFrame) -> DataFrame:
    return docs.withColumn(MARK, F.xxhash64("text"))


def by_row(docs: DataFrame, verdicts: DataFrame, how: str) -> DataFrame:
    """docs (marked) joined with verdicts (doc_id, mark, ...) on id and text; a null id equals itself."""
    v = verdicts.withColumnRenamed("doc_id", "__id").withColumnRenamed("mark", "__m")
    return docs.join(v, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col(MARK) == F.col("__m")), how).drop("__id", "__m")


@using("doc_id", "text")
def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), keep_text=True)
    return scored.where("predicted = 0").select(*docs.columns)


@using("doc_id", "text")
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity of 0.8 or more; rows that repeat id and text count once."""
    kept = minhash.near_duplicates(docs.select("doc_id", "text"), n=5, percent=80).where("kept").select("doc_id", "mark").distinct()
    return by_row(marked(docs), kept, "left_semi").dropDuplicates(["doc_id", MARK]).select(*docs.columns)


@using("doc_id", "source", "text")
def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Credentials that look live are replaced; widely copied examples stay."""
    scanned = secrets.scan(docs.select("doc_id", "source", F.xxhash64("text").alias("mark"), "text")).drop("text")
    hits = secrets.judged(scanned).where(F.size("spans") > 0).groupBy("doc_id", "mark").agg(F.first("spans").alias("__spans"))
    joined = by_row(marked(docs), common.stored(hits, "secret-hits"), "left")
    clean = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(secrets.redacted(F.col("text"), F.col("__spans")))
    return joined.withColumn("text", clean).select(*docs.columns)


@using("doc_id", "source", "text")
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it; the one that the end of its source's budget falls into is taken whole."""
    rows = docs.select("doc_id", "source", mixing.words(F.col("text")).alias("size"), F.xxhash64("text").alias("mark"))
    rows = common.stored(mixing.weighted(spark, rows, sf_dir), "mix-sizes")
    copies = mixing.mix(rows, mixing.quality_weight(F.col("quality"))).where("copies > 0").groupBy("doc_id", "mark").agg(F.max("copies").alias("__copies"))
    taken = by_row(marked(docs), common.stored(copies, "mix-copies"), "inner")
    return taken.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.checked(pieces.tokens(docs.select("doc_id", "source", "text")))


STAGES = [("toxicity", not_toxic), ("near_duplicates", one_of_each), ("secrets", without_secrets), ("mixture", mixed), ("tokens", tokenised)]
#: The models, the similarity join and the segmentation are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, began = table(spark, sf_dir, "documents"), len(common.PATHS)
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.release(spark, began, docs)  # the shared folder keeps one stage's result, not all tables on the way there
    return docs

"""Where tables come from and go to: Parquet tables, key-value views of them, JSON and text exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kv(df: DataFrame, key: str, value: str) -> DataFrame:
    """A key-value table (key, value), keys as text."""
    return df.select(F.col(key).cast("string").alias("key"), F.col(value).alias("value"))


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A VALUES source."""
    return spark.createDataFrame(rows, schema)


def to_json_rows(df: DataFrame) -> DataFrame:
    """Result rows as JSON text: decimals as strings, bytes as UTF-8 where they are text and base64 otherwise, nulls kept."""
    cells = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() == "decimal":
            c = c.cast("string")
        elif f.dataType.typeName() == "binary":
            c = F.when(F.is_valid_utf8(c.cast("string")), c.cast("string")).otherwise(F.base64(c))
        cells.append(c.alias(f.name))
    return df.select(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("row"))


def export_json(df: DataFrame, path: str) -> None:
    """Newline-delimited JSON, a row a line."""
    to_json_rows(df).withColumnRenamed("row", "value").write.mode("overwrite").text(path)


def export_kv_text(kv_table: DataFrame, path: str) -> None:
    """key, tab, value lines."""
    kv_table.select(F.concat_ws("\t", F.col("key").cast("string"), F.coalesce(F.col("value").cast("string"), F.lit("")))).write.mode("overwrite").text(path)


def rescue_json(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The rows of export_json's files that can be read as schema, and the lines (line) that cannot."""
    from pyspark.sql import types as T

    kind = T.StructType.fromDDL(f"{schema}, __bad string")
    lines = spark.read.text(path)
    read = lines.select("value", F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("r"))
    names = [f.name for f in kind.fields if f.name != "__bad"]
    return read.where("r.__bad IS NULL").select(*(F.col(f"r.{n}").alias(n) for n in names)), read.where("r.__bad IS NOT NULL").select(F.col("value").alias("line"))

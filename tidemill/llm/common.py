"""What the operators of this subpackage share: tables, the shared folder, skew-safe joins."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the operators' contracts: maximal runs of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: A key with at least one in so many of the rows is hot; so there are at most so many hot keys.
HOT_PARTS = 1000


#: Rows in an Arrow batch, unless the session says otherwise: ten thousand long texts would be too much for a worker at once.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Sends this package's code to the executors, unless PYTHONPATH names its folder for all; and sees to smaller Arrow batches."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    root, context = Path(__file__).resolve().parents[2], spark.sparkContext
    if getattr(context, "_tidemill_shipped", False) or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    archive = f"{tempfile.mkdtemp(prefix='tidemill-')}/tidemill-code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.glob("tidemill/**/*.py")):
            z.write(f, f.relative_to(root))
    context.addPyFile(archive)
    context._tidemill_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is named and the driver is the only machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not hasattr(context, "_tidemill_dir"):
        context._tidemill_dir = f"file://{tempfile.mkdtemp(prefix='tidemill-')}"
    return context._tidemill_dir


#: Paths given out so far, by this process.
PATHS: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    PATHS.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return PATHS[-1]


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df written once as a table in the shared folder, and read again: its lineage is cut and lost executors lose nothing of it.

    Its size is known from then on, so Spark broadcasts it to a join where that is below its threshold, and shuffles where it is not.
    """
    spark = df.sparkSession
    ship(spark)
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemill_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Deletes what stored() wrote, once nothing reads it any more."""
    for df in tables:
        path = getattr(df, "_tidemill_path", None)
        if path:
            remove(df.sparkSession, path)


def release(spark: SparkSession, since: int, kept: DataFrame) -> None:
    """Deletes all tables whose paths were given out since PATHS had that length, but for `kept`, which reads none of the others."""
    for path in PATHS[since:]:
        if path != kept._tidemill_path:
            remove(spark, path)
    PATHS[since:] = [kept._tidemill_path]


def arrow_map(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow for function(RecordBatch) -> Iterator[RecordBatch]; a batch is handed over in parts of about PART_BYTES of text."""

    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                yield from function(part)

    return df.mapInArrow(run, schema)


PART_BYTES = 600_000


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about PART_BYTES each, and a row at least."""
    rows = batch.num_rows
    if not rows:
        return
    step = max(1, min(rows, int(rows * PART_BYTES / max(1, batch.nbytes))))
    for at in range(0, rows, step):
        yield batch.slice(at, step)


def with_light_key(rows: DataFrame, key: str, hot: DataFrame, hot_value: str, out: str) -> tuple[DataFrame, Column]:
    """rows with `out` looked up in `hot` (at most HOT_PARTS rows, so it may be broadcast), and the key under which to look up the rest.

    The second result is null for rows that are already served, so that a hot key never reaches a shuffle.
    """
    served = rows.join(F.broadcast(hot.select(F.col(key).alias("__hot"), F.col(hot_value).alias(out))), F.col(key) == F.col("__hot"), "left")
    return served, F.when(F.col("__hot").isNull(), F.col(key))


def lookup(rows: DataFrame, keyed: DataFrame, key: str, value: str, count: str, total: int) -> DataFrame:
    """rows left-joined with keyed(key, value, count) on key, without skew: `value` is null for rows whose key is not there.

    keyed holds each key once, with the number of `rows` that have it; total is the number of rows. Keys with a share of 1/HOT_PARTS or
    more, of which there can be HOT_PARTS at most, are broadcast; the other rows are shuffled by key, those already served by a spread key.
    """
    keyed = stored(keyed, "lookup")
    is_hot = F.col(count) * HOT_PARTS >= F.lit(max(total, 1))
    served, light = with_light_key(rows, key, keyed.where(is_hot), value, "__served")
    rest = keyed.where(~is_hot).select(F.col(key).alias("__light"), F.col(value).alias("__value"))
    joined = served.withColumn("__key", light).join(rest, F.col("__key") == F.col("__light"), "left")
    return joined.withColumn(value, F.coalesce("__served", "__value")).drop("__hot", "__served", "__key", "__light", "__value")

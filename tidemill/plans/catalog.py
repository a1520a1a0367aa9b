"""Metadata of the engine's own tables: columns, keys, defaults, foreign keys; and the plans that make the next contents of a table."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemill.functions.scalars import coerce

# Spark's type for each type name of the dialect.
SPARK_TYPES = {
    "INT": "bigint", "BIGINT": "bigint", "INTEGER": "bigint", "SMALLINT": "bigint", "SERIAL": "bigint", "BIGSERIAL": "bigint", "SMALLSERIAL": "bigint",
    "DOUBLE": "double", "FLOAT": "double", "REAL": "double", "TEXT": "string", "VARCHAR": "string", "CHAR": "string", "STRING": "string", "INET": "string",
    "BLOB": "binary", "BYTES": "binary", "BYTEA": "binary", "BOOLEAN": "boolean", "BOOL": "boolean", "DATE": "date", "TIME": "bigint",
    "TIMESTAMP": "timestamp_ntz", "DATETIME": "timestamp_ntz", "TIMESTAMPTZ": "timestamp_ntz", "JSON": "string", "JSONB": "string", "UUID": "string",
}
HIDDEN_ID = "__rowid"


class ConstraintError(ValueError):
    """A write that a constraint forbids."""


@dataclass
class ColumnDef:
    name: str
    type: str
    not_null: bool = False
    default: str | None = None
    hidden: bool = False

    @property
    def spark_type(self) -> str:
        base = re.match(r"[A-Z]+", self.type.upper())[0]
        if base in ("DECIMAL", "NUMERIC", "DEC"):
            m = re.search(r"\((\d+)(?:\s*,\s*(\d+))?\)", self.type)
            return f"decimal({m[1]},{m[2] or 0})" if m else "decimal(10,0)"
        if self.type.endswith("[]") or "ARRAY" in self.type.upper():
            return "string"
        return SPARK_TYPES[base]

    @property
    def serial(self) -> bool:
        return "SERIAL" in self.type.upper()


@dataclass
class ForeignKey:
    column: str
    parent: str
    parent_column: str
    on_delete: str = "RESTRICT"


@dataclass
class TableDef:
    """pk: the key's columns, one or more. global_uniques: unique over all shards of a name's table, where uniques may be kept by shard; here both hold over the whole table."""

    name: str
    columns: list[ColumnDef]
    pk: list[str]
    uniques: list[list[str]] = field(default_factory=list)
    global_uniques: list[list[str]] = field(default_factory=list)
    indexes: list[list[str]] = field(default_factory=list)
    foreign: list[ForeignKey] = field(default_factory=list)
    checks: list[str] = field(default_factory=list)
    adapter: bool = False
    version: int = 1
    next_id: int = 1

    def column(self, name: str) -> ColumnDef:
        for c in self.columns:
            if c.name == name:
                return c
        raise KeyError(f"unknown column {name}")

    @property
    def visible(self) -> list[str]:
        return [c.name for c in self.columns if not c.hidden]

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, T.StructType.fromDDL(f"x {c.spark_type}")[0].dataType) for c in self.columns])

    def empty(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([], self.schema())


def default_value(c: ColumnDef) -> Column:
    d = (c.default or "").strip()
    if not d or d.upper() == "NULL":
        value = F.lit(None)
    elif re.match(r"(?i)(now\(\)|current_timestamp)", d):
        value = F.current_timestamp().cast("timestamp_ntz")
    elif re.match(r"(?i)uuid_generate_v4\(\)|gen_random_uuid\(\)", d):
        value = F.uuid()
    else:
        value = coerce(F.expr(re.sub(r"::\s*[\w\[\]]+", "", d)), c.type)
    return value.cast(c.spark_type)


# ---- plans: the old contents and a change give the new contents


def conformed(rows: DataFrame, t: TableDef, order: str | None = None) -> DataFrame:
    """rows with every column of t, coerced as columns take values, and defaults where a column is missing; identities are numbered on from next_id.

    Numbers are dense, in the order of the column `order`: a row's own number in its partition, after the rows of all partitions before it. Only the sizes of
    the partitions are gathered.
    """
    missing = [c.name for c in t.columns if (c.serial or c.hidden) and c.name not in rows.columns]
    if missing:
        rows = dense_numbers(rows.orderBy(order) if order else rows, "__number")
    out = []
    for c in t.columns:
        if c.name in rows.columns:
            out.append(coerce(F.col(f"`{c.name}`"), c.type).cast(c.spark_type).alias(c.name))
        elif c.name in missing:
            out.append((F.col("__number") + t.next_id).cast("bigint").alias(c.name))
        else:
            out.append(default_value(c).alias(c.name))
    return rows.select(*out)


def dense_numbers(rows: DataFrame, name: str) -> DataFrame:
    """rows with 0, 1, 2 ... in the order in which they stand. They are kept as they stand first, so that numbers and sizes are of the same partitions."""
    kept = kept_once(rows.withColumn("__at", F.monotonically_increasing_id()))
    part, at = F.shiftrightunsigned("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = kept.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = sizes.select(F.col("__part"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return kept.withColumn("__part", part).join(starts, "__part").withColumn(name, F.col("__start") + at).drop("__at", "__part", "__start")


def kept_once(df: DataFrame) -> DataFrame:
    """df computed once: as a table in the shared folder, where lost executors lose nothing of it, or, where none is named, in the cache."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not folder:
        return df.persist()
    path = f"{folder.rstrip('/')}/tidemill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def upserted(old: DataFrame, new: DataFrame, pk: list[str]) -> DataFrame:
    """old with the rows of new in the place of those with their keys."""
    return old.join(new.select(*pk), pk, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def updated(old: DataFrame, sets: dict[str, Column], where: Column | None, t: TableDef) -> DataFrame:
    """Every right side reads the old row; a key cannot be set."""
    if set(t.pk) & set(sets):
        raise ConstraintError("a primary key cannot be updated")
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return old.select(*(F.when(hit, sets[c.name].cast(c.spark_type)).otherwise(F.col(c.name)).alias(c.name) if c.name in sets else F.col(c.name) for c in t.columns))


def split(old: DataFrame, where: Column | None) -> tuple[DataFrame, DataFrame]:
    """What stays and what a DELETE removes; an unknown condition keeps the row."""
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return old.where(~hit), old.where(hit)


# ---- constraints: each check is a query that must be empty


def violations(rows: DataFrame, t: TableDef, parents: dict[str, DataFrame]) -> list[tuple[str, DataFrame]]:
    out = [(f"{c.name} may not be null", rows.where(F.col(c.name).isNull())) for c in t.columns if c.not_null or c.name in t.pk]
    for cols in [t.pk, *t.uniques, *t.global_uniques]:
        known = rows.where(F.greatest(*(F.col(c).isNull().cast("int") for c in cols), F.lit(0)) == 0)
        out.append((f"({', '.join(cols)}) must be unique", known.groupBy(*cols).agg(F.count("*").alias("n")).where("n > 1")))
    for k in t.foreign:
        parent = parents[k.parent].select(F.col(k.parent_column).alias("__p"))
        out.append((f"{k.column} has no match in {k.parent}", rows.where(F.col(k.column).isNotNull()).join(parent, F.col(k.column) == F.col("__p"), "left_anti")))
    for check in t.checks:
        out.append((f"check ({check})", rows.where(~F.coalesce(F.expr(check), F.lit(True)))))
    return out


def enforce(rows: DataFrame, t: TableDef, parents: dict[str, DataFrame]) -> None:
    for message, bad in violations(rows, t, parents):
        if not bad.isEmpty():
            raise ConstraintError(f"{t.name}: {message}")


def cascaded(deleted: dict[str, DataFrame], tables: dict[str, TableDef], contents: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The contents after rows were deleted: follows every foreign key until no more rows go. deleted: by table, whole rows.

    The number of rounds is bounded by the rows of the child tables, since each round but the last deletes some.
    """
    now = dict(contents)
    for name, gone in deleted.items():
        now[name] = now[name].join(gone.select(*tables[name].pk), tables[name].pk, "left_anti").select(*contents[name].columns)
    frontier = dict(deleted)
    while frontier:
        following: dict[str, DataFrame] = {}
        for parent, gone in frontier.items():
            for child in tables.values():
                for k in (k for k in child.foreign if k.parent == parent):
                    keys = gone.select(F.col(k.parent_column).alias("__p")).distinct()
                    hit = now[child.name].join(keys, F.col(k.column) == F.col("__p"), "left_semi")
                    if k.on_delete in ("RESTRICT", "NO ACTION"):
                        if not hit.isEmpty():
                            raise ConstraintError(f"{child.name}.{k.column} still refers to {parent}")
                    elif k.on_delete == "SET NULL":
                        marked = now[child.name].join(keys, F.col(k.column) == F.col("__p"), "left")
                        kept = [F.when(F.col("__p").isNull(), F.col(c.name)).alias(c.name) if c.name == k.column else F.col(c.name) for c in child.columns]
                        now[child.name] = marked.select(*kept)
                    else:
                        if hit.isEmpty():
                            continue
                        hit = kept_once(hit)
                        following[child.name] = hit if child.name not in following else following[child.name].unionByName(hit).dropDuplicates(child.pk)
                        now[child.name] = now[child.name].join(hit.select(*child.pk), child.pk, "left_anti").select(*contents[child.name].columns)
        frontier = following
    return now


def fingerprint(df: DataFrame, pk: list[str]) -> DataFrame:
    """(pk, mark) of each row, to tell at a commit whether what was read has changed."""
    return df.select(F.struct(*pk).alias("pk"), F.xxhash64(*(F.col(c) for c in df.columns)).alias("mark"))

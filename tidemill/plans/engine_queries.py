"""Writes, cascades, transactions and introspection of the engine over the driver's tables; superset queries that the dialect leaves out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.plans.base import Registry
from tidemill.plans.catalog import ConstraintError, ForeignKey
from tidemill.plans.engine import Engine
from tidemill.sources.tables import load

R = Registry()


def engine(spark: SparkSession, d: str) -> Engine:
    """nation, customer and orders as tables, customers and orders going with what they refer to."""
    db = Engine(spark)
    nation = load(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))
    customer = load(spark, d, "customer").select("c_custkey", "c_name", F.col("c_nationkey").cast("long").alias("c_nationkey"), "c_acctbal")
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    for name, df, pk in (("nation", nation, "n_nationkey"), ("customer", customer, "c_custkey"), ("orders", orders, "o_orderkey")):
        db.attach(name, df, pk)
    db.tables["customer"].foreign.append(ForeignKey("c_nationkey", "nation", "n_nationkey", "CASCADE"))
    db.tables["orders"].foreign.append(ForeignKey("o_custkey", "customer", "c_custkey", "SET NULL"))
    return db


C = "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal FROM customer"


@R.frame("dml_upsert", f"SELECT * FROM ({C}) WHERE c_custkey NOT IN (1, 2) UNION ALL SELECT 1, 'new one', 3, 7.5 UNION ALL SELECT 2, 'last', 4, NULL UNION ALL SELECT -5, 'extra', 0, 1.0")
def dml_upsert(spark: SparkSession, d: str) -> DataFrame:
    db = engine(spark, d)
    db.sql("INSERT INTO customer VALUES (1, 'new one', 3, 7.5), (2, 'first', 4, 1), (2, 'last', 4, NULL), (-5, 'extra', 0, 1.0)")
    return db.sql("SELECT * FROM customer")


@R.frame("dml_update", f"SELECT c_custkey, CASE WHEN hit THEN 'moved' ELSE c_name END AS c_name, c_nationkey, CASE WHEN hit THEN c_acctbal + 10 ELSE c_acctbal END AS c_acctbal FROM (SELECT c.*, c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AS hit FROM ({C}) c)")
def dml_update(spark: SparkSession, d: str) -> DataFrame:
    db = engine(spark, d)
    db.sql("UPDATE customer SET c_acctbal = c_acctbal + 10, c_name = 'moved' WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
    return db.sql("SELECT * FROM customer")


@R.frame("dml_delete", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE NOT (o_totalprice > 100000)")
def dml_delete(spark: SparkSession, d: str) -> DataFrame:
    db = engine(spark, d)
    db.sql("DELETE FROM orders WHERE o_totalprice > $1", [100000.0])
    return db.sql("SELECT * FROM orders")


@R.frame("fk_cascade", "SELECT o_orderkey, CASE WHEN c_nationkey > 4 THEN o_custkey END AS o_custkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def fk_cascade(spark: SparkSession, d: str) -> DataFrame:
    db = engine(spark, d)
    db.sql("DELETE FROM nation WHERE n_nationkey BETWEEN 0 AND 4")
    return db.sql("SELECT o_orderkey, o_custkey FROM orders")


@R.frame("txn_savepoint", "SELECT n_nationkey::BIGINT AS n_nationkey, 'x' AS n_name FROM nation WHERE n_regionkey <> 0")
def txn_savepoint(spark: SparkSession, d: str) -> DataFrame:
    db = engine(spark, d)
    db.tables["customer"].foreign.clear()
    for text in ("BEGIN", "DELETE FROM nation WHERE n_regionkey = 0", "UPDATE nation SET n_name = 'x'", "SAVEPOINT s", "DELETE FROM nation", "ROLLBACK TO s", "COMMIT"):
        db.sql(text)
    return db.sql("SELECT n_nationkey, n_name FROM nation")


@R.frame("dml_update_params", f"SELECT c_custkey, CASE WHEN c_custkey % 7 = 3 AND c_acctbal > 100 THEN c_name || ' where' ELSE c_name END AS c_name, CASE WHEN c_custkey % 7 = 3 AND c_acctbal > 100 THEN c_acctbal + 2.5 ELSE c_acctbal END AS c_acctbal FROM ({C})")
def dml_update_params(spark: SparkSession, d: str) -> DataFrame:
    db = engine(spark, d)
    db.sql("UPDATE customer SET c_acctbal = c_acctbal + ?, c_name = c_name || ' where' WHERE c_custkey % ? = ? AND c_acctbal > ?", [2.5, 7, 3, 100.0])
    return db.sql("SELECT c_custkey, c_name, c_acctbal FROM customer")


@R.frame("insert_serial", "SELECT row_number() OVER (ORDER BY n_nationkey) AS id, n_name AS name, true AS uuid, true AS at FROM nation UNION ALL SELECT (SELECT count(*) FROM nation) + i, n, true, true FROM (VALUES (1, 'a'), (2, 'b')) AS v(i, n)")
def insert_serial(spark: SparkSession, d: str) -> DataFrame:
    db = engine(spark, d)
    db.sql("CREATE TABLE s (id SERIAL PRIMARY KEY, name TEXT, u UUID DEFAULT uuid_generate_v4(), at TIMESTAMP DEFAULT now(), n INT DEFAULT '5'::int)")
    db.insert("s", load(spark, d, "nation").orderBy("n_nationkey").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("o")), "o")
    db.sql("INSERT INTO s (name) VALUES ('a'), ('b')")
    return db.sql("SELECT id, name, n = 5 AND length(u) = 36 AS uuid, at IS NOT NULL AS at FROM s")


@R.frame("composite_key_upsert", "SELECT user_id, event_type, CASE WHEN event_type = 'click' THEN 0 ELSE count(*) END AS n FROM events GROUP BY user_id, event_type")
def composite_key_upsert(spark: SparkSession, d: str) -> DataFrame:
    db = Engine(spark)
    db.attach("counts", load(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")), "user_id", "event_type")
    db.sql("INSERT INTO counts SELECT user_id, event_type, 0 FROM counts WHERE event_type = 'click'")
    return db.sql("SELECT * FROM counts")


#: A statement that a constraint turns away, and one that it lets through.
REJECTED = {
    "not null": ("INSERT INTO t VALUES (3, NULL, 1, 1, NULL)", "INSERT INTO t VALUES (3, 'c', 3, 3, NULL)"),
    "unique": ("INSERT INTO t VALUES (4, 'a', 4, 4, NULL)", "INSERT INTO t VALUES (1, 'a', 1, 1, NULL)"),
    "unique of two": ("INSERT INTO t VALUES (5, 'e', 1, 1, NULL)", "INSERT INTO t VALUES (5, 'e', NULL, 1, NULL)"),
    "global unique": ("INSERT INTO g VALUES (9, 'x')", "INSERT INTO g VALUES (9, 'z')"),
    "foreign key": ("INSERT INTO t VALUES (6, 'f', 6, 6, 99)", "INSERT INTO t VALUES (6, 'f', 6, 6, NULL)"),
    "restrict": ("DELETE FROM g WHERE id = 1", "DELETE FROM g WHERE id = 2"),
    "key": ("UPDATE t SET id = 7", "UPDATE t SET name = 'q' WHERE id = 2"),
    "read only": ("DELETE FROM t", "SELECT id FROM t"),
}


@R.frame("constraints", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', true, false)" for k in REJECTED) + ") AS v(kind, rejected, also)")
def constraints(spark: SparkSession, d: str) -> DataFrame:
    def turned_away(kind: str, statement: str) -> bool:
        db = Engine(spark)
        db.sql("CREATE TABLE g (id INT PRIMARY KEY, mail TEXT GLOBAL UNIQUE)")
        db.sql("INSERT INTO g VALUES (1, 'x'), (2, 'y')")
        db.sql("CREATE TABLE t (id INT PRIMARY KEY, name TEXT NOT NULL UNIQUE, a INT, b INT, gid INT REFERENCES g (id) ON DELETE RESTRICT, UNIQUE (a, b))")
        db.sql("INSERT INTO t VALUES (1, 'a', 1, 1, 1), (2, 'b', NULL, 1, NULL)")
        if kind == "read only":
            db.sql("BEGIN READ ONLY")
        try:
            db.sql(statement)
        except ConstraintError:
            return True
        return False

    return spark.createDataFrame([(kind, turned_away(kind, bad), turned_away(kind, good)) for kind, (bad, good) in REJECTED.items()], "kind string, rejected boolean, also boolean")


@R.frame("row_adapter_writes", "SELECT n_nationkey, CASE WHEN n_nationkey = 1 THEN 'one' ELSE n_name END AS n_name, CASE WHEN n_nationkey = 2 THEN NULL WHEN n_nationkey = 3 THEN n_regionkey + 5 ELSE n_regionkey END AS n_regionkey FROM nation WHERE n_nationkey <> 4")
def row_adapter_writes(spark: SparkSession, d: str) -> DataFrame:
    db = Engine(spark)
    db.attach("nation", load(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey")), "n_nationkey")
    db.sql("ALTER TABLE nation SET RESP ADAPTER ON")
    db.row_hset("nation", spark.createDataFrame([("1", "n_name", "one")], "pk string, field string, value string"))
    db.row_hset("nation", spark.createDataFrame([("5", "n_name", "not null")], "pk string, field string, value string"), only_null=True)
    db.row_hdel("nation", spark.createDataFrame([("2", "n_regionkey")], "pk string, field string"))
    db.row_hincr("nation", spark.createDataFrame([("3", "n_regionkey", 5.0)], "pk string, field string, delta double"))
    db.row_del("nation", spark.createDataFrame([("4",)], "pk string"))
    return db.sql("SELECT * FROM nation")


@R.frame("alter_table", "SELECT n_nationkey::BIGINT AS n_nationkey, 'd' AS extra FROM nation")
def alter_table(spark: SparkSession, d: str) -> DataFrame:
    db = engine(spark, d)
    db.sql("ALTER TABLE nation ADD COLUMN extra TEXT NOT NULL DEFAULT 'd'")
    db.sql("ALTER TABLE nation DROP COLUMN n_name")
    db.sql("ALTER TABLE nation DROP COLUMN n_regionkey")
    return db.sql("SELECT * FROM nation")


@R.frame("txn_serializable", "SELECT true AS conflict, 1 AS v")
def txn_serializable(spark: SparkSession, d: str) -> DataFrame:
    """A commit that has read what another write has changed since is turned away, and the other write stays."""
    db = Engine(spark)
    db.sql("CREATE TABLE t (id INT PRIMARY KEY, v INT)")
    db.sql("INSERT INTO t VALUES (1, 0)")
    db.sql("BEGIN ISOLATION LEVEL SERIALIZABLE")
    db.sql("SELECT * FROM t").collect()
    mine, db.txn = db.txn, None
    db.sql("UPDATE t SET v = 1")
    db.txn, conflict = mine, False
    try:
        db.sql("COMMIT")
    except ConstraintError:
        conflict = True
    return db.sql("SELECT v FROM t").select(F.lit(conflict).alias("conflict"), F.col("v").cast("int").alias("v"))


_COLUMNS = [("nation", "n_nationkey", 1, "NO", "bigint"), ("nation", "n_name", 2, "YES", "text"), ("nation", "n_regionkey", 3, "YES", "bigint"), ("customer", "c_custkey", 1, "NO", "bigint"), ("customer", "c_name", 2, "YES", "text"), ("customer", "c_nationkey", 3, "YES", "bigint"), ("customer", "c_acctbal", 4, "YES", "double"), ("orders", "o_orderkey", 1, "NO", "bigint"), ("orders", "o_custkey", 2, "YES", "bigint"), ("orders", "o_totalprice", 3, "YES", "double")]


def _said(rows: list[tuple], columns: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join('NULL' if x is None else repr(x) for x in r) + ')' for r in rows)}) AS v({columns})"


R.frame("infoschema_columns", _said(_COLUMNS, "table_name, column_name, ordinal_position, is_nullable, data_type"))(lambda s, d: engine(s, d).sql("SELECT table_name, column_name, ordinal_position, is_nullable, data_type FROM information_schema.columns"))
R.frame("infoschema_tables", _said([("nation",), ("customer",), ("orders",)], "table_name"))(lambda s, d: engine(s, d).sql("SELECT table_name FROM information_schema.tables WHERE table_schema = 'default'"))
R.frame("infoschema_keys", _said([("nation", "n_nationkey", "PRIMARY", None), ("customer", "c_custkey", "PRIMARY", None), ("orders", "o_orderkey", "PRIMARY", None), ("customer", "c_nationkey", "fk_customer_c_nationkey", "nation"), ("orders", "o_custkey", "fk_orders_o_custkey", "customer")], "table_name, column_name, constraint_name, referenced_table_name"))(
    lambda s, d: engine(s, d).sql("SELECT table_name, column_name, constraint_name, referenced_table_name FROM information_schema.key_column_usage")
)
R.frame("infoschema_schemata", "SELECT 'default' AS schema_name")(lambda s, d: engine(s, d).sql("SELECT schema_name FROM information_schema.schemata"))
R.frame("pg_class", _said([("nation", "r"), ("customer", "r"), ("orders", "r")], "relname, relkind"))(lambda s, d: engine(s, d).sql("SELECT relname, relkind FROM pg_catalog.pg_class"))
R.frame("pg_attribute", _said([(c, n) for _, c, n, _, _ in _COLUMNS], "attname, attnum"))(lambda s, d: engine(s, d).sql("SELECT attname, attnum FROM pg_catalog.pg_attribute"))
R.frame("show_tables", _said([("nation",), ("customer",), ("orders",)], "name"))(lambda s, d: engine(s, d).sql("SHOW FULL TABLES"))
R.frame("show_describe", _said([(c, kind, null, {"c_custkey": "PRI"}.get(c, ""), None) for t, c, _, null, kind in _COLUMNS if t == "customer"], '"Field", "Type", "Null", "Key", "Default"'))(lambda s, d: engine(s, d).sql("DESCRIBE customer"))
R.frame("system_exists", "SELECT true AS there")(lambda s, d: engine(s, d).sql("SELECT EXISTS (SELECT 1 FROM information_schema.tables WHERE table_name = 'orders') AS there"))

# ---- beyond the dialect
R.sql("union_all", "SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey AS k FROM supplier")
R.sql("except_distinct", "SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0")
R.sql("window_rank", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders", "SELECT o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey))::INTEGER AS r FROM orders")
R.sql("like_infix", "SELECT p_partkey FROM part WHERE p_type LIKE '%A%' AND p_name NOT LIKE '_x%'")

QUERIES, ORACLE = R.queries, R.oracle

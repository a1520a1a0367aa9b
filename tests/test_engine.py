"""DDL, DML, constraints, transactions, introspection and the dialect."""

import pytest
from pyspark.sql import functions as F

from tidemill.functions import bits, scalars
from tidemill.operators import collections as c
from tidemill.operators import kv
from tidemill.operators import relational
from tidemill.plans.catalog import ConstraintError
from tidemill.plans.dialect import DialectError, translate
from tidemill.plans.engine import Engine


@pytest.fixture()
def db(spark):
    return Engine(spark)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_insert_update_delete(db):
    db.sql("CREATE TABLE t (id INT PRIMARY KEY, name TEXT NOT NULL, score DOUBLE, ok BOOL DEFAULT true, INDEX (name))")
    assert db.sql("INSERT INTO t (id, name, score) VALUES (1, 'a', 1.5), (2, 'it''s', NULL), (2, 'b', 2)").first()[0] == 3
    assert rows(db.sql("SELECT id, name, score, ok FROM t")) == [(1, "a", 1.5, True), (2, "b", 2.0, True)]
    assert db.sql("UPDATE t SET score = score + 1, name = 'z' WHERE id = 1").first()[0] == 1
    assert db.sql("UPDATE t SET ok = NOT ok WHERE score IN (SELECT score FROM t WHERE id = 2)").first()[0] == 1
    assert rows(db.sql("SELECT * FROM t")) == [(1, "z", 2.5, True), (2, "b", 2.0, False)]
    assert db.sql("DELETE FROM t WHERE score > $1", [2.2]).first()[0] == 1
    assert rows(db.sql("SELECT COUNT(*) AS n FROM t")) == [(1,)]
    with pytest.raises(ConstraintError):
        db.sql("INSERT INTO t (id, name) VALUES (3, NULL)")
    with pytest.raises(ConstraintError):
        db.sql("UPDATE t SET id = 4")


def test_unknown_conditions_keep_rows(db):
    db.sql("CREATE TABLE n (id INT PRIMARY KEY, v INT)")
    db.sql("INSERT INTO n VALUES (1, NULL), (2, 5)")
    assert db.sql("DELETE FROM n WHERE NOT (v = 5)").first()[0] == 0


def test_unique_and_hidden_key(db):
    db.sql("CREATE TABLE uq (a INT, b INT, UNIQUE (a, b))")
    db.sql("INSERT INTO uq VALUES (1, 1), (1, 2), (NULL, 1), (NULL, 1)")
    assert db.sql("SELECT * FROM uq").columns == ["a", "b"]
    with pytest.raises(ConstraintError):
        db.sql("INSERT INTO uq VALUES (1, 2)")
    db.sql("CREATE TABLE lone (email TEXT UNIQUE, x INT)")
    assert db.tables["lone"].pk == ["email"]


def test_alter(db):
    db.sql("CREATE TABLE a (id SERIAL PRIMARY KEY, x INT)")
    db.sql("INSERT INTO a (x) VALUES (7)")
    db.sql("ALTER TABLE a ADD COLUMN y TEXT NOT NULL DEFAULT 'd'")
    assert rows(db.sql("SELECT x, y FROM a")) == [(7, "d")]
    db.sql("ALTER TABLE a DROP COLUMN x")
    assert db.sql("SELECT * FROM a").columns == ["id", "y"]
    with pytest.raises(ConstraintError):
        db.sql("ALTER TABLE a ADD COLUMN z INT NOT NULL")
    with pytest.raises(DialectError):
        db.sql("CREATE INDEX i ON a (y)")


def family(db, child_action="CASCADE"):
    db.sql("CREATE TABLE p (id INT PRIMARY KEY)")
    db.sql(f"CREATE TABLE c (id INT PRIMARY KEY, pid INT REFERENCES p ON DELETE {child_action})")
    db.sql("CREATE TABLE g (id INT PRIMARY KEY, cid INT, FOREIGN KEY (cid) REFERENCES c (id) ON DELETE SET NULL)")
    db.sql("INSERT INTO p VALUES (1), (2)")
    db.sql("INSERT INTO c VALUES (10, 1), (11, 1), (12, 2), (13, NULL)")
    db.sql("INSERT INTO g VALUES (100, 10), (101, 12)")


def test_cascade_and_set_null(db):
    family(db)
    with pytest.raises(ConstraintError):
        db.sql("INSERT INTO c VALUES (14, 9)")
    db.sql("DELETE FROM p WHERE id = 1")
    assert rows(db.sql("SELECT id FROM c")) == [(12,), (13,)]
    assert [tuple(r) for r in db.sql("SELECT id, cid FROM g ORDER BY id").collect()] == [(100, None), (101, 12)]


def test_restrict(db):
    family(db, "RESTRICT")
    with pytest.raises(ConstraintError):
        db.sql("DELETE FROM p WHERE id = 1")
    assert rows(db.sql("SELECT id FROM p")) == [(1,), (2,)]


def test_self_reference_ends(db):
    db.sql("CREATE TABLE s (id INT PRIMARY KEY, up INT REFERENCES s (id) ON DELETE CASCADE)")
    db.sql("INSERT INTO s VALUES (1, 2), (2, 1), (3, 2), (4, NULL)")
    db.sql("DELETE FROM s WHERE id = 1")
    assert rows(db.sql("SELECT id FROM s")) == [(4,)]


def test_transactions(db):
    db.sql("CREATE TABLE t (id INT PRIMARY KEY, v INT)")
    db.sql("INSERT INTO t VALUES (1, 1)")
    db.sql("BEGIN")
    db.sql("INSERT INTO t VALUES (2, 2)")
    db.sql("SAVEPOINT a")
    db.sql("UPDATE t SET v = 9")
    assert rows(db.sql("SELECT v FROM t")) == [(9,), (9,)]
    db.sql("ROLLBACK TO a")
    db.sql("COMMIT")
    assert rows(db.sql("SELECT * FROM t")) == [(1, 1), (2, 2)]
    db.sql("BEGIN")
    db.sql("DELETE FROM t")
    db.sql("ROLLBACK")
    assert len(rows(db.sql("SELECT * FROM t"))) == 2
    db.sql("BEGIN READ ONLY")
    with pytest.raises(ConstraintError):
        db.sql("DELETE FROM t")


def test_update_binds_places_over_the_statement(db):
    db.sql("CREATE TABLE v (id INT PRIMARY KEY, v INT, name TEXT)")
    db.sql("INSERT INTO v VALUES (1, 10, 'a'), (2, 20, 'b')")
    db.sql("UPDATE v SET v = ? WHERE id = ?", [2, 1])
    assert rows(db.sql("SELECT id, v FROM v")) == [(1, 2), (2, 20)]
    db.sql("UPDATE v SET name = 'x where y', v = v + ? WHERE id = ?", [5, 2])
    assert rows(db.sql("SELECT * FROM v")) == [(1, 2, "a"), (2, 25, "x where y")]
    db.sql("UPDATE v SET name = name || $2 WHERE id = $1", [1, "!"])
    assert rows(db.sql("SELECT name FROM v WHERE id = ?", [1])) == [("a!",)]
    db.sql("DELETE FROM v WHERE name = 'x where y' AND v = ?", [25])
    assert rows(db.sql("SELECT id FROM v")) == [(1,)]
    with pytest.raises(DialectError):
        db.sql("UPDATE v SET v = ? WHERE id = $1", [1])
    for odd in ("_init__", "sql", "frame x", ""):
        with pytest.raises(DialectError):
            db.sql(odd)


def test_composite_key(db):
    db.sql("CREATE TABLE k (a INT, b INT, v TEXT, PRIMARY KEY (a, b))")
    db.sql("INSERT INTO k VALUES (1, 1, 'x'), (1, 2, 'y'), (1, 2, 'z')")
    assert rows(db.sql("SELECT * FROM k")) == [(1, 1, "x"), (1, 2, "z")]
    db.sql("UPDATE k SET v = 'w' WHERE b = 2")
    db.sql("DELETE FROM k WHERE b = 1")
    assert rows(db.sql("SELECT * FROM k")) == [(1, 2, "w")]
    assert [r["Key"] for r in db.sql("DESCRIBE k").collect()] == ["PRI", "PRI", ""]
    assert "PRIMARY KEY (a, b)" in db.sql("SHOW CREATE TABLE k").first()[1]
    with pytest.raises(ConstraintError):
        db.sql("UPDATE k SET a = 2")


def test_serial_is_dense(spark, db):
    db.sql("CREATE TABLE s (id SERIAL PRIMARY KEY, v INT)")
    db.sql("INSERT INTO s (v) VALUES (30), (10), (20)")
    db.sql("INSERT INTO s (v) VALUES (5)")
    assert rows(db.sql("SELECT id, v FROM s")) == [(1, 30), (2, 10), (3, 20), (4, 5)]
    assert db.insert("s", spark.range(100, numPartitions=7).selectExpr("id AS v")) == 100
    assert rows(db.sql("SELECT id FROM s")) == [(i,) for i in range(1, 105)]


def test_tables_in_a_from_list(db):
    db.sql("CREATE TABLE t (id INT PRIMARY KEY)")
    db.sql("CREATE TABLE z (id INT PRIMARY KEY, w TEXT)")
    db.sql("INSERT INTO t VALUES (1), (2)")
    db.sql("INSERT INTO z VALUES (2, 'from t, z'), (3, 'b')")
    assert rows(db.sql("SELECT t.id, w FROM t, z WHERE t.id = z.id")) == [(2, "from t, z")]
    assert rows(db.sql("SELECT a.id FROM t AS a, z b WHERE a.id = b.id AND b.w = 'from t, z'")) == [(2,)]
    assert rows(db.sql("SELECT id FROM (SELECT id FROM t WHERE id IN (SELECT id FROM z)) q")) == [(2,)]


def test_other_databases_are_turned_away(db):
    db.sql("CREATE TABLE t (id INT PRIMARY KEY)")
    db.sql("INSERT INTO default.t VALUES (1)")
    assert rows(db.sql("SELECT id FROM default.t")) == [(1,)]
    db.sql("CREATE DATABASE other")
    for text in ("SELECT id FROM other.t", "INSERT INTO other.t VALUES (1)", "UPDATE other.t SET id = 2", "DELETE FROM other.t"):
        with pytest.raises(DialectError):
            db.sql(text)


def test_in_lists_have_the_columns_type(db):
    db.sql("CREATE TABLE t (id INT PRIMARY KEY, name TEXT)")
    db.sql("INSERT INTO t VALUES (1, 'a'), (-2, '3')")
    assert rows(db.sql("SELECT id FROM t WHERE id IN (-2, '1')")) == [(-2,), (1,)]
    assert rows(db.sql("SELECT id FROM t WHERE name IN ('a', 'b')")) == [(1,)]
    for bad in ("id IN (1, 'x')", "id NOT IN (1.5)"):
        with pytest.raises(DialectError):
            db.sql(f"SELECT id FROM t WHERE {bad}")


def test_global_unique(db):
    db.sql("CREATE TABLE g (id INT PRIMARY KEY, mail TEXT GLOBAL UNIQUE, a INT, b INT, GLOBAL UNIQUE (a, b))")
    db.sql("INSERT INTO g VALUES (1, 'x', 1, 1), (2, NULL, 1, 2), (3, NULL, 1, 3)")
    assert db.tables["g"].global_uniques == [["mail"], ["a", "b"]] and db.tables["g"].uniques == []
    for bad in ("(4, 'x', 2, 2)", "(4, 'y', 1, 2)"):
        with pytest.raises(ConstraintError):
            db.sql(f"INSERT INTO g VALUES {bad}")
    assert "GLOBAL UNIQUE (a, b)" in db.sql("SHOW CREATE TABLE g").first()[1]


def test_not_in_without_a_broadcast(db):
    db.sql("CREATE TABLE a (id INT PRIMARY KEY, v INT)")
    db.sql("CREATE TABLE b (id INT PRIMARY KEY, w INT)")
    db.sql("INSERT INTO a VALUES (1, 1), (2, 2), (3, NULL)")
    ask = "SELECT id FROM a WHERE v NOT IN (SELECT w FROM b WHERE id > ?) AND id < 9"
    assert rows(db.sql(ask, [0])) == [(1,), (2,), (3,)]  # of nothing, a null as well
    db.sql("INSERT INTO b VALUES (1, 2)")
    assert rows(db.sql(ask, [0])) == [(1,)]
    assert rows(db.sql(ask, [1])) == [(1,), (2,), (3,)]
    db.sql("INSERT INTO b VALUES (2, NULL)")
    assert rows(db.sql(ask, [0])) == []
    plan = db.sql(ask, [0])._jdf.queryExecution().optimizedPlan().toString()
    assert "isnull((v" not in plan  # the mark of a null-aware join
    assert rows(db.sql("SELECT id FROM a WHERE NOT (id NOT IN (SELECT id FROM b))")) == [(1,), (2,)]


def test_current_time(db):
    at = db.sql("SELECT CURRENT_TIME AS t, CURRENT_TIME() AS u").first()
    assert 0 <= at["t"] < 86_400_000_000 and 0 <= at["u"] < 86_400_000_000


def test_rows_as_hashes(spark, db):
    db.sql("CREATE TABLE u (id INT PRIMARY KEY, name TEXT NOT NULL, n INT, x DOUBLE)")
    db.sql("INSERT INTO u VALUES (1, 'a', 5, NULL), (2, 'b', NULL, 1.5)")
    made = lambda data, schema: spark.createDataFrame(data, schema)
    writes = "pk string, field string, value string"
    with pytest.raises(ConstraintError):
        db.row_hashes("u")
    db.sql("ALTER TABLE u SET RESP ADAPTER ON")
    assert rows(db.row_hashes("u").where("key = 'u:2'")) == [("u:2", "id", "2"), ("u:2", "name", "b"), ("u:2", "x", "1.5")]
    assert db.row_hset("u", made([("1", "n", "6"), ("3", "name", "c"), ("3", "n", "7")], writes)) == 2
    assert rows(db.sql("SELECT id, name, n FROM u WHERE n IS NOT NULL")) == [(1, "a", 6), (3, "c", 7)]
    with pytest.raises(ConstraintError):
        db.row_hset("u", made([("4", "n", "1")], writes))  # a new row needs a name
    with pytest.raises(ConstraintError):
        db.row_hset("u", made([("1", "id", "9")], writes))
    assert db.row_hset("u", made([("2", "n", "8"), ("1", "n", "9"), ("9", "n", "9")], writes), only_null=True) == 1
    assert rows(db.sql("SELECT id, n FROM u")) == [(1, 6), (2, 8), (3, 7)]
    assert db.row_hdel("u", made([("1", "n"), ("1", "x"), ("9", "n")], "pk string, field string")) == 1
    with pytest.raises(ConstraintError):
        db.row_hdel("u", made([("1", "name")], "pk string, field string"))
    assert db.row_hincr("u", made([("1", "n", 4.0), ("2", "x", 0.25), ("2", "x", 0.25)], "pk string, field string, delta double")) == 2
    assert rows(db.sql("SELECT id, n, x FROM u WHERE id < 3").na.fill(-1)) == [(1, 4, -1.0), (2, 8, 2.0)]
    with pytest.raises(ConstraintError):
        db.row_hincr("u", made([("9", "n", 4.0)], "pk string, field string, delta double"))
    assert db.row_del("u", made([("2",), ("7",)], "pk string")) == 1
    assert rows(db.sql("SELECT id FROM u")) == [(1,), (3,)]


def test_serializable_conflict(db):
    db.sql("CREATE TABLE t (id INT PRIMARY KEY, v INT)")
    db.sql("INSERT INTO t VALUES (1, 1)")
    db.sql("BEGIN ISOLATION LEVEL SERIALIZABLE")
    db.sql("SELECT * FROM t").collect()
    mine, db.txn = db.txn, None
    db.sql("UPDATE t SET v = 2")
    db.txn = mine
    with pytest.raises(ConstraintError):
        db.sql("COMMIT")


def test_snapshots_on_disk(spark, tmp_path):
    db = Engine(spark, folder=f"file://{tmp_path}")
    db.sql("CREATE TABLE t (id INT PRIMARY KEY, amt DECIMAL(10,2))")
    db.sql("INSERT INTO t VALUES (1, 12.349), (2, -1.999)")
    assert [str(r[0]) for r in db.sql("SELECT amt FROM t ORDER BY id").collect()] == ["12.34", "-1.99"]


def test_introspection(db):
    family(db)
    assert rows(db.sql("SHOW TABLES")) == [("c",), ("g",), ("p",)]
    assert [r["Key"] for r in db.sql("DESCRIBE c").collect()] == ["PRI", ""]
    found = db.sql("SELECT column_name FROM information_schema.columns WHERE table_name = 'c' AND ordinal_position > 1")
    assert rows(found) == [("pid",)]
    assert rows(db.sql("SELECT referenced_table_name FROM information_schema.key_column_usage WHERE constraint_name <> 'PRIMARY' AND table_name = 'c'")) == [("p",)]
    assert "ON DELETE CASCADE" in db.sql("SHOW CREATE TABLE c").first()[1]
    assert db.sql("SELECT * FROM pg_catalog.pg_nothing").count() == 0
    db.sql("CREATE DATABASE other")
    db.sql("USE other")
    assert db.sql("SHOW TABLES").count() == 0


def test_dialect():
    assert translate("SELECT FROM t LIMIT 5, 10")[0] == "SELECT * FROM t LIMIT 10 OFFSET 5"
    assert "get_json_object(to_json" in translate("SELECT j->'a'->>'b' FROM t")[0]
    assert translate("SELECT a FROM t WHERE b = $2 AND c = $1", [1, 2]) == ("SELECT a FROM t WHERE b = :p1 AND c = :p0", {"p0": 1, "p1": 2})
    assert translate('SELECT "a""b" FROM t')[0] == 'SELECT `a"b` FROM t'
    assert translate("SELECT CAST(a AS TEXT) AS text FROM t")[0] == "SELECT CAST(a AS STRING) AS text FROM t"
    with pytest.raises(DialectError):
        translate("SELECT ? , $1", [1])
    for bad in ("SELECT a FROM t UNION SELECT b FROM u", "SELECT rank() OVER (ORDER BY a) FROM t", "SELECT a FROM t WHERE b = NULL", "SELECT a FROM t WHERE b LIKE '%x'", "SELECT a FROM t WHERE b IN (1, NULL)"):
        with pytest.raises(DialectError):
            translate(bad, strict=True)
    translate("SELECT a FROM t WHERE b LIKE 'x%' AND c IN (SELECT d FROM e)", strict=True)


def test_scalars(spark):
    one = spark.range(1)
    value = lambda col: one.select(col.alias("x")).first()[0]
    big = F.lit(2**63 - 1)
    assert value(scalars.add(big, F.lit(1))) is None
    assert value(scalars.divide(F.lit(7), F.lit(2))) == 3.5
    assert value(scalars.divide(F.lit(7), F.lit(0))) is None
    assert str(value(scalars.dec_trunc(F.lit("-12.349").cast("decimal(10,3)"), 10, 2))) == "-12.34"
    assert value(scalars.parse_time(F.lit("01:02:03.5"))) == 3723500000
    assert value(scalars.render_time(F.lit(3723500000))) == "01:02:03"
    assert value(scalars.uuid_text(F.lit("550E8400E29B41D4A716446655440000"))) == "550e8400-e29b-41d4-a716-446655440000"
    assert value(scalars.boolean(F.lit(""))) is False
    assert value(bits.bit_pos(F.lit(b"\xff\xf0"), 0)) == 12
    assert value(bits.bit_pos(F.lit(b"\xff"), 0)) == 8
    assert value(bits.get_bit(bits.set_bit(F.lit(b""), 20, 1), 20)) == 1
    assert value(F.hex(kv.setrange(F.lit("ab"), 4, b"x"))) == "6162000078"
    assert value(kv.getrange(F.lit("hello"), -4, -2)) == "ell"


def test_null_order_and_not(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "a int")
    assert [r[0] for r in relational.order_by(df, [("a", "asc")]).collect()] == [1, 2, None]
    assert [r[0] for r in relational.order_by(df, [("a", "asc")], nulls_least=True).collect()] == [None, 1, 2]
    assert df.where(relational.negate(F.col("a") == 1)).count() == 1
    assert df.where(relational.negate(F.col("a") == 1, two_valued=True)).count() == 2
    with pytest.raises(relational.LimitExceeded):
        relational.LIMITS["tiny"] = 2
        relational.limited(df, "tiny")


def test_collections_laws(spark):
    lst = spark.createDataFrame([("k", i, v) for i, v in enumerate("abcab")], "key string, pos long, value string")
    values = lambda df: [r["value"] for r in df.orderBy("pos").collect()]
    assert values(c.lrem(lst, F.lit("a"), 1)) == list("bcab")
    assert values(c.lrem(lst, F.lit("a"), -1)) == list("abcb")
    assert values(c.lrem(lst, F.lit("b"), 0)) == list("aca")
    assert values(c.linsert(lst, F.lit("c"), F.lit("x"))) == list("abxcab")
    assert sorted(r["place"] for r in c.lpos(lst, F.lit("b"), -1, 0).collect()) == [1, 4]
    pushed = c.push(lst, "k", spark.createDataFrame([(0, "x"), (1, "y")], "i long, value string"), left=True)
    assert values(pushed) == list("yxabcab")
    s = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3)], "key string, member int")
    union = {r[0] for r in c.sunion(s, ["a", "b"]).collect()}
    assert union == {r[0] for r in c.sunion(s, ["b", "a"]).collect()} == {1, 2, 3}
    taken, left = c.spop(s, 1)
    assert taken.count() + left.count() == 4
    table = spark.createDataFrame([("a", "1")], "key string, value string")
    more = spark.createDataFrame([("a", "2"), ("b", "3")], "key string, value string")
    assert rows(kv.put(table, more, "absent")) == [("a", "1"), ("b", "3")]
    assert rows(kv.put_all_or_none(table, more)) == [("a", "1")]
    assert rows(kv.append(table, more)) == [("a", "12"), ("b", "3")]

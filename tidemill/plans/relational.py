"""Scans, projections, filters, joins, aggregates, ordering and scalar queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import scalars
from tidemill.operators import relational as ops
from tidemill.plans.base import Registry, run_sql
from tidemill.sources import tables
from tidemill.sources.tables import load

R = Registry()

# ---- scans and sources
R.sql("scan_full", "SELECT * FROM orders")
R.sql("scan_filtered", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount >= 0.05")
R.sql("pk_lookup", "SELECT * FROM customer WHERE c_custkey = 42")
R.sql("pk_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 900 AND o_orderstatus = 'O'")
R.sql("index_range", "SELECT * FROM orders WHERE o_totalprice >= 200000 AND o_totalprice < 250000")
R.sql("covering_projection", "SELECT c_nationkey, c_custkey FROM customer WHERE c_nationkey >= 5 AND c_nationkey <= 9")
R.sql("or_index_union", "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey = 1 OR l_suppkey BETWEEN 3 AND 5")
R.sql("values_literal", "SELECT * FROM (VALUES (1, 'alice'), (2, 'bob'), (3, NULL)) AS v(id, name)")
R.sql("derived_filter", "SELECT d.flag, d.qty FROM (SELECT l_returnflag AS flag, l_quantity AS qty FROM lineitem WHERE l_discount > 0.08) d WHERE d.qty < 5")


@R.frame("key_set_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
def key_set_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = load(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    return load(spark, sf_dir, "orders").join(keys, "o_custkey", "left_semi").select("o_orderkey", "o_custkey", "o_totalprice")


@R.frame("result_json", "SELECT '{' || '\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || ',\"d\":\"' || n_nationkey || '.00\",\"b\":\"' || n_name || '\"}' AS row FROM nation")
def result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "nation").withColumn("d", F.col("n_nationkey").cast("decimal(10,2)")).withColumn("b", F.col("n_name").cast("binary"))
    return tables.to_json_rows(rows)


# ---- projections
R.sql("select_star", "SELECT * FROM supplier")
R.sql("select_alias", "SELECT s_suppkey AS id, s_name AS name, s_acctbal balance FROM supplier")
R.sql("qualified_cols", "SELECT n.n_name, n.n_regionkey FROM nation n")
R.sql("json_project", "SELECT event_id, props->>'k' AS k FROM events")
R.sql("select_literal", "SELECT 1 AS one, 'a' AS b")
R.sql("select_now", "SELECT NOW() > TIMESTAMP '2020-01-01' AS later, CURRENT_DATE = CAST(NOW() AS DATE) AS today, CURRENT_TIME BETWEEN 0 AND 86399999999 AS in_day, VERSION() AS version, @@autocommit AS var", "SELECT true AS later, true AS today, true AS in_day, 'tidemill' AS version, NULL AS var")
R.sql("select_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")

# ---- filters
R.sql("filter_cmp", "SELECT p_partkey, p_size FROM part WHERE p_size <> 10 AND p_size >= 5 AND p_retailprice < 1500 AND p_brand > 'Brand#2'")
R.sql("filter_bool", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 100000) AND (o_custkey > 10 OR o_orderkey = 1)")
R.sql("filter_in", "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 5, 9, 49) AND p_partkey NOT IN (10, 20, 30)")
R.sql("filter_between", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000")
R.sql("filter_like_prefix", "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE 'Customer#00000000%'")
R.sql(
    "filter_is_null",
    "SELECT c.c_custkey FROM customer c LEFT JOIN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) o ON c.c_custkey = o.o_custkey WHERE o.o_custkey IS NULL",
)
R.sql("json_exists", "SELECT event_id FROM events WHERE props ? 'k'", "SELECT event_id FROM events WHERE list_contains(json_keys(props), 'k')")
R.sql("filter_const", "SELECT r_regionkey FROM region WHERE 1 = 1 AND 'a' < 'b'")
R.sql("filter_const_arith", "SELECT p_partkey FROM part WHERE p_size = 2 + 3 * 4")
R.sql("filter_date", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
R.sql("in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
R.sql("not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
R.sql("scalar_subquery", "SELECT p_partkey FROM part WHERE p_retailprice = (SELECT MAX(p_retailprice) FROM part)")
R.sql("exists_uncorrelated", "SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 100000)")
R.sql("exists_correlated", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
R.sql("not_exists_correlated", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")

# ---- joins
R.sql("join_inner", "SELECT c.c_name, o.o_orderkey, o.o_totalprice FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 200000")
R.sql("join_left", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 300000) o ON c.c_custkey = o.o_custkey")
R.sql("join_right", "SELECT o.o_orderkey, c.c_custkey FROM (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 300000) o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey")
R.sql(
    "join_full",
    """SELECT c.c_custkey, o.o_orderkey FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0) c
    FULL JOIN (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 200000) o ON c.c_custkey = o.o_custkey""",
)
R.sql("join_cross", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n")
R.sql(
    "join_three_way",
    """SELECT c.c_name, o.o_orderkey, l.l_linenumber, l.l_quantity FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey
    JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE l.l_quantity >= 49""",
)
R.sql(
    "join_multi_key",
    """SELECT a.l_orderkey, a.l_linenumber, b.l_tax FROM lineitem a JOIN lineitem b
    ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_quantity > 48""",
)
R.sql("join_residual", "SELECT c.c_custkey, o.o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > c.c_acctbal * 20")
R.sql("join_using", "SELECT a.x, b.y FROM (SELECT n_regionkey AS k, n_name AS x FROM nation) a JOIN (SELECT r_regionkey AS k, r_name AS y FROM region) b USING (k)")
R.sql("join_where", "SELECT s.s_name, n.n_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE s.s_acctbal > 0 AND n.n_regionkey IN (1, 2)")
R.sql("join_derived", "SELECT d.o_custkey, d.n, c.c_name FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) d JOIN customer c ON c.c_custkey = d.o_custkey WHERE d.n > 12")
R.sql(
    "join_aggregate",
    """SELECT n.n_name, COUNT(*) AS n_orders, ROUND(SUM(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
    JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name""",
)

# ---- aggregates
R.sql(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(AVG(l_discount), 6) AS avg_disc,
    ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem
    WHERE l_shipdate <= TIMESTAMP '1998-09-02' AND l_discount BETWEEN 0.01 AND 0.09
    GROUP BY l_returnflag, l_linestatus HAVING COUNT(*) > 1 ORDER BY l_returnflag NULLS FIRST, l_linestatus NULLS FIRST""",
)
R.sql("agg_global", "SELECT COUNT(*) AS n, SUM(v) AS s FROM (SELECT o_custkey AS v FROM orders WHERE o_orderkey < 0) t", "SELECT COUNT(*) AS n, SUM(v)::BIGINT AS s FROM (SELECT o_custkey AS v FROM orders WHERE o_orderkey < 0) t")
R.sql("agg_group_by", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority")
R.sql("agg_count_star", "SELECT COUNT(*) AS n FROM lineitem")
R.sql("agg_count_col", "SELECT COUNT(x) AS n FROM (SELECT NULLIF(l_linestatus, 'O') AS x FROM lineitem) t")
R.sql("agg_count_distinct", "SELECT event_type, COUNT(DISTINCT user_id) AS users FROM events GROUP BY event_type")
R.sql(
    "agg_sum",
    "SELECT l_returnflag, SUM(l_suppkey) AS s, ROUND(SUM(l_tax), 4) AS t, SUM(CAST(l_linenumber AS DECIMAL(10,2))) AS d FROM lineitem GROUP BY l_returnflag",
    "SELECT l_returnflag, SUM(l_suppkey)::BIGINT AS s, ROUND(SUM(l_tax), 4) AS t, SUM(CAST(l_linenumber AS DECIMAL(10,2)))::DECIMAL(20,2) AS d FROM lineitem GROUP BY l_returnflag",
)
R.sql("agg_avg", "SELECT l_linestatus, ROUND(AVG(l_quantity), 6) AS q, ROUND(AVG(l_extendedprice), 4) AS p FROM lineitem GROUP BY l_linestatus")
R.sql("agg_min_max", "SELECT o_orderstatus, MIN(o_orderdate) AS first, MAX(o_totalprice) AS top, MIN(o_orderpriority) AS p FROM orders GROUP BY o_orderstatus")
R.sql("agg_expr", "SELECT l_returnflag, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS rev, ROUND(SUM((l_quantity + 1) * l_tax), 2) AS t FROM lineitem GROUP BY l_returnflag")
R.sql("agg_having", "SELECT o_custkey, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING COUNT(*) > 10 AND NOT (SUM(o_totalprice) < 1000000)")
R.sql("agg_order_limit", "SELECT o_custkey, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey ORDER BY total DESC, o_custkey LIMIT 10 OFFSET 5")


@R.frame(
    "stats_approx_distinct",
    "SELECT 'l_orderkey' AS column, count(*) AS rows, min(l_orderkey)::VARCHAR AS min, max(l_orderkey)::VARCHAR AS max, true AS near FROM lineitem UNION ALL SELECT 'l_suppkey', count(*), min(l_suppkey)::VARCHAR, max(l_suppkey)::VARCHAR, true FROM lineitem UNION ALL SELECT 'l_returnflag', count(*), min(l_returnflag), max(l_returnflag), true FROM lineitem",
)
def stats_approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The approximate numbers are held against the exact ones: a sketch of this size is within a few per cent."""
    columns, rows = ["l_orderkey", "l_suppkey", "l_returnflag"], load(spark, sf_dir, "lineitem")
    exact = rows.agg(*(F.countDistinct(c).alias(c) for c in columns)).select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("exact")) for c in columns))))
    near = F.abs(F.col("approx_distinct") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * 0.2)
    return ops.column_statistics(rows, columns).join(exact, "column").select("column", "rows", "min", "max", near.alias("near"))


# ---- ordering
@R.frame("order_multi", "SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_brand DESC, p_size, p_partkey")
def order_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.order_by(load(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), [("p_brand", "desc"), ("p_size", "asc"), ("p_partkey", "asc")])


R.sql("limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20, 15", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 20")
R.sql("topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")

# ---- scalars
@R.frame("arith_try", "SELECT l_orderkey, l_linenumber, l_partkey * 3 + l_suppkey - l_linenumber AS x FROM lineitem")
def arith_try(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = scalars.subtract(scalars.add(scalars.multiply(F.col("l_partkey"), F.lit(3)), F.col("l_suppkey")), F.col("l_linenumber").cast("long"))
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x"))


@R.frame("arith_div", "SELECT l_orderkey, l_linenumber, l_partkey / NULLIF(l_linenumber - 1, 0) AS x FROM lineitem")
def arith_div(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalars.divide(F.col("l_partkey"), F.col("l_linenumber") - 1).alias("x"))


R.frame("arith_mod", "SELECT l_orderkey, l_linenumber, l_partkey % nullif(l_linenumber - 1, 0) AS x FROM lineitem")(
    lambda spark, sf_dir: load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalars.modulo(F.col("l_partkey"), (F.col("l_linenumber") - 1).cast("long")).alias("x"))
)
R.sql("json_arrow", "SELECT event_id, props->'k' AS k FROM events", "SELECT event_id, (props->'k')::VARCHAR AS k FROM events")
R.sql("json_arrow_text", "SELECT event_id, props->>'k' AS k, props->>'none' AS missing FROM events")


@R.frame("cast_dates", "SELECT o_orderkey, o_orderdate::DATE AS day, strftime(o_orderdate, '%Y-%m-%d') AS text, strptime(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS at FROM orders")
def cast_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("o_orderdate")
    return load(spark, sf_dir, "orders").select("o_orderkey", scalars.parse_date(F.date_format(at, "yyyy-MM-dd")).alias("day"), F.date_format(at, "yyyy-MM-dd").alias("text"), scalars.parse_timestamp(F.date_format(at, "yyyy-MM-dd HH:mm:ss")).alias("at"))


@R.frame("uuid_normalize", "SELECT c_custkey, regexp_replace(md5(c_name), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS u FROM customer")
def uuid_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select("c_custkey", scalars.uuid_text(F.upper(F.md5(F.col("c_name").cast("binary")))).alias("u"))


@R.frame("decimal_truncate", "SELECT p_partkey, (CASE WHEN x < 0 THEN ceil(x * 10) ELSE floor(x * 10) END / 10)::DECIMAL(18,1) AS d FROM (SELECT p_partkey, (p_size * 0.37 - 9)::DECIMAL(18,2) AS x FROM part)")
def decimal_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = (F.col("p_size").cast("decimal(10,0)") * F.lit("0.37").cast("decimal(4,2)") - 9).cast("decimal(18,2)")
    return load(spark, sf_dir, "part").select("p_partkey", scalars.dec_trunc(x, 18, 1).alias("d"))


@R.frame("decimal_average", "SELECT l_returnflag, round(AVG(l_linenumber), 4) AS a FROM lineitem GROUP BY l_returnflag")
def decimal_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").withColumn("d", F.col("l_linenumber").cast("decimal(18,2)"))
    return rows.groupBy("l_returnflag").agg(F.round(scalars.avg_decimal(F.col("d"), 2).cast("double"), 4).alias("a"))


@R.frame("insert_coercion", "SELECT * FROM (VALUES (1::BIGINT, true, DATE '2020-01-02', 12.34::DECIMAL(10,2)), (NULL, false, NULL, NULL)) AS v(i, b, d, n)")
def insert_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = tables.values(spark, [("1", "yes", "2020-01-02", "12.349"), ("x", "", "2020-13-40", None)], "i string, b string, d string, n string")
    return raw.select(scalars.coerce(F.col("i"), "BIGINT").alias("i"), scalars.coerce(F.col("b"), "BOOLEAN").alias("b"), scalars.coerce(F.col("d"), "DATE").alias("d"), scalars.coerce(F.col("n"), "DECIMAL(10,2)").alias("n"))


R.queries["prepared_params"] = lambda spark, sf_dir: run_sql(spark, sf_dir, "SELECT o_orderkey FROM orders WHERE o_custkey = $1 OR o_totalprice > $2", [7, 400000.0])
R.oracle["prepared_params"] = "SELECT o_orderkey FROM orders WHERE o_custkey = 7 OR o_totalprice > 400000.0"
R.queries["positional_params"] = lambda spark, sf_dir: run_sql(spark, sf_dir, "SELECT c_custkey FROM customer WHERE c_nationkey = ? AND c_acctbal > ?", [3, 100.0])
R.oracle["positional_params"] = "SELECT c_custkey FROM customer WHERE c_nationkey = 3 AND c_acctbal > 100.0"

QUERIES, ORACLE = R.queries, R.oracle

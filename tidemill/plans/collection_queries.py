"""Queries over key-value tables and collections that are derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import bits, geo
from tidemill.operators import collections as c
from tidemill.operators import kv as k
from tidemill.plans.base import Registry
from tidemill.sources.tables import kv, load, values

R = Registry()

# ---- the collections, for both engines
Z_SQL = "z AS (SELECT event_type AS key, user_id AS member, round(sum(value), 2) AS score FROM events GROUP BY 1, 2)"
H_SQL = "h AS (SELECT user_id AS key, event_type AS field, round(sum(value), 2) AS value FROM events GROUP BY 1, 2)"
S_SQL = "s AS (SELECT DISTINCT o_orderpriority AS key, o_custkey AS member FROM orders)"
L_SQL = "l AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type AS value, count(*) OVER (PARTITION BY user_id) AS n FROM events)"
B_SQL = "b AS (SELECT event_type AS key, bit_or(1::UBIGINT << (event_id % 64)::INTEGER) AS v FROM events GROUP BY 1)"
PRIORITIES_SQL = "t AS (SELECT k, row_number() OVER (ORDER BY k) AS i FROM (SELECT DISTINCT o_orderpriority AS k FROM orders))"
KINDS_SQL = "t AS (SELECT event_type AS k, row_number() OVER (ORDER BY event_type) AS i FROM (SELECT DISTINCT event_type FROM events))"


def zset(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").groupBy(F.col("event_type").alias("key"), F.col("user_id").alias("member")).agg(F.round(F.sum("value"), 2).alias("score"))


def hashes(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").groupBy(F.col("user_id").alias("key"), F.col("event_type").alias("field")).agg(F.round(F.sum("value"), 2).alias("value"))


def sets(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select(F.col("o_orderpriority").alias("key"), F.col("o_custkey").alias("member")).distinct()


def lists(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "events").select(F.col("user_id").alias("key"), "ts", "event_id", F.col("event_type").alias("value"))
    return k.ranked(events, ["key"], [F.col("ts"), F.col("event_id")], "pos").select("key", "pos", "value")


def bitmaps(spark: SparkSession, d: str) -> DataFrame:
    word = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("event_id") % 64).cast("int")))
    return load(spark, d, "events").groupBy(F.col("event_type").alias("key")).agg(F.unhex(F.lpad(F.hex(word), 16, "0")).alias("value"))


# The keys that the queries ask for, as a caller would name them: values of the benchmark's schema, in order.
KINDS = ["click", "error", "purchase", "signup", "view"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def one_of(keys: list[str], n: Column) -> Column:
    """The key that member n asks for."""
    return F.element_at(F.array(*map(F.lit, keys)), (F.pmod(n, F.lit(len(keys))) + 1).cast("int"))


def customers(spark: SparkSession, d: str) -> DataFrame:
    return kv(load(spark, d, "customer"), "c_custkey", "c_name")


# ---- key-value
KV_SQL = "SELECT c_custkey::VARCHAR AS key, c_name AS value FROM customer"
R.frame("kv_scan_range", f"SELECT * FROM ({KV_SQL}) WHERE key >= '10' AND key < '13' AND key LIKE '11%' ORDER BY key LIMIT 20")(lambda s, d: k.scan(customers(s, d), "10", "13", "11", 20))
R.frame("kv_list_prefix", f"SELECT * FROM ({KV_SQL}) WHERE key LIKE '7%'")(lambda s, d: k.scan(customers(s, d), prefix="7"))


@R.frame("kv_list_typed", "SELECT c_custkey::VARCHAR AS key, CASE c_custkey % 3 WHEN 0 THEN 'i64' WHEN 1 THEN 'f64' ELSE 'str' END AS kind, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey::BIGINT END AS i, CASE WHEN c_custkey % 3 = 1 THEN c_acctbal END AS f, CASE WHEN c_custkey % 3 = 2 THEN c_name END AS s FROM customer")
def kv_list_typed(s: SparkSession, d: str) -> DataFrame:
    m = F.col("c_custkey") % 3
    tag = F.when(m == 0, "i64").when(m == 1, "f64").otherwise("str")
    value = F.when(m == 0, F.col("c_nationkey").cast("string")).when(m == 1, F.col("c_acctbal").cast("string")).otherwise(F.col("c_name"))
    return load(s, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), k.typed(value, tag).alias("t")).select("key", "t.*")


ASKED_SQL = "a AS (SELECT * FROM (VALUES (0, '5'), (1, 'none'), (2, '17'), (3, '5')) AS v(ordinal, key))"


def asked(s: SparkSession) -> DataFrame:
    return values(s, [(0, "5"), (1, "none"), (2, "17"), (3, "5")], "ordinal int, key string")


R.frame("kv_mget", f"WITH {ASKED_SQL}, c AS ({KV_SQL}) SELECT a.ordinal, a.key, c.value FROM a LEFT JOIN c ON a.key = c.key")(lambda s, d: k.get_many(customers(s, d), asked(s)))


@R.frame("kv_get_many", f"WITH {ASKED_SQL} SELECT a.ordinal, a.key, CASE WHEN c_custkey IS NULL THEN NULL ELSE 'f64' END AS kind, c_acctbal AS f FROM a LEFT JOIN customer ON a.key = c_custkey::VARCHAR")
def kv_get_many(s: SparkSession, d: str) -> DataFrame:
    balances = load(s, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), k.typed(F.col("c_acctbal").cast("string"), F.lit("f64")).alias("value"))
    return k.get_many(balances, asked(s)).select("ordinal", "key", "value.kind", "value.f")


R.frame("kv_exists", f"WITH {ASKED_SQL}, c AS ({KV_SQL}) SELECT count(*) AS n FROM a JOIN c ON a.key = c.key")(lambda s, d: k.exists(customers(s, d), asked(s)))


@R.frame("kv_incr_fold", "SELECT coalesce(c.key, e.key) AS key, coalesce(c.v, 0) + coalesce(e.delta, 0) AS value FROM (SELECT c_custkey AS key, c_nationkey::BIGINT AS v FROM customer) c FULL JOIN (SELECT user_id AS key, count(*) AS delta FROM events GROUP BY 1) e ON c.key = e.key")
def kv_incr_fold(s: SparkSession, d: str) -> DataFrame:
    table = load(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("long").alias("value"))
    return k.increments(table, load(s, d, "events").select(F.col("user_id").alias("key"), F.lit(1).cast("long").alias("delta")))


R.frame("kv_strlen", f"SELECT key, strlen(value)::INTEGER AS n FROM ({KV_SQL})")(lambda s, d: customers(s, d).select("key", k.strlen(F.col("value")).alias("n")))
R.frame("kv_getrange", f"SELECT key, substring(value, 10, 4) AS a, right(value, 3) AS b FROM ({KV_SQL})")(lambda s, d: customers(s, d).select("key", k.getrange(F.col("value"), 9, 12).alias("a"), k.getrange(F.col("value"), -3, -1).alias("b")))
R.frame("kv_upsert", "SELECT c_custkey::VARCHAR AS key, CASE WHEN c_acctbal < 0 THEN 'new' ELSE c_name END AS value FROM customer UNION ALL SELECT 'extra', 'new'")(
    lambda s, d: k.put(customers(s, d), kv(load(s, d, "customer").where("c_acctbal < 0").withColumn("v", F.lit("new")), "c_custkey", "v").unionByName(values(s, [("extra", "new")], "key string, value string")))
)

# ---- hashes
R.frame("hash_hmget", f"WITH {H_SQL}, {KINDS_SQL}, a AS (SELECT u.user_id AS key, t.k AS field FROM (SELECT DISTINCT user_id FROM events) u JOIN t ON t.i = u.user_id % 5 + 1) SELECT a.key, a.field, h.value FROM a LEFT JOIN h ON a.key = h.key AND a.field = h.field")(
    lambda s, d: c.hmget(hashes(s, d), load(s, d, "events").select(F.col("user_id").alias("key")).distinct().select("key", one_of(KINDS, F.col("key")).alias("field")))
)
R.frame("hash_getall", f"WITH {H_SQL} SELECT key, string_agg(field || '=' || round(value * 100)::BIGINT, ',' ORDER BY field) AS entries FROM h GROUP BY key")(
    lambda s, d: c.hgetall(hashes(s, d)).select("key", F.array_join(F.transform("entries", lambda e: F.concat(e["field"], F.lit("="), F.round(e["value"] * 100).cast("long").cast("string"))), ",").alias("entries"))
)
R.frame("hash_len", f"WITH {H_SQL} SELECT key, count(*) AS n FROM h GROUP BY key")(lambda s, d: c.hlen(hashes(s, d)))
R.frame("hash_incr", "SELECT user_id AS key, event_type AS field, count(*) + 1 AS value FROM events GROUP BY 1, 2")(
    lambda s, d: c.hincr(hashes(s, d).select("key", "field", F.lit(1).cast("long").alias("value")), load(s, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("field"), F.lit(1).cast("long").alias("delta")))
)
R.frame("hash_take_n", f"WITH {H_SQL} SELECT key, field, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY field) AS r FROM h) WHERE r <= 2")(lambda s, d: c.htake(hashes(s, d), 2))
R.sql("hquery", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3 AND c_acctbal >= 0 ORDER BY c_custkey LIMIT 100")
R.frame("row_as_hash", "SELECT 'nation:' || n_nationkey AS key, unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS field, unnest([n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR]) AS value FROM nation")(lambda s, d: c.rows_as_hash(load(s, d, "nation"), "nation", "n_nationkey"))
R.frame("hash_as_row", "SELECT 'nation:' || n_nationkey AS key, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")(lambda s, d: c.hash_as_rows(c.rows_as_hash(load(s, d, "nation"), "nation", "n_nationkey"), ["n_name", "n_regionkey"]))


# ---- sets
_M = lambda i: f"(SELECT member FROM s JOIN t ON s.key = t.k WHERE t.i = {i})"
_SETS = f"WITH {S_SQL}, {PRIORITIES_SQL}"
R.frame("sets_inter", f"{_SETS} SELECT * FROM {_M(1)} INTERSECT SELECT * FROM {_M(2)}")(lambda s, d: c.sinter(sets(s, d), PRIORITIES[:2]))
R.frame("sets_union", f"{_SETS} SELECT * FROM {_M(1)} UNION SELECT * FROM {_M(2)}")(lambda s, d: c.sunion(sets(s, d), PRIORITIES[:2]))
R.frame("sets_diff", f"{_SETS} SELECT * FROM {_M(1)} EXCEPT SELECT * FROM {_M(2)}")(lambda s, d: c.sdiff(sets(s, d), PRIORITIES[:2]))
R.frame("sets_intercard", f"{_SETS} SELECT least(count(*), 20) AS n FROM (SELECT * FROM {_M(1)} INTERSECT SELECT * FROM {_M(2)})")(lambda s, d: c.sintercard(sets(s, d), PRIORITIES[:2], 20))
R.frame("sets_store", f"{_SETS}, x AS (SELECT * FROM {_M(1)} INTERSECT SELECT * FROM {_M(2)}) SELECT t.k AS key, x.member FROM x, t WHERE t.i = 1 UNION ALL SELECT s.key, s.member FROM s JOIN t ON s.key = t.k WHERE t.i > 1")(
    lambda s, d: c.sstore(sets(s, d), PRIORITIES[:2][0], c.sinter(sets(s, d), PRIORITIES[:2]))
)
R.frame("set_ismember", f"{_SETS}, a AS (SELECT t.k AS key, c_custkey AS member FROM customer JOIN t ON t.i = c_custkey % 5 + 1) SELECT a.key, a.member, s.member IS NOT NULL AS is_member FROM a LEFT JOIN s ON a.key = s.key AND a.member = s.member")(
    lambda s, d: c.sismember(sets(s, d), load(s, d, "customer").select(one_of(PRIORITIES, F.col("c_custkey")).alias("key"), F.col("c_custkey").alias("member")))
)
R.frame("set_card", f"WITH {S_SQL} SELECT key, count(*) AS n FROM s GROUP BY key")(lambda s, d: c.scard(sets(s, d)))
R.frame("set_members", f"WITH {S_SQL} SELECT member FROM s, (SELECT min(key) AS k FROM s) m WHERE s.key = m.k")(lambda s, d: c.members_of(sets(s, d), PRIORITIES[0]))
R.frame("set_take_n", f"WITH {S_SQL} SELECT key, member FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY member) AS r FROM s) WHERE r <= 7")(lambda s, d: c.stake(sets(s, d), -7))

# ---- lists
R.frame("list_pop", f"WITH {L_SQL} SELECT key, pos, value, n - 1 - pos AS popped FROM l WHERE n - 1 - pos < 2")(lambda s, d: c.lpop(lists(s, d), 2, right=True))
R.frame("list_range", f"WITH {L_SQL} SELECT key, pos, value, pos AS rank FROM l WHERE pos >= 1 AND pos <= n - 2")(lambda s, d: c.lrange(lists(s, d), 1, -2))
R.frame("list_index", f"WITH {L_SQL} SELECT key, pos, value, pos AS rank FROM l WHERE pos = n - 1")(lambda s, d: c.lindex(lists(s, d), -1))
R.frame("list_trim", f"WITH {L_SQL} SELECT key, pos, value FROM l WHERE pos >= greatest(n - 5, 0) AND pos <= n - 2")(lambda s, d: c.ltrim(lists(s, d), -5, -2).withColumn("pos", F.col("pos")))
_W = f"WITH {L_SQL}, w AS (SELECT min(value) AS v FROM l)"
R.frame("list_rem", f"{_W}, m AS (SELECT l.*, sum((value = v)::INTEGER) OVER (PARTITION BY key ORDER BY pos DESC) AS nth, value = v AS hit FROM l, w) SELECT key, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS pos, value FROM m WHERE NOT (hit AND nth <= 2)")(
    lambda s, d: c.lrem(lists(s, d), F.lit(KINDS[0]), -2)
)
R.frame("list_pos", f"{_W}, m AS (SELECT key, pos, row_number() OVER (PARTITION BY key ORDER BY pos) AS nth FROM l, w WHERE value = v) SELECT key, pos AS place FROM m WHERE nth >= 2 AND nth < 4")(lambda s, d: c.lpos(lists(s, d), F.lit(KINDS[0]), 2, 2))
R.frame("list_insert", f"{_W}, f AS (SELECT key, min(pos) AS p0 FROM l, w WHERE value = v GROUP BY key), u AS (SELECT key, pos * 2 AS p, value FROM l UNION ALL SELECT key, p0 * 2 + 1, 'x' FROM f) SELECT key, row_number() OVER (PARTITION BY key ORDER BY p) - 1 AS pos, value FROM u")(
    lambda s, d: c.linsert(lists(s, d), F.lit(KINDS[0]), F.lit("x"), after=True)
)
R.frame("list_set", f"WITH {L_SQL} SELECT key, pos, CASE WHEN pos = n - 1 THEN 'last' ELSE value END AS value FROM l")(lambda s, d: c.lset(lists(s, d), -1, F.lit("last")))

# ---- sorted sets
R.frame("zset_incr", f"WITH {Z_SQL} SELECT key, member, round(score + 1.5, 2) AS score FROM z")(lambda s, d: c.zincr(zset(s, d), zset(s, d).select("key", "member", F.lit(1.5).alias("delta"))).withColumn("score", F.round("score", 2)))
R.frame("zset_mscore", f"WITH {Z_SQL}, {KINDS_SQL}, a AS (SELECT t.k AS key, c_custkey AS member FROM customer JOIN t ON t.i = c_custkey % 5 + 1) SELECT a.key, a.member, z.score FROM a LEFT JOIN z ON a.key = z.key AND a.member = z.member")(
    lambda s, d: c.zmscore(zset(s, d), load(s, d, "customer").select(one_of(KINDS, F.col("c_custkey")).alias("key"), F.col("c_custkey").alias("member")))
)
_P = f"WITH {Z_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS up, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS down, count(*) OVER (PARTITION BY key) AS n FROM z)"
R.frame("zset_range", f"{_P} SELECT key, member, score, up AS rank FROM p WHERE up >= 2 AND up <= n - 3")(lambda s, d: c.zrange(zset(s, d), 2, -3))
R.frame("zset_revrange", f"{_P} SELECT key, member, score, down AS rank FROM p WHERE down <= 9")(lambda s, d: c.zrange(zset(s, d), 0, 9, reverse=True))
R.frame("zset_rangebyscore", f"WITH {Z_SQL} SELECT * FROM z WHERE score BETWEEN 100 AND 300")(lambda s, d: c.zrangebyscore(zset(s, d), 100, 300))
R.frame("zset_count", f"WITH {Z_SQL} SELECT key, count(*) AS n FROM z WHERE score >= 50 GROUP BY key")(lambda s, d: c.zcount(zset(s, d), 50, float("inf")))
R.frame("zset_rank", f"{_P} SELECT key, member, score, up AS rank FROM p")(lambda s, d: c.zrank(zset(s, d)))
R.frame("zset_popmin", f"{_P} SELECT key, member, score, up AS rank FROM p WHERE up < 3")(lambda s, d: c.zpop(zset(s, d), 3))
R.frame("zset_union_sum", f"WITH {Z_SQL}, {KINDS_SQL} SELECT member, round(sum(score), 2) AS score FROM z JOIN t ON z.key = t.k WHERE t.i <= 2 GROUP BY member")(lambda s, d: c.zstore(zset(s, d), KINDS[:2]).withColumn("score", F.round("score", 2)))
R.frame("zset_inter_sum", f"WITH {Z_SQL}, {KINDS_SQL} SELECT member, round(sum(score), 2) AS score FROM z JOIN t ON z.key = t.k WHERE t.i <= 2 GROUP BY member HAVING count(*) = 2")(lambda s, d: c.zstore(zset(s, d), KINDS[:2], intersect=True).withColumn("score", F.round("score", 2)))

# ---- positions
LON, LAT = "(c_custkey % 360 - 180 + 0.5)", "(c_custkey % 170 - 85 + 0.5)"


def _spread_sql(x: str) -> str:
    return "(" + " | ".join(f"((({x} >> {i}) & 1) << {2 * i})" for i in range(geo.STEPS)) + ")"


def _squash_sql(x: str) -> str:
    return "(" + " | ".join(f"((({x} >> {2 * i}) & 1) << {i})" for i in range(geo.STEPS)) + ")"


_CELLS = f"g AS (SELECT c_custkey, floor(({LON} + 180.0) / 360.0 * {1 << geo.STEPS})::BIGINT AS x, floor(({LAT} + {geo.MAX_LAT}) / {2 * geo.MAX_LAT} * {1 << geo.STEPS})::BIGINT AS y FROM customer)"
_CODES = f"e AS (SELECT c_custkey, {_spread_sql('x')} | ({_spread_sql('y')} << 1) AS code FROM g)"
_BACK = f"p AS (SELECT c_custkey, ({_squash_sql('code')} + 0.5::DOUBLE) / {1 << geo.STEPS}::DOUBLE * 360 - 180 AS lon, ({_squash_sql('(code >> 1)')} + 0.5::DOUBLE) / {1 << geo.STEPS}::DOUBLE * {2 * geo.MAX_LAT}::DOUBLE - {geo.MAX_LAT}::DOUBLE AS lat FROM e)"


def _hav(lon: str, lat: str) -> str:
    return f"2 * {geo.EARTH_RADIUS}::DOUBLE * asin(sqrt(pow(sin((radians({lat}) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians({lat})) * pow(sin((radians({lon}) - radians(lon)) / 2), 2)))"


def points(s: SparkSession, d: str) -> DataFrame:
    lon, lat = F.col("c_custkey") % 360 - 180 + 0.5, F.col("c_custkey") % 170 - 85 + 0.5
    return load(s, d, "customer").select(F.col("c_custkey").alias("member"), geo.encode(lon, lat).alias("code"))


R.frame("geo_encode", f"WITH {_CELLS}, {_CODES} SELECT c_custkey AS member, code FROM e")(points)


@R.frame("geo_decode", f"WITH {_CELLS}, {_CODES}, {_BACK} SELECT c_custkey AS member, round(lon, 6) AS lon, round(lat, 6) AS lat FROM p")
def geo_decode(s: SparkSession, d: str) -> DataFrame:
    lon, lat = geo.decode(F.col("code"))
    return points(s, d).select("member", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@R.frame("geo_dist", f"WITH {_CELLS}, {_CODES}, {_BACK} SELECT c_custkey AS member, round({_hav('116.397128::DOUBLE', '39.916527::DOUBLE')}, 3) AS dist FROM p")
def geo_dist(s: SparkSession, d: str) -> DataFrame:
    lon, lat = geo.decode(F.col("code"))
    return points(s, d).select("member", F.round(geo.distance(lon, lat, F.lit(116.397128), F.lit(39.916527)), 3).alias("dist"))


@R.frame("geo_search", f"WITH {_CELLS}, {_CODES}, {_BACK}, q AS (SELECT c_custkey AS member, {_hav('10.5::DOUBLE', '20.25::DOUBLE')} / 1000 AS dist FROM p) SELECT member, round(dist, 3) AS dist FROM q WHERE dist <= 3000 ORDER BY q.dist, member LIMIT 50")
def geo_search(s: SparkSession, d: str) -> DataFrame:
    near = geo.search(points(s, d), 10.5, 20.25, 3000, "km")
    return near.orderBy("dist", "member").limit(50).select("member", F.round("dist", 3).alias("dist"))


# ---- bitmaps
R.frame("bit_get", f"WITH {B_SQL} SELECT key, ((v >> 53) & 1)::INTEGER AS b10, ((v >> 0) & 1)::INTEGER AS b63, 0 AS b90 FROM b")(lambda s, d: bitmaps(s, d).select("key", *(bits.get_bit(F.col("value"), i).alias(f"b{i}") for i in (10, 63, 90))))
R.frame("bit_count", f"WITH {B_SQL} SELECT key, bit_count(v)::BIGINT AS n, bit_count((v >> 8) & 65535)::BIGINT AS part FROM b")(lambda s, d: bitmaps(s, d).select("key", bits.bit_count(F.col("value")).alias("n"), bits.bit_count(F.col("value"), -3, -2).alias("part")))
R.frame("bit_pos", f"WITH {B_SQL}, f AS (SELECT key, instr(lpad(bin(v), 64, '0'), '1') - 1 AS one, instr(lpad(bin(v), 64, '0'), '0') - 1 AS zero FROM b) SELECT key, one::BIGINT AS one, (CASE WHEN zero < 0 THEN 64 ELSE zero END)::BIGINT AS zero FROM f")(
    lambda s, d: bitmaps(s, d).select("key", bits.bit_pos(F.col("value"), 1).alias("one"), bits.bit_pos(F.col("value"), 0).alias("zero"))
)
R.frame("bit_set", f"WITH {B_SQL} SELECT key, bit_count(v | (1::UBIGINT << 60) | 1::UBIGINT)::BIGINT AS n FROM b")(lambda s, d: bitmaps(s, d).select("key", bits.bit_count(bits.set_bit(bits.set_bit(F.col("value"), 3, 1), 63, 1)).alias("n")))

# ---- writes: each gives the next table
POOR = "c_acctbal < 0"


def poor(s: SparkSession, d: str) -> DataFrame:
    """Keys of the customers in debt, and some that are not there."""
    return kv(load(s, d, "customer").where(POOR).withColumn("v", F.lit("new")), "c_custkey", "v").unionByName(values(s, [("x1", "new"), ("x2", "new")], "key string, value string"))


_POOR_SQL = f"w AS (SELECT c_custkey::VARCHAR AS key, 'new' AS value FROM customer WHERE {POOR} UNION ALL SELECT 'x1', 'new' UNION ALL SELECT 'x2', 'new'), c AS ({KV_SQL})"
R.frame("kv_del", f"WITH {_POOR_SQL} SELECT * FROM c WHERE key NOT IN (SELECT key FROM w)")(lambda s, d: k.delete(customers(s, d), poor(s, d)))
R.frame("kv_setnx", f"WITH {_POOR_SQL} SELECT * FROM c UNION ALL SELECT * FROM w WHERE key NOT IN (SELECT key FROM c)")(lambda s, d: k.put(customers(s, d), poor(s, d), "absent"))
R.frame("kv_msetnx", f"{KV_SQL} UNION ALL SELECT 'x1', 'new' UNION ALL SELECT 'x2', 'new'")(lambda s, d: k.put_all_or_none(k.put_all_or_none(customers(s, d), poor(s, d)), poor(s, d).where("key LIKE 'x%'")))
R.frame("kv_getset", f"WITH {_POOR_SQL} SELECT w.key, c.value FROM w LEFT JOIN c ON w.key = c.key")(lambda s, d: k.getset(customers(s, d), poor(s, d))[0])
R.frame("kv_getdel", f"WITH {_POOR_SQL} SELECT w.key, c.value FROM w LEFT JOIN c ON w.key = c.key")(lambda s, d: k.getdel(customers(s, d), poor(s, d))[0])
R.frame("kv_type", f"WITH {_POOR_SQL} SELECT key, CASE WHEN key LIKE 'x%' THEN 'none' ELSE 'string' END AS type FROM w")(lambda s, d: k.kind(customers(s, d), poor(s, d).select("key")))
R.frame("kv_append", f"WITH {_POOR_SQL} SELECT coalesce(c.key, w.key) AS key, coalesce(c.value, '') || coalesce(w.value, '') AS value FROM c FULL JOIN w ON c.key = w.key")(lambda s, d: k.append(customers(s, d), poor(s, d)))
R.frame("kv_setrange", f"SELECT key, substring(value, 1, 3) || 'XY' || substring(value, 6) AS value FROM ({KV_SQL})")(lambda s, d: customers(s, d).select("key", k.setrange(F.col("value"), 3, b"XY").cast("string").alias("value")))
R.frame("kv_incrbyfloat", "SELECT c_custkey AS key, round(c_acctbal + coalesce(e.d, 0), 2) AS value FROM customer LEFT JOIN (SELECT user_id, sum(value) AS d FROM events GROUP BY 1) e ON c_custkey = e.user_id UNION ALL SELECT user_id, round(sum(value), 2) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer) GROUP BY 1")(
    lambda s, d: k.increments_float(load(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value")), load(s, d, "events").select(F.col("user_id").alias("key"), F.col("value").alias("delta"))).withColumn("value", F.round("value", 2))
)
_ONE = f"WITH {H_SQL}, w AS (SELECT user_id AS key, 'click' AS field, 1.5::DOUBLE AS value FROM events GROUP BY 1 UNION ALL SELECT -1, 'click', 2.5)"


def writes(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "events").select(F.col("user_id").alias("key")).distinct().select("key", F.lit("click").alias("field"), F.lit(1.5).alias("value")).unionByName(values(s, [(-1, "click", 2.5)], "key long, field string, value double"))


R.frame("hash_set", f"{_ONE} SELECT * FROM h WHERE (key, field) NOT IN (SELECT key, field FROM w) UNION ALL SELECT * FROM w")(lambda s, d: c.hset(hashes(s, d), writes(s, d)))
R.frame("hash_setnx", f"{_ONE} SELECT * FROM h UNION ALL SELECT * FROM w WHERE (key, field) NOT IN (SELECT key, field FROM h)")(lambda s, d: c.hset(hashes(s, d), writes(s, d), only_new=True))
R.frame("hash_del", f"{_ONE} SELECT * FROM h WHERE field <> 'click'")(lambda s, d: c.hdel(hashes(s, d), writes(s, d).select("key", "field")))
_MORE = f"{_SETS}, w AS (SELECT t.k AS key, c_custkey AS member FROM customer JOIN t ON t.i = c_custkey % 5 + 1)"
asked_members = lambda s, d, keys: load(s, d, "customer").select(one_of(keys, F.col("c_custkey")).alias("key"), F.col("c_custkey").alias("member"))
R.frame("set_add", f"{_MORE} SELECT * FROM s UNION SELECT * FROM w")(lambda s, d: c.sadd(sets(s, d), asked_members(s, d, PRIORITIES)))
R.frame("set_rem", f"{_MORE} SELECT * FROM s EXCEPT SELECT * FROM w")(lambda s, d: c.srem(sets(s, d), asked_members(s, d, PRIORITIES)))
R.frame("set_pop", f"WITH {S_SQL} SELECT key, member FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY member) AS r FROM s) WHERE r > 4")(lambda s, d: c.spop(sets(s, d), 4)[1])
_SCORES = f"WITH {Z_SQL}, {KINDS_SQL}, w AS (SELECT t.k AS key, c_custkey AS member, 7.25::DOUBLE AS score FROM customer JOIN t ON t.i = c_custkey % 5 + 1)"
R.frame("zset_add", f"{_SCORES} SELECT * FROM z WHERE (key, member) NOT IN (SELECT key, member FROM w) UNION ALL SELECT * FROM w")(lambda s, d: c.zadd(zset(s, d), asked_members(s, d, KINDS).withColumn("score", F.lit(7.25))))
R.frame("zset_rem", f"{_SCORES} SELECT * FROM z WHERE (key, member) NOT IN (SELECT key, member FROM w)")(lambda s, d: c.zrem(zset(s, d), asked_members(s, d, KINDS)))
R.frame("zset_revrank", f"{_P} SELECT key, member, score, down AS rank FROM p")(lambda s, d: c.zrank(zset(s, d), reverse=True))
R.frame("zset_popmax", f"{_P} SELECT key, member, score, down AS rank FROM p WHERE down < 3")(lambda s, d: c.zpop(zset(s, d), 3, largest=True))
_PUSHED = f"WITH {L_SQL}, f AS (SELECT min(key) AS k FROM l)"
for _name, _left, _at in (("list_lpush", True, "-1 - i"), ("list_rpush", False, "(SELECT max(pos) FROM l, f WHERE key = k) + 1 + i")):
    R.frame(_name, f"{_PUSHED} SELECT key, pos, value FROM l UNION ALL SELECT k, {_at}, v FROM f, (VALUES (0, 'x'), (1, 'y')) AS n(i, v)")(
        lambda s, d, left=_left: c.push(lists(s, d), load(s, d, "events").agg(F.min("user_id")).first()[0], values(s, [(0, "x"), (1, "y")], "i long, value string"), left)
    )

QUERIES, ORACLE = R.queries, R.oracle

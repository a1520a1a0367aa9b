"""Secret scans with DataFrame functions alone: base patterns, and how widely each found value is spread over repositories and owners.

Per kind, matches are leftmost and do not overlap. Spark gives the matches (regexp_extract_all) and what stands between them (split), both from
the same left-to-right search, so sums of their lengths are the offsets. Documents without a match pay one search for each kind.

The method. Each value found, base or `blob` (a long run of letters and digits of all three classes, which the base patterns may
miss), is hashed; candidates are aggregated by distinct repository and distinct owner. A value in at least EXAMPLE_OWNERS owners is an
example that people copy; the others look live, in however many repositories of fewer owners they are, so that size alone never clears one. A blob gives a span of its own only where it looks live
and no base span covers it; base spans always stay.

Defined results: a null text is empty; a null owner counts as one owner; a null id counts as one repository; rows that repeat
another keep a row each; no match gives zeros, the SHA-256 of nothing and an empty list of spans; a very long text is searched whole; an empty table
gives no rows; columns of scan()'s input may have any names but base and blobs, and those of judged() any but its results'.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, stored, table

# Fixed values of the contract, in the order in which kinds are listed. (The least length is checked on the match, except for hex and access: there
# a run that is too short holds no match that is long enough, so the length may stand in the pattern.)
KINDS = ("assign", "access", "hex", "blob")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
ASSIGN_LEAST = 6
#: Added by the method.
BLOB = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}"
EXAMPLE_OWNERS = 6


def matches(text: Column, kind: str, pattern: str, value: Column | None = None) -> Column:
    """array<struct<start, end, kind, rank, value>> of all matches, by start; offsets count code points, end is exclusive."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    values = found if value is None else value
    none = F.array().cast("array<struct<start:int,end:int,kind:string,rank:int,value:string>>")

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        one = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("rank"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    zipped = F.transform(found, lambda hit, i: F.struct(F.get(between, i).alias("gap"), hit.alias("hit"), F.get(values, i).alias("value")))
    walked = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda acc: acc["out"])
    return F.when(F.rlike(text, F.lit(pattern)), walked).otherwise(none)


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with `base` and `blobs`, arrays of spans; base is ordered by start, then kind as listed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    assign = F.filter(matches(text, "assign", ASSIGN, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(1))), lambda s: F.length(s["value"]) >= ASSIGN_LEAST)
    base = F.concat(assign, matches(text, "access", ACCESS), matches(text, "hex", HEX))
    shaped = lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), F.sha2(s["value"], 256).alias("hash"))
    base = F.array_sort(F.transform(base, shaped))
    mixed = lambda v: v.rlike("[a-z]") & v.rlike("[A-Z]") & v.rlike("[0-9]")
    blobs = F.filter(matches(text, "blob", BLOB), lambda s: mixed(s["value"]))
    return docs.withColumn("base", base).withColumn("blobs", F.transform(blobs, shaped))


def ownership(candidates: DataFrame, repo: str, owner: str) -> DataFrame:
    """(hash, repos, owners, n, example): over how many distinct repositories and owners each value is spread."""
    no = F.lit("\x00")
    seen = candidates.groupBy("hash", F.coalesce(F.col(owner).cast("string"), no).alias("o"), F.coalesce(F.col(repo).cast("string"), no).alias("r")).agg(F.count("*").alias("n"))
    by_owner = seen.groupBy("hash", "o").agg(F.countDistinct("r").alias("r"), F.sum("n").alias("n"))
    # A repository belongs to one owner, so the numbers of repositories add up.
    spread = by_owner.groupBy("hash").agg(F.sum("r").alias("repos"), F.count("*").alias("owners"), F.sum("n").alias("n"))
    return spread.withColumn("example", F.col("owners") >= EXAMPLE_OWNERS)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def judged(scanned: DataFrame, repo: str = "doc_id", owner: str = "source") -> DataFrame:
    """scanned (base and blobs of scan(), no texts) with `spans`: base and live-looking blobs, each with `example`, in order."""
    hit = (F.size("base") > 0) | (F.size("blobs") > 0)
    names = scanned.columns
    kept = stored(scanned, "secret-scan")
    # Rows that are the same in all columns share their verdict; their number is kept.
    some = kept.where(hit).groupBy(*names).agg(F.count("*").alias("__rows"))
    every = some.select(*names, "__rows", F.explode(F.concat("base", "blobs")).alias("s"))
    candidates = every.select("*", F.col("s.hash").alias("hash"))
    spread = stored(ownership(kept.where(hit).select(repo, owner, F.explode(F.concat("base", "blobs")).alias("s")).select(repo, owner, "s.hash"), repo, owner), "secret-owners")
    total = spread.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    verdict = lookup(candidates, spread.select("hash", F.struct("example", "owners", "repos").alias("verdict"), F.col("n").alias("__n")), "hash", "verdict", "__n", total)
    of_span = F.struct(*(F.col(f"s.{c}").alias(c) for c in ("start", "rank", "end", "kind")), F.col("verdict.example").alias("example"), F.col("verdict.owners").alias("owners"), F.col("verdict.repos").alias("repos"))
    back = verdict.groupBy(*names, "__rows").agg(F.array_sort(F.collect_list(of_span)).alias("__all"))
    base = F.filter("__all", lambda s: s["kind"] != "blob")
    clear = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    spans = F.filter("__all", lambda s: (s["kind"] != "blob") | (~s["example"] & clear(s)))
    back = back.withColumn("spans", spans).drop("__all").select("*", F.explode(F.sequence(F.lit(1), F.col("__rows")))).drop("__rows", "col")
    return back.unionByName(kept.where(~hit).withColumn("spans", F.array().cast(back.schema["spans"].dataType)))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with the spans that look live replaced by mark; overlapping ones by one."""
    live = F.filter(spans, lambda s: ~s["example"])

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(live, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")
    out = judged(docs)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    live = F.size(F.filter("spans", lambda s: ~s["example"])).cast("long")
    return out.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), live.alias("n_live"))


def _sql() -> str:
    """The same in SQL. Its engine has no look-behind; leftmost greedy matches of runs begin where a run does all the same."""
    quoted = lambda p: "'" + re.sub(r"\(\?<!.*?\]\)", "", p).replace("'", "''") + "'"
    found = [(k, quoted(p), group) for k, p, group in zip(KINDS, (ASSIGN, ACCESS, HEX, BLOB), (1, 0, 0, 0))]
    each = "\nUNION ALL ".join(f"SELECT rid, doc_id, source, '{k}' AS kind, {i} AS rank, regexp_extract_all(t, {p}, 0) AS hits, regexp_extract_all(t, {p}, {g}) AS vals, string_split_regex(t, {p}) AS gaps FROM d WHERE regexp_matches(t, {p})" for i, (k, p, g) in enumerate(found))
    lengths = lambda x: f"coalesce(list_sum(list_transform({x}, lambda y: length(y))), 0)"
    said = "kind || ':' || s || ':' || e"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
m AS ({each}),
u AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m),
p AS (SELECT rid, doc_id, source, kind, rank, vals[i] AS v, hits[i] AS hit, ({lengths('gaps[1:i]')} + {lengths('hits[1:i-1]')})::BIGINT AS s FROM u),
c AS (SELECT *, s + length(hit) AS e FROM p WHERE CASE kind WHEN 'assign' THEN length(v) >= {ASSIGN_LEAST} WHEN 'blob' THEN regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]') ELSE true END),
o AS (SELECT v, count(DISTINCT coalesce(source, chr(0))) >= {EXAMPLE_OWNERS} AS example FROM c GROUP BY v),
j AS (SELECT c.*, o.example FROM c JOIN o ON c.v = o.v),
k AS (SELECT * FROM j WHERE kind <> 'blob' OR (NOT example AND NOT EXISTS (SELECT 1 FROM j b WHERE b.rid = j.rid AND b.kind <> 'blob' AND b.s < j.e AND j.s < b.e))),
g AS (SELECT rid, sum((kind = 'assign')::INTEGER)::BIGINT AS n_assign, sum((kind = 'access')::INTEGER)::BIGINT AS n_access, sum((kind = 'hex')::INTEGER)::BIGINT AS n_hex,
  string_agg(CASE WHEN kind <> 'blob' THEN {said} END, ',' ORDER BY s, rank) AS base, string_agg({said}, ',' ORDER BY s, rank) AS spans, sum((NOT example)::INTEGER)::BIGINT AS n_live FROM k GROUP BY rid)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live FROM d LEFT JOIN g ON d.rid = g.rid
"""


QUERIES = {"op5_secrets": op5_secrets}
ORACLE = {"op5_secrets": _sql()}

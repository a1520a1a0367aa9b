"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

Reading. A scan cuts each archive at every occurrence of the record magic, inside payloads too. Each piece is a candidate record whose
header tells the offset of its successor. Within a task, candidates whose successor is the very next candidate are contracted to runs;
over the runs, pointer jumping from the start of each file (rounds: the logarithm of the runs of a file) finds those that are reachable.
A candidate before the entry of its run, or in a run that is never entered, is payload, and goes back to the record that holds it.
A candidate whose piece has no blank line has the magic in its header (a url may hold it): its header goes on to the first blank line in the
pieces after it, which tells its successor.

Offsets need no second scan: a block's first piece starts where the pieces of the blocks before it end.

Defined results: a null payload is written as an empty one; a null url leaves out the target header; rows that repeat both id and payload are
each a response; a null id is written without one and comes back null; an empty table gives no record. A record with an unreadable
header ends its file's chain there. A very long payload is one record; one with the magic inside is put together in the task that gets its pieces. Columns of pages
besides the three may have any names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import arrow_map, lookup, new_path, stored, table

# Fixed values of the format.
MAGIC = "WARC/1."
CRLF = "\r\n"
END = CRLF + CRLF
ID_PREFIX = "urn:page:"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hexadecimal: Column) -> Column:
    """Upper-case base32 of a hexadecimal string of whole groups of 20 bits, such as a SHA-1."""
    groups = [F.lpad(F.conv(F.substring(hexadecimal, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> None:
    """A record per row under path. Of equal payloads of at least min_bytes, the row with the smallest id is a response, the others revisit it."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("sha1"), F.octet_length(payload).cast("long").alias("bytes"))
    same = rows.where(F.col("bytes") >= min_bytes).groupBy("sha1").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    total = pages.count()
    rows = lookup(rows, same.where("n > 1"), "sha1", "first", "n", total)
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    line = lambda name, value: F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)))
    uri = lambda c: F.concat(F.lit(f"<{ID_PREFIX}"), c.cast("string"), F.lit(">"))
    record = F.concat(
        F.lit(f"{MAGIC}1{CRLF}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(CRLF),
        line("WARC-Record-ID", uri(F.col("id"))),
        F.lit(f"WARC-Date: {DATE}{CRLF}"),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")),
        line("WARC-Refers-To", F.when(revisit, uri(F.col("first")))),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("sha1")),
        F.lit(f"{CRLF}Content-Type: application/http;msgtype=response{CRLF}Content-Length: "), F.octet_length("block").cast("string"), F.lit(END),
        F.col("block"),
    )
    rows.withColumn("block", block).select(record.alias("value")).write.option("lineSep", END).text(path)


SEGMENT = T.StructType(
    [T.StructField("file", T.StringType()), T.StructField("block", T.LongType()), T.StructField("idx", T.LongType())]
    + [T.StructField("start", T.LongType()), T.StructField("size", T.LongType()), T.StructField("succ", T.LongType()), T.StructField("run", T.LongType())]
    + [T.StructField("head", T.IntegerType()), T.StructField("content", T.LongType()), T.StructField("headers", T.MapType(T.StringType(), T.StringType())), T.StructField("whole", T.BooleanType()), T.StructField("raw", T.BinaryType())]
)
SEGMENT_ARROW = pa.schema([("file", pa.string()), ("block", pa.int64()), ("idx", pa.int64()), ("start", pa.int64()), ("size", pa.int64()), ("succ", pa.int64()), ("run", pa.int64()), ("head", pa.int32()), ("content", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("whole", pa.bool_()), ("raw", pa.binary())])


def parse_headers(head: bytes) -> dict[str, str]:
    """Named fields, names in lower case; continuation lines join the field before them."""
    out, last = {}, None
    for line in head.decode("utf-8", "replace").split(CRLF)[1:]:
        if line[:1] in " \t" and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            out[last := last.strip().lower()] = value.strip()
    return out


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates with offsets from the start of their block. size: up to the next candidate."""
    here, idx, at, run, expected = None, 0, 0, 0, None
    size = len(MAGIC)
    for batch in batches:
        rows, kept = [], 0
        for file, block, raw in zip(batch["file"].to_pylist(), batch["block"].to_pylist(), batch["raw"]):
            raw = raw.as_py()
            if (file, block) != here:
                here, idx, at, expected = (file, block), 0, 0, None
            head = raw.find(b"\r\n\r\n")
            head = len(raw) if head < 0 else head
            headers, succ, content, start = {}, None, None, at - size
            if idx or block:  # what stands before the first magic of a file is no candidate
                headers = parse_headers(raw[:head])
                if (n := headers.get("content-length", "")).isascii() and n.isdigit():
                    content = int(n)
                    succ = at + head + 4 + content + 4
            if start != expected:
                run = idx
            expected = succ
            rows.append((file, block, idx, start, len(raw) + size, succ, run, head, content, list(headers.items()), content is not None and len(raw) == head + content + 8, raw))
            idx, at, kept = idx + 1, at + len(raw) + size, kept + len(raw)
            if kept > 8_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SEGMENT_ARROW)], schema=SEGMENT_ARROW)
                rows, kept = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SEGMENT_ARROW)], schema=SEGMENT_ARROW)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under path: file, offset, headers (a map, names in lower case), block (binary)."""
    text = spark.read.option("lineSep", MAGIC).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    raw = text.select("file", "block", F.col("value").cast("binary").alias("raw"))
    found = stored(raw.mapInArrow(_segments, SEGMENT), "warc-candidates")

    blocks = found.groupBy("file", "block").agg(F.sum("size").alias("bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block of one archive
    blocks = blocks.select("file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    candidates = found.select("file", "block", "idx", "run", "start", "size", "succ", "head", "content", "whole").join(blocks, ["file", "block"])
    candidates = stored(candidates.select("file", "block", "idx", "run", (F.col("start") + F.col("base")).alias("start"), (F.col("succ") + F.col("base")).alias("succ"), "head", "content", (F.col("head") == F.col("size") - len(MAGIC)).alias("open"), "whole"), "warc-chain")
    torn_heads = candidates.where((F.col("start") >= 0) & F.col("open")).select("file").distinct()
    if not torn_heads.isEmpty():
        torn_heads = stored(torn_heads, "warc-open")
        whole_heads = candidates.join(torn_heads, "file", "left_anti")
        candidates = stored(whole_heads.unionByName(_with_whole_heads(candidates.join(torn_heads, "file", "left_semi"))), "warc-chain")

    tails = candidates.groupBy("file", "block", "run").agg(F.max_by("succ", "idx").alias("target"), F.min("start").alias("head"))
    node = F.struct("block", "run")
    landing = candidates.where(F.col("start") >= 0).select("file", F.col("start").alias("target"), F.struct("block", "run").alias("next"))
    jumps = stored(tails.where(F.col("target").isNotNull()).select("file", node.alias("node"), "target").join(landing, ["file", "target"]), "warc-jumps")
    starts = candidates.where(F.col("start") == 0).select("file", node.alias("node"))
    reached = stored(_jumped(starts, jumps), "warc-reached")

    entries = starts.withColumn("entry", F.lit(0).cast("long")).unionByName(jumps.join(reached, ["file", "node"], "left_semi").select("file", F.col("next").alias("node"), F.col("target").alias("entry")))
    entries = entries.groupBy("file", "node").agg(F.min("entry").alias("entry")).select("file", "node.block", "node.run", "entry").join(blocks, ["file", "block"])
    entries = stored(entries, "warc-entries")  # a row for each run; payloads are only moved if there are very many runs
    reachable = found.join(entries, ["file", "block", "run"]).where(F.col("start") + F.col("base") >= F.col("entry"))
    kept = reachable.withColumn("offset", F.col("start") + F.col("base"))
    one = kept.where("whole").select("file", "offset", "headers", F.expr("substring(raw, head + 5, content)").alias("block"))
    if candidates.where((F.col("start") >= 0) & F.col("succ").isNotNull() & ~F.col("whole")).isEmpty():
        return one
    chain = candidates.join(entries.select("file", "block", "run", "entry"), ["file", "block", "run"]).where(F.col("start") >= F.col("entry"))
    kept = chain.where(F.col("succ").isNotNull()).select("file", "block", "idx", F.col("start").alias("offset"), "whole")
    torn = kept.where(~F.col("whole")).select("file").distinct()
    # Records with the magic in their header or payload: each piece of such a file goes to the last kept record at or before it.
    narrow = candidates.select("file", "block", "idx", "start").join(torn, "file", "left_semi").join(kept.select("file", "block", "idx", "offset"), ["file", "block", "idx"], "left")
    owner = F.last("offset", ignorenulls=True).over(Window.partitionBy("file").orderBy("start"))
    owned = narrow.select("file", "block", "idx", "start", owner.alias("offset")).where(F.col("offset").isNotNull())
    pieces = owned.join(found, ["file", "block", "idx"]).select("file", "offset", owned["start"], "raw", "whole")
    glued = pieces.groupBy("file", "offset").agg(F.sort_array(F.collect_list(F.struct("start", "raw"))).alias("all"), F.min_by("whole", "start").alias("whole")).where(~F.col("whole"))
    return one.unionByName(arrow_map(glued.select("file", "offset", F.transform("all", lambda x: x["raw"]).alias("pieces")), _parsed, one.schema))


def _with_whole_heads(candidates: DataFrame) -> DataFrame:
    """candidates, with `succ` of those whose header goes on in the pieces after them. A length is the last one before the blank line."""
    order = Window.partitionBy("file").orderBy("start")
    # A piece with a blank line ends a stretch of pieces without.
    stretch = F.coalesce(F.sum((~F.col("open")).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = Window.partitionBy("file", "stretch").orderBy("start").rowsBetween(0, Window.unboundedFollowing)
    end = F.last(F.when(~F.col("open"), F.col("start") + len(MAGIC) + F.col("head")), ignorenulls=True).over(after)
    content = F.last("content", ignorenulls=True).over(after)
    succ = F.when(F.col("open") & (F.col("start") >= 0), end + 4 + content + 4).otherwise(F.col("succ"))
    return candidates.withColumn("stretch", stretch).withColumn("succ", succ).drop("stretch")


def _parsed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(file, offset, headers, block) of records put together again."""
    headers, blocks = [], []
    for pieces in batch["pieces"].to_pylist():
        head, _, rest = b"".join(x for raw in pieces for x in (MAGIC.encode(), raw)).partition(b"\r\n\r\n")
        found = parse_headers(head)
        headers.append(list(found.items()))
        blocks.append(rest[: int(found["content-length"])])
    yield pa.RecordBatch.from_arrays([batch["file"], batch["offset"], pa.array(headers, pa.map_(pa.string(), pa.string())), pa.array(blocks, pa.binary())], names=["file", "offset", "headers", "block"])


def _jumped(starts: DataFrame, jumps: DataFrame) -> DataFrame:
    """All nodes reachable from starts over (file, node, next), by pointer jumping."""
    reached, links, n = stored(starts, "warc-jump"), jumps.select("file", "node", "next"), -1
    while (now := reached.count()) != n:
        n = now
        step = reached.join(links, ["file", "node"]).select("file", F.col("next").alias("node"))
        reached = stored(reached.unionByName(step).distinct(), "warc-jump")
        twice = links.select("file", F.col("node").alias("origin"), F.col("next").alias("node")).join(links, ["file", "node"])
        links = stored(twice.select("file", F.col("origin").alias("node"), "next"), "warc-jump")
    return reached


PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
PAGE_ARROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])


def digests(records: DataFrame) -> DataFrame:
    """What each record says of its payload; a response's length and digest are those of the bytes read."""

    def page(uri: str | None) -> int | None:
        return int(uri.strip("<>").removeprefix(ID_PREFIX)) if uri else None

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for headers, block in zip(batch["headers"].to_pylist(), batch["block"]):
            h, block = dict(headers), block.as_py()
            head, _, payload = block.partition(b"\r\n\r\n")
            if h.get("warc-type") == "revisit":
                size, digest = int(parse_headers(head)["content-length"]), h["warc-payload-digest"].removeprefix("sha1:")
            else:
                size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
            rows.append((page(h.get("warc-record-id")), size, digest, h.get("warc-type"), page(h.get("warc-refers-to")), h.get("warc-target-uri")))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PAGE_ARROW)], schema=PAGE_ARROW)

    return arrow_map(records.select("headers", "block"), run, PAGE)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return digests(read_warc(spark, path)).drop("url")


_GROUP = lambda i: f"('0x' || substr(h, {1 + 5 * i}, 5))::BIGINT"
_DIGEST = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({_GROUP(i)} >> {5 * j}) & 31)::INTEGER + 1, 1)" for i in range(8) for j in (3, 2, 1, 0))
QUERIES = {"op1_warc": op1_warc}
ORACLE = {
    "op1_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, strlen(t)::BIGINT AS payload_bytes, {_DIGEST} AS payload_digest, CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""
}

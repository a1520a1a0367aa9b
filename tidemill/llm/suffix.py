"""Exact removal of repeated passages: every byte covered by a string of `least` bytes that also starts anywhere else.

1. Winnowing. Of the GRAM-byte hashes in each window of `least` bytes the smallest is an anchor, so equal windows have equal anchors at equal
   places, in whatever document they are. A window can only repeat if its anchor does; other text is never looked at again.
2. Around each anchor that occurs twice stand all windows that it was chosen for: its context, less than 2 * least bytes. Equal contexts
   of an anchor count as one with a number; alone with its copies, or with copies at all, it is covered whole.
3. The other contexts are grouped by anchor and meet in tasks of bounded size: their Burrows-Wheeler transform is taken, and intervals are expanded
   breadth-first by backward extension. Each level fixes the longest common prefixes of one length more; the expansion stops at `least`. Entries
   not fixed by then share `least` bytes with their neighbour.
4. An anchor with more than HOT contexts (a passage in very many documents) is not gathered: the windows in a range of starts share a core; cores
   are counted by hash instead, over ever smaller RANGES down to single windows, and partial sums make that independent of any group's size.
5. Covered ranges go back to all copies of a context, and each document's union is cut out.

Defined results: a null text is empty; texts below `least` bytes lose nothing; matches never cross documents; rows with one id and
different texts are told apart by their texts; rows that repeat id and text get equal results, and repeat each other; a null id is an id like others; a very
long text is one row of its batch; an empty table gives no rows; columns besides id and text may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnp
from .common import arrow_map, discard, stored, table

LEAST = 400
GRAM = 64
#: Bytes of contexts whose transform is taken at once, and contexts of an anchor that may meet in one task.
TASK_BYTES = 900_000
HOT = 1500
RANGES = (85, 17, 4, 1)
#: Characters in the first sort key, nine bits each.
SEED = 7


# ---- anchors


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbours."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    whole = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    whole[: len(x)] = x
    rows = whole.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors_of(body: np.ndarray, at: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, ...]:
    """Positions of the anchors in all rows, their hashes, their rows, and the first and last start of the windows that each was chosen for."""
    none = np.zeros(0, np.int64)
    if len(body) < least:
        return none, none.astype(np.uint64), none, none, none
    c = textnp.prefix_hash(body)
    starts = np.arange(len(body) - gram + 1)
    h = textnp.range_hash(c, starts, starts + gram)
    order = (h & np.uint64(0xFFFFFFFF00000000)) | starts.astype(np.uint64)
    best = (sliding_least(order, least - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)  # for each start of a window
    fits = np.zeros(len(best) + 1, np.int64)
    for s, e in zip(at[:-1], at[1:]):
        if e - s >= least:
            fits[s] += 1
            fits[e - least + 1] -= 1
    start = np.flatnonzero(np.cumsum(fits[:-1]) > 0)
    if not len(start):
        return none, none.astype(np.uint64), none, none, none
    best = best[start]
    first = np.flatnonzero(np.concatenate(([True], best[1:] != best[:-1])))  # a later window never chooses an earlier anchor
    last = np.concatenate((first[1:], [len(best)])) - 1
    chosen = best[first]
    return chosen, h[chosen], np.searchsorted(at, chosen, "right") - 1, start[first], start[last]


ANCHORS = "anchor long, ctx binary, doc_id long, mark long, start int, size int, lead int"


def anchor_rows(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """A row for each anchor: its hash, its context's fingerprint, and where the context is."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        body, at = textnp.bytes_of(batch["text"])
        pos, h, row, s, e = anchors_of(body, at, least, gram)
        if not len(pos):
            return
        e = e + least
        data = body.tobytes()
        ctx = [xxhash.xxh3_128_digest(data[a:b], seed=p - a) for a, b, p in zip(s.tolist(), e.tolist(), pos.tolist())]
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [pa.array(h.view(np.int64)), pa.array(ctx, pa.binary()), batch["doc_id"].take(take), batch["mark"].take(take), pa.array((s - at[row]).astype(np.int32)), pa.array((e - s).astype(np.int32)), pa.array((pos - s).astype(np.int32))],
            names=["anchor", "ctx", "doc_id", "mark", "start", "size", "lead"],
        )

    return arrow_map(docs.select("doc_id", "mark", "text"), run, ANCHORS)


# ---- the transform


def suffix_order(codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by their first `depth` codes at least (codes below 512), and the first SEED codes of each sorted position as a key."""
    n = len(codes)
    padded = np.concatenate((codes.astype(np.uint64), np.zeros(SEED, np.uint64)))
    key = np.zeros(n, np.uint64)
    for j in range(SEED):
        key = (key << np.uint64(9)) | padded[j : j + n]
    order = np.argsort(key).astype(np.int32)
    sorted_key = key[order]
    rank = np.zeros(n + 1, np.int32)
    number = np.arange(n, dtype=np.int32)

    def spread(starts: np.ndarray) -> np.ndarray:
        """For each place, the start of its group."""
        return np.repeat(number[: len(starts)][starts], np.diff(np.concatenate((np.flatnonzero(starts), [len(starts)]))))

    head = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
    rank[order] = spread(head)
    lonely = head & np.concatenate((head[1:], [True]))
    active, h = order[~lonely], SEED
    # Three ranks make a key where they fit into it, so the depth triples in each round; else two.
    fold = 3 if n < 1 << 21 else 2
    bits = np.uint64(21 if fold == 3 else 32)
    while h < depth and len(active):
        old = rank[active]
        k = old.astype(np.uint64)
        for j in range(1, fold):
            k = (k << bits) | rank[np.minimum(active + j * h, n)].astype(np.uint64)
        o = np.argsort(k)
        active, k, old = active[o], k[o], old[o]
        first = np.concatenate(([True], old[1:] != old[:-1]))
        place = old + number[: len(old)] - spread(first)
        order[place] = active
        new = np.concatenate(([True], k[1:] != k[:-1]))
        rank[active] = place[spread(new)]
        active = active[~(new & np.concatenate((new[1:], [True])))]
        h *= fold
    return order, sorted_key


def shared_prefixes(codes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order, and which entries share `least` codes with the entry before; code 0 separates, and begins and ends codes.

    Entries whose first `least` codes hold a separator may be marked among themselves, never with others.
    """
    n = len(codes)
    order, key = suffix_order(codes, least)
    bwt = codes[order - 1]
    by_char = np.argsort(bwt, kind="stable")
    by_char = by_char.astype(np.int32)
    last_to_first = np.empty(n, np.int32)
    last_to_first[by_char] = np.arange(n, dtype=np.int32)
    same = bwt[by_char][1:] == bwt[by_char][:-1]
    before, after = np.full(n, -1, np.int32), np.full(n, n, np.int32)
    before[by_char[1:][same]] = by_char[:-1][same]
    after[by_char[:-1][same]] = by_char[1:][same]
    fixed = np.zeros(n + 1, bool)
    fixed[0] = fixed[n] = True
    # Prefixes below SEED are told by the sort keys. Level SEED: the strings of SEED codes after which the common prefix is one less.
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    ends = np.concatenate((cut[1:], [n]))
    differ = np.zeros(len(cut), np.uint64)
    differ[:-1] = key[cut[1:]] ^ key[cut[:-1]]
    fixed[cut] = True
    last_only = (differ < np.uint64(512)) | (ends == n)
    lo, hi = cut[last_only], ends[last_only]
    for _ in range(SEED, least):
        if not len(lo):
            break
        size = hi - lo
        begin = np.cumsum(size) - size
        i = np.arange(int(size.sum())) + np.repeat(lo - begin, size)
        real = bwt[i] != 0
        first = real & (before[i] < np.repeat(lo, size))
        last = real & (after[i] >= np.repeat(hi, size))
        # Extended intervals of one level are disjoint, so sorted ends belong to sorted starts.
        lo, hi = np.sort(last_to_first[i[first]]), np.sort(last_to_first[i[last]]) + 1
        new = ~fixed[hi]
        lo, hi = lo[new], hi[new]
        fixed[hi] = True
    return order, ~fixed[:n]


def covered(contexts: list[bytes], where: np.ndarray, number: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each context the start of the first and the end of the last repeated window (-1: none).

    where: a number for the physical place of each context's first byte, of which consecutive bytes have consecutive ones; number: copies of each context.
    All windows of a context share its anchor, so the union of repeated ones has no gap.
    """
    sizes = np.array([len(c) for c in contexts])
    begin = np.cumsum(sizes + 1) - sizes
    codes = np.zeros(int(begin[-1] + sizes[-1]) + 1, np.int16)
    owner = np.full(len(codes), -1)
    for i, (s, c) in enumerate(zip(begin, contexts)):
        codes[s : s + len(c)] = np.frombuffer(c, np.uint8)
        codes[s : s + len(c)] += 1
        owner[s : s + max(0, len(c) - least + 1)] = i  # starts of whole windows
    order, shared = shared_prefixes(codes, least)
    own = owner[order]
    place = np.where(own >= 0, where[own] + order - begin[own], -1)
    head = np.flatnonzero(~shared)
    group = np.cumsum(~shared) - 1
    differs = np.minimum.reduceat(place, head) != np.maximum.reduceat(place, head)
    many = np.maximum.reduceat(np.where(own >= 0, number[own], 0), head) > 1
    hit = (own >= 0) & (differs | many)[group]
    lo, hi = np.full(len(contexts), np.iinfo(np.int64).max), np.full(len(contexts), -1)
    start = order[hit] - begin[own[hit]]
    np.minimum.at(lo, own[hit], start)
    np.maximum.at(hi, own[hit], start + least)
    return np.where(hi < 0, -1, lo), hi


SPANS = "anchor long, ctx binary, lo int, hi int"


def interval_spans(contexts: DataFrame, least: int) -> DataFrame:
    """contexts (anchor, ctx, doc_id, mark, start, n, bytes): the covered part of those that have one."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        names: dict[tuple, int] = {}
        where = np.array([(names.setdefault((d, m), len(names)) << 40) + s for _, _, d, m, s, _, _ in rows], np.int64)
        lo, hi = covered([r[6] for r in rows], where, np.array([r[5] for r in rows]), least)
        found = np.flatnonzero(hi >= 0)
        return pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i in found], pa.int64()), pa.array([rows[i][1] for i in found], pa.binary()), pa.array(lo[found].astype(np.int32)), pa.array(hi[found].astype(np.int32))], names=["anchor", "ctx", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("anchor", "ctx", "doc_id", "mark", "start", "n", "bytes"))):
                if size >= TASK_BYTES and row[0] != last:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(row)
                size, last = size + len(row[6]), row[0]
        if rows:
            yield solve(rows)

    return contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, SPANS)


def counted_spans(contexts: DataFrame, least: int, gram: int) -> DataFrame:
    """The same for anchors with very many contexts, without gathering them: (anchor, ctx, anchor_at, bytes).

    A range is a number of consecutive starts of windows, counted from the farthest one before the anchor. Contexts that agree in all bytes of a
    range have all its windows in common; those that only agree in its core, the bytes of every window in it, may have some, and are taken
    apart further, one for each kind of range.
    """
    starts = least - gram + 1

    def digest(anchor: int, offset: int, data: bytes) -> bytes:
        return xxhash.xxh3_128_digest(data, seed=(anchor * 1_000_003 + offset) & (2**64 - 1))

    def ranges_of(size: int, parent: int):
        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            rows = []
            for anchor, ctx, at, data, parents in zip(*(batch[c].to_pylist() for c in ("anchor", "ctx", "anchor_at", "bytes", "open"))):
                far = at - (least - gram)
                for p in parents:
                    stop = min(starts, p + parent)
                    for o in range(p, stop, size):
                        end = min(stop, o + size) - 1
                        a, b = max(0, far + o), min(len(data) - least, far + end)  # a document's edges clip a range
                        if a <= b:
                            core = data[far + end : far + o + least]
                            rows.append((anchor, ctx, a, b, o, digest(anchor, o, core), digest(anchor, o, b"%d,%d:" % (a - far - o, b - a) + data[a : b + least])))
            if rows:
                kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["anchor", "ctx", "a", "b", "o", "core", "sub"])

        return run

    contexts = contexts.select("anchor", "ctx", "anchor_at", "bytes")
    work, parent, found = contexts.withColumn("open", F.array(F.lit(0))), starts, None
    for size in RANGES:
        level = stored(arrow_map(work, ranges_of(size, parent), "anchor long, ctx binary, a int, b int, o int, core binary, sub binary"), "suffix-ranges")
        subs = level.groupBy("core", "sub").agg(F.count("*").alias("copies"), F.min(F.struct("anchor", "ctx", "o")).alias("one"))
        several = subs.groupBy("core").agg(F.count("*").alias("kinds"))
        subs = stored(subs.join(several, "core").select("sub", "copies", "kinds", "one"), "suffix-cores")
        placed = level.join(subs.where("copies > 1").select("sub"), "sub", "left_semi").groupBy("anchor", "ctx").agg(F.min("a").alias("lo"), (F.max("b") + least).alias("hi"))
        found = placed if found is None else found.unionByName(placed)
        again = subs.where("kinds > 1").select("one.*").groupBy("anchor", "ctx").agg(F.collect_list("o").alias("open"))
        work, parent = contexts.join(again, ["anchor", "ctx"]), size
    return found.groupBy("anchor", "ctx").agg(F.min("lo").cast("int").alias("lo"), F.max("hi").cast("int").alias("hi"))


# ---- documents


def repeats(docs: DataFrame, least: int, gram: int, hot: int) -> DataFrame:
    """(doc_id, mark, spans) of every row of docs (doc_id, mark, text) that has repeated windows; spans may overlap."""
    long_docs = docs.where(F.octet_length("text") >= least)
    found = stored(anchor_rows(long_docs, least, gram), "suffix-anchors")
    # Stored, so that the join has exchanges of its own, of which adaptive execution can split the one with a hot anchor.
    twice = stored(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "suffix-twice")
    every, found = found, stored(found.join(twice, "anchor"), "suffix-repeated")
    kinds = found.groupBy("anchor", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "mark", "start", "size", "lead")).alias("one"))
    kinds = stored(kinds, "suffix-contexts")
    # Stored as well: an anchor may have very many contexts.
    numbers = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min(F.when(F.col("one.size") >= least, F.col("n"))).alias("least_n"))
    kinds = kinds.where(F.col("one.size") >= least)
    whole = kinds.where("n > 1").select("anchor", "ctx", F.lit(0).alias("lo"), F.col("one.size").alias("hi"))

    # An anchor of which every context has copies has nothing left to find.
    open_anchors = stored(numbers.where("kinds > 1 AND least_n = 1").select("anchor", "kinds"), "suffix-unsettled")
    asked = kinds.join(open_anchors, "anchor").select("anchor", "ctx", "n", "kinds", "one.*")
    wanted = asked.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("anchor", "ctx", "n", "kinds", "start", "size", "lead")).alias("all"))
    same_row = [long_docs["doc_id"].eqNullSafe(wanted["doc_id"]), long_docs["mark"] == wanted["mark"]]
    texts = long_docs.join(wanted, same_row).select(long_docs["doc_id"], long_docs["mark"], F.col("text").cast("binary").alias("text"), F.explode("all").alias("x"))
    contexts = texts.select("doc_id", "mark", "x.*", F.expr("substring(text, x.start + 1, x.size)").alias("bytes"))
    contexts = stored(contexts, "suffix-open")
    spans = whole.unionByName(interval_spans(contexts.where(F.col("kinds") <= hot), least))
    much = contexts.where(F.col("kinds") > hot)
    if not much.isEmpty():
        spans = spans.unionByName(counted_spans(much.select("anchor", "ctx", F.col("lead").alias("anchor_at"), "bytes"), least, gram))
    spans = stored(spans.groupBy("anchor", "ctx").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "suffix-spans")
    discard(every, twice, open_anchors, contexts)
    back = found.join(spans, ["anchor", "ctx"]).select("doc_id", "mark", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))
    return back.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def without_repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """A row for each document: n_bytes, n_removed, n_spans, kept_sha256 and, unless keep_text is false, the bytes that are left."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    spans = repeats(rows, least, gram, hot)
    joined = rows.join(spans, [rows["doc_id"].eqNullSafe(spans["doc_id"]), rows["mark"] == spans["mark"]], "left").select(rows["doc_id"], "text", "spans")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for i, t, found in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["spans"].to_pylist()):
            data, pieces, end, runs = t.encode(), [], 0, 0
            for s, e in sorted((x["lo"], x["hi"]) for x in found or ()):
                if s > end or not runs:
                    pieces.append(data[end:s])
                    runs, end = runs + 1, max(e, end)
                else:
                    end = max(end, e)
            pieces.append(data[end:])
            kept = b"".join(pieces)
            out.append((i, len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[x.split()[0] for x in RESULT.split(", ")])

    return arrow_map(joined, run, RESULT)


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"), keep_text=False).drop("kept")


#: Every window of every text is grouped by itself: for small tables.
_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
w AS (SELECT rid, i, hash(b[i:i + {LEAST - 1}]) AS h FROM (SELECT rid, b, unnest(range(1, n - {LEAST - 2})) AS i FROM d WHERE n >= {LEAST})),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY h) AS k FROM w) WHERE k > 1),
s AS (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + {LEAST} THEN 0 ELSE 1 END AS first FROM r),
g AS (SELECT rid, i, sum(first) OVER (PARTITION BY rid ORDER BY i) AS run FROM s),
c AS (SELECT rid, run, min(i) AS a, max(i) + {LEAST} AS z FROM g GROUP BY 1, 2),
p AS (SELECT rid, a, z, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 1) AS before FROM c),
k AS (SELECT p.rid, sum(z - a)::BIGINT AS gone, count(*) AS spans, string_agg(hex(b[before:a - 1]), '' ORDER BY a) || hex(any_value(b)[max(z):]) AS kept FROM p JOIN d ON p.rid = d.rid GROUP BY p.rid)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans, CASE WHEN k.rid IS NULL THEN sha256(b) ELSE sha256(unhex(kept)) END AS kept_sha256 FROM d LEFT JOIN k ON d.rid = k.rid
"""
QUERIES = {"op3_suffix": op3_suffix}
ORACLE = {"op3_suffix": _SQL}

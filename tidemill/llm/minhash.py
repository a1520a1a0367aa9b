"""MinHash near-duplicates: universal hash minima, banding, signature verification, full verification, connected components.

1. Each text becomes the set of its distinct n-word shingles (64-bit hashes), BANDS * ROWS universal hash minima, a hash for each band
   and a byte of each minimum. Texts with equal sets are one class from here on: copies need no pairs.
2. Classes that share a band are candidates. With 32 bands of 4 minima a pair at the threshold of 0.8 shares none once in 2 * 10^7.
3. Star round: in each bucket the member with the most candidates over all its bands is the hub, and all others are held against it:
   first their signatures (bytes of minima; not in a bucket of two, which has no rest round), then their full sets. Verified pairs are links.
4. Rest round: members of one bucket that are still apart are compared in full, all of them, in square blocks of BLOCK members, so that no group is
   ever in one task and no pair becomes a row; each block gives a spanning forest of its links. A bucket that is in one piece needs nothing.
5. Components of all links.

So every pair that shares a band is either verified, or is joined already by other verified links: nothing is capped.

Defined results: no words or a null text: an empty set, linked with nothing, its own component. A null id: not in the graph, component_id
null, kept. Rows that share an id are one node, whatever their texts. Repeated rows are one class. A very long text is hashed whole, CHUNK shingles at a time. An
empty table gives no rows. Row columns besides id and text may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnp
from .common import arrow_map, discard, lookup, stored, table
from .components import connected_components

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
_rng = np.random.Generator(np.random.PCG64(41))
MULTIPLY = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 2**64 - 1, HASHES, dtype=np.uint64)
#: Shingles hashed at once: they stay in the processor's cache.
CHUNK = 1 << 15
#: Members on each side of a block of the rest round.
BLOCK = 128
#: Standard deviations below the threshold at which a signature rules a pair out (about five times in 10^7 wrongly; the rest round sees these pairs again).
SIGMAS = 5.2


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The minima of each set, none of which may be empty."""
    out = np.empty((len(sets), HASHES), np.uint64)
    sizes = np.fromiter((len(s) for s in sets), np.int64, len(sets))
    at = 0
    while at < len(sets):
        upto = at + max(1, int(np.searchsorted(np.cumsum(sizes[at : at + CHUNK]), CHUNK, "right")))
        x = np.concatenate(sets[at:upto])
        starts = np.concatenate(([0], np.cumsum(sizes[at : upto - 1])))
        y = np.empty_like(x)
        for i in range(HASHES):
            np.multiply(x, MULTIPLY[i], out=y)
            np.add(y, ADD[i], out=y)
            out[at:upto, i] = np.minimum.reduceat(y, starts)
        at = upto
    return out


FEATURES = "doc_id long, mark long, n_shingles long, fp binary, bands array<long>, sig binary"
FEATURES_ARROW = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n_shingles", pa.int64()), ("fp", pa.binary()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])


def features(docs: DataFrame, n: int) -> DataFrame:
    """docs: (doc_id, mark, text). fp: 128 bits of the set; bands and sig are null for empty sets."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = textnp.shingle_sets(batch["text"], n)
        full = [i for i, s in enumerate(sets) if len(s)]
        bands: list = [None] * len(sets)
        sigs: list = [None] * len(sets)
        if full:
            minima = signatures([sets[i] for i in full])
            hashed = np.empty((len(full), BANDS), np.uint64)
            for b in range(BANDS):
                h = np.full(len(full), 0x13198A2E03707344 + b, np.uint64)
                for r in range(ROWS):
                    h = textnp.mixed(h * np.uint64(textnp.BASE) + minima[:, b * ROWS + r])
                hashed[:, b] = h
            low = (textnp.mixed(minima) & np.uint64(0xFF)).astype(np.uint8)
            for k, i in enumerate(full):
                bands[i], sigs[i] = hashed[k].view(np.int64), low[k].tobytes()
        fp = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["mark"], pa.array([len(s) for s in sets], pa.int64()), pa.array(fp, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], schema=FEATURES_ARROW)

    return arrow_map(docs.select("doc_id", "mark", "text"), run, FEATURES)


def likely(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (..., alone, sig_a, sig_b) whose signatures do not rule out the threshold, and those that are alone in a bucket, which no later round sees."""
    least = HASHES * threshold - SIGMAS * (HASHES * threshold * (1 - threshold)) ** 0.5
    names = [c for c in pairs.columns if c not in ("alone", "sig_a", "sig_b")]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
        yield batch.select(names).filter(pa.array(((a == b).sum(1) >= least) | np.array(batch["alone"].to_pylist(), bool)))

    return arrow_map(pairs, run, pairs.select(names).schema)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def verified(pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b) of the pairs (a, b, text_a, text_b) that are linked by their full sets. Rows of one b come together, so its set is made once."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        left = textnp.shingle_sets(batch["text_a"], n)
        ids, keep, last, right = batch["b"].to_pylist(), [], None, None
        for i, b in enumerate(ids):
            if right is None or b != last:
                last, right = b, textnp.shingle_sets(batch["text_b"].slice(i, 1), n)[0]
            keep.append(linked(left[i], right, percent))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return arrow_map(pairs.select("a", "b", "text_a", "text_b"), run, "a long, b long")


def block_links(left: list[np.ndarray], right: list[np.ndarray], differ: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two lists of sets, among the pairs that `differ` names; exact."""
    both = left + right
    if not both:
        return []
    sizes = np.array([len(s) for s in both])
    row = np.repeat(np.arange(len(both)), sizes)
    _, column, seen = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    shared = seen > 1
    renamed = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], renamed[column[keep]]
    common, width = np.zeros((len(left), len(right)), np.float32), int(shared.sum())
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, width, 8192):  # so many shingles at a time
        s, e = np.searchsorted(column, (at, at + 8192))
        part = np.zeros((len(both), min(8192, width - at)), np.float32)
        part[row[s:e], column[s:e] - at] = 1
        common += part[: len(left)] @ part[len(left) :].T
    size_l, size_r = sizes[: len(left)], sizes[len(left) :]
    links = (100 * common >= percent * (size_l[:, None] + size_r[None, :] - common)) & differ
    parent = list(range(len(both)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(links)):
        x, y = find(int(i)), find(len(left) + int(j))
        if x != y:
            parent[x] = y
            out.append((int(i), int(j)))
    return out


def torn_buckets(members: DataFrame, components: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (node, h, cnt, component) of buckets that are in pieces, and (h, main, n_out): the piece that most are in, and how many are not."""
    own = members.where("cnt > 2").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))  # a bucket of two has had its only pair compared
    own = stored(own, "minhash-members")
    pieces = own.groupBy("h", "component").agg(F.count("*").alias("n")).groupBy("h").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("pieces"))
    # Stored, so that the join has exchanges of its own, of which adaptive execution can split those of hot buckets.
    main = stored(pieces.where("pieces > 1").select("h", F.col("most.component").alias("main"), (F.col("n") - F.col("most.n")).alias("n_out")), "minhash-torn")
    apart = stored(own.join(main, "h"), "minhash-apart")
    discard(own)
    return apart, main


def rest_links(apart: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Links between members of one bucket that are in different components; apart: (h, node, cnt, component, main, n_out)."""
    probes = F.col("component") != F.col("main")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    mine = lambda c: F.pmod(F.xxhash64("node", "h"), blocks(c)).cast("int")
    every = F.explode(F.sequence(F.lit(0), blocks("n_out") - 1))
    right = apart.select("h", mine("cnt").alias("rb"), every.alias("lb"), F.lit(False).alias("probe"), "node", "component")
    left = apart.where(probes).select("h", F.explode(F.sequence(F.lit(0), blocks("cnt") - 1)).alias("rb"), mine("n_out").alias("lb"), F.lit(True).alias("probe"), "node", "component")

    def hashed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([batch["node"], pa.array([s.tobytes() for s in textnp.shingle_sets(batch["text"], n)], pa.binary())], names=["node", "hashes"])

    # The sets are made once, and each cell gets them as they are.
    sets = stored(arrow_map(texts.join(apart.select("node").distinct(), "node", "left_semi"), hashed, "node long, hashes binary"), "minhash-sets")
    cells = left.unionByName(right).join(sets, "node")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        probe = np.array(t["probe"].to_pylist(), bool)
        sides = [t.filter(pa.array(m)) for m in (probe, ~probe)]
        ids = [s["node"].to_pylist() for s in sides]
        comps = [np.array(s["component"].to_pylist(), np.int64) for s in sides]
        sets = [[np.frombuffer(x.as_py(), np.uint64) for x in s["hashes"]] for s in sides]
        found = block_links(*sets, comps[0][:, None] != comps[1][None, :], percent)
        return pa.table({"a": pa.array([ids[0][i] for i, _ in found], pa.int64()), "b": pa.array([ids[1][j] for _, j in found], pa.int64())})

    return cells.groupBy("h", "lb", "rb").applyInArrow(run, "a long, b long")


def same_id_links(known: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b) of the nodes of classes that share an id: rows of it with different texts."""
    several = known.groupBy("doc_id").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least <> most").select("doc_id")
    nodes = known.join(several, "doc_id", "left_semi").select("doc_id", "fp").distinct().join(classes.select("fp", "node"), "fp")
    first = nodes.groupBy("doc_id").agg(F.min("node").alias("b"))
    return nodes.join(first, "doc_id").where("node <> b").select(F.col("node").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, n_shingles, component_id, kept) for each row; mark: a hash of the text, which tells rows of one id apart."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    feats = stored(features(source, n), "minhash-features")
    known = feats.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = known.groupBy("fp").agg(F.min(F.struct("doc_id", "mark")).alias("r"), F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.count("*").alias("rows"))
    classes = stored(classes.select("fp", F.col("r.doc_id").alias("node"), F.col("r.mark").alias("mark"), "bands", "sig", "rows"), "minhash-classes")

    banded = classes.select("node", F.explode("bands").alias("h")).distinct()
    # Sums are stored before they are joined back, so that the joins have exchanges of their own, of which adaptive execution can split hot buckets.
    shared = stored(banded.groupBy("h").agg(F.count("*").alias("cnt")).where("cnt > 1"), "minhash-shared")
    members = stored(banded.join(shared, "h"), "minhash-buckets")
    degree = members.groupBy("node").agg(F.sum("cnt").alias("degree"))
    hubs = members.join(degree, "node").groupBy("h").agg(F.max(F.struct("degree", (-F.col("node")).alias("neg")))["neg"].alias("neg"))
    hubs = stored(hubs.select("h", (-F.col("neg")).alias("hub")), "minhash-hubs")

    pairs = members.join(hubs, "h").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"), "cnt").groupBy("a", "b").agg((F.min("cnt") == 2).alias("alone"))
    sigs = classes.select("node", "sig")
    pairs = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")
    pairs = stored(likely(pairs, percent / 100), "minhash-pairs")

    # Only texts that are compared are kept, once for each class.
    needed = members.where("cnt > 2").select("node").union(pairs.select("a")).union(pairs.select("b")).distinct()
    wanted = classes.join(needed, "node", "left_semi").select(F.col("node").alias("doc_id"), "mark").distinct()
    texts = source.join(wanted, ["doc_id", "mark"], "left_semi").select(F.col("doc_id").alias("node"), "text")
    texts = stored(texts, "minhash-texts")
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    links = stored(verified(both, n, percent).unionByName(same_id_links(known, classes)), "minhash-links")

    components = connected_components(links)
    apart, main = torn_buckets(members, components)
    if not main.isEmpty():
        rest = stored(rest_links(apart, texts, n, percent), "minhash-links")
        if not rest.isEmpty():
            components = connected_components(components.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(rest))
    discard(shared, members, hubs, pairs, texts, links, apart, main)
    # Row, class, component. A class may hold a third of all rows, so it is looked up without skew.
    of_class = classes.join(components, "node", "left").select("fp", F.coalesce("component", "node").alias("class_component"), "rows")
    rows = lookup(feats.select("doc_id", "mark", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("fp")).alias("fp")), of_class, "fp", "class_component", "rows", feats.count())
    component = F.coalesce("class_component", "doc_id")
    out = rows.select("doc_id", "mark", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


#: All pairs that share a shingle, and the reach of each: for small tables.
_SQL = """
WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
c AS (SELECT list_sort(s) AS s, min(rid) AS node, len(any_value(s)) AS n FROM s WHERE len(s) > 0 AND doc_id IS NOT NULL GROUP BY 1),
x AS (SELECT node, n, hash(unnest(s)) AS h FROM c),
p AS (SELECT a.node AS a, b.node AS b FROM x a JOIN x b ON a.h = b.h AND a.node < b.node AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
m AS (SELECT s.rid, s.doc_id, c.node FROM s JOIN c ON list_sort(s.s) = c.s WHERE s.doc_id IS NOT NULL),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p UNION SELECT m.node, n.node FROM m JOIN m n ON m.doc_id = n.doc_id AND m.node <> n.node),
r AS (SELECT node, node AS far FROM c UNION SELECT r.node, e.b FROM r JOIN e ON r.far = e.a),
g AS (SELECT r.node, min(m.doc_id) AS component FROM r JOIN m ON r.far = m.node GROUP BY r.node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(g.component, s.doc_id) AS component_id, coalesce(coalesce(g.component, s.doc_id) = s.doc_id, true) AS kept FROM s LEFT JOIN m ON s.rid = m.rid LEFT JOIN g ON m.node = g.node
"""
QUERIES = {"op2_minhash": op2_minhash}
ORACLE = {"op2_minhash": _SQL}

"""Exact top-k inner products on a bit-sliced index.

Rows are dealt into blocks; a block keeps its vectors as bit slices: for each attribute (less its least value in the block) one bitmap of rows per binary
digit. A block of queries adds weighted slices with bitmap arithmetic alone: a query's weight selects shifted slices (complemented for
negative weights), carry-save adders sum them into the slices of the score. The DROPPED lowest digits of the attributes are left out of
the sums, which bounds the score from below and above. From the most significant slice downward, the k-th best lower bound is found per
query; rows whose upper bound reaches it are the boundary, and get their exact integer product. Nothing is approximate.

Work is dealt in cells of a block of rows and a block of queries; a cell gives k rows a query, and a top k over the cells follows.

Defined results: null vectors and vectors with a null or non-finite component take no part, nor do rows with a null id; empty vectors score 0; vectors of different
lengths are not compared; a query never finds rows of its own id, and rows that repeat a query's id and vector are one query; components are exact up to 2^40 in size, scores must fit a long;
rows that repeat another are found as often as they stand there; an empty table gives no rows; a very long vector is a column of its own length; other columns may
have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, table

ROW_BLOCK = 8192
QUERY_BLOCK = 1024
#: Tasks at most; beyond, a task has several cells.
TASKS = 100_000
#: Queries whose bitmaps are added at once: they stay in the processor's cache.
LANES = 64
#: Digits of an attribute that are summed as slices, at most; the digits below are left to the exact step.
DIGITS = 6


class Adder:
    """Sums bitmaps by weight with full and half adders."""

    def __init__(self) -> None:
        self.waiting: dict[int, list[np.ndarray]] = {}

    def push(self, weight: int, a: np.ndarray) -> None:
        while True:
            row = self.waiting.setdefault(weight, [])
            row.append(a)
            if len(row) < 3:
                return
            x, y, z = row
            half = x ^ y
            row[:] = [half ^ z]
            x &= y
            half &= z
            x |= half
            weight, a = weight + 1, x

    def slices(self) -> list[np.ndarray | None]:
        """By weight from the lowest; None: no row has the digit."""
        out, weight = [], 0
        while self.waiting and weight <= max(self.waiting):
            row = self.waiting.get(weight, [])
            if len(row) == 2:
                self.push(weight + 1, row[0] & row[1])
                row = [row[0] ^ row[1]]
            out.append(row[0] if row else None)
            weight += 1
        return out


def bit_slices(y: np.ndarray, digits: range) -> np.ndarray:
    """Bitmaps (digit, attribute, word) of the rows of y (rows, attributes)."""
    rows = -(-len(y) // 64) * 64
    padded = np.zeros((rows, y.shape[1]), np.int64)
    padded[: len(y)] = y
    if not digits:
        return np.zeros((0, y.shape[1], rows // 64), np.uint64)
    packed = [np.packbits(np.ascontiguousarray(((padded >> d) & 1).astype(np.uint8).T), axis=1, bitorder="little") for d in digits]
    return np.stack([np.ascontiguousarray(p).view(np.uint64) for p in packed])


def at_least(slices: list[np.ndarray | None], bound: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The rows (a bitmap a query) whose sum is at least bound (a query)."""
    above, equal = np.zeros_like(rows), rows.copy()
    ones = np.uint64(2**64 - 1)
    top = max([len(slices), *(int(b).bit_length() for b in bound)])
    for d in range(top - 1, -1, -1):
        s = slices[d] if d < len(slices) and slices[d] is not None else np.zeros_like(rows)
        want = np.where((bound >> d) & 1 == 1, ones, np.uint64(0))[:, None]
        above |= equal & s & ~want
        equal &= ~(s ^ want)
    out = above | equal
    return np.where((bound <= 0)[:, None], rows, out)


def kth_largest(slices: list[np.ndarray | None], k: int, rows: np.ndarray) -> np.ndarray:
    """The k-th largest sum of each query, from the most significant slice downward; there are k rows at least."""
    above, equal = np.zeros_like(rows), rows.copy()
    value = np.zeros(len(rows), np.int64)
    for d in range(len(slices) - 1, -1, -1):
        if slices[d] is None:
            continue
        x = above | (equal & slices[d])
        enough = np.bitwise_count(x).sum(1) >= k
        e = enough[:, None]
        above = np.where(e, above, x)
        equal = np.where(e, equal & slices[d], equal & ~slices[d])
        value |= enough.astype(np.int64) << d
    return value


def block_top(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, row id, score) of the k best rows of a block for each query, ties to smaller ids, rows of a query's id left out."""
    keep = np.argsort(ids, kind="stable")
    ids, x = ids[keep], x[keep]
    least = x.min(0)
    y = x - least
    width = int(y.max()).bit_length() if y.size else 0
    dropped = max(0, width - DIGITS)
    maps = bit_slices(y, range(dropped, width))
    words = -(-len(ids) // 64)
    valid = np.packbits(np.arange(words * 64) < len(ids), bitorder="little").view(np.uint64)
    found: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(q), LANES):
        part, names = q[at : at + LANES], query_ids[at : at + LANES]
        rows = np.repeat(valid[None, :], len(part), 0)
        lo, hi = np.searchsorted(ids, names, "left"), np.searchsorted(ids, names, "right")
        for i in np.flatnonzero(hi > lo):  # a query's own row, and any row that repeats its id
            own = np.arange(lo[i], hi[i])
            np.bitwise_and.at(rows[i], own // 64, ~(np.uint64(1) << (own % 64).astype(np.uint64)))
        there = np.bitwise_count(rows).sum(1).astype(np.int64)
        weight, negative = np.abs(part), part < 0
        adder = Adder()
        ones = np.uint64(2**64 - 1)
        for a in range(part.shape[1]):
            flip = np.where(negative[:, a], ones, np.uint64(0))[:, None]
            digits = [j for j in range(int(weight[:, a].max()).bit_length())]
            masks = [np.where((weight[:, a] >> j) & 1 == 1, ones, np.uint64(0))[:, None] for j in digits]
            for d in range(len(maps)):
                row = maps[d, a][None, :] ^ flip
                for j, mask in zip(digits, masks):
                    adder.push(d + j, row & mask)
        slices = adder.slices()
        # score = 2^dropped * sum + (0 .. slack) + constant of the query
        slack = weight.sum(1) * ((1 << dropped) - 1)
        need = np.minimum(there, k)
        bound = np.zeros(len(part), np.int64)
        for n in np.unique(need[need > 0]):
            sel = need == n
            bound[sel] = kth_largest([None if s is None else s[sel] for s in slices], int(n), rows[sel])
        bound -= slack >> dropped
        bound -= 1
        hit = at_least(slices, np.maximum(bound, 0), rows) & rows
        bits = np.unpackbits(hit.view(np.uint8), axis=1, bitorder="little")
        qi, ri = np.nonzero(bits)
        score = np.einsum("ij,ij->i", part[qi], x[ri]) if len(qi) else np.zeros(0, np.int64)
        order = np.lexsort((ids[ri], -score, qi))
        qi, ri, score = qi[order], ri[order], score[order]
        rank = np.arange(len(qi)) - np.searchsorted(qi, qi, "left")
        best = rank < k
        found.append((names[qi[best]], ids[ri[best]], score[best]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v array<long>, dim) of the rows that take part."""
    v = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale))
    fine = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.size(vector_col).alias("dim"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score); both: (id, v, dim) of quantised(). The numbers of blocks follow the numbers of rows."""
    queries = queries.dropDuplicates(["id", "v"])
    counts = vectors.groupBy("dim").agg(F.count("*").alias("n_rows")).join(queries.groupBy("dim").agg(F.count("*").alias("n_queries")), "dim")
    # A row for each length of vector that the queries have. A block is a hash of the id, so blocks are even.
    blocks = counts.select("dim", F.ceil(F.col("n_rows") / ROW_BLOCK).cast("int").alias("nr"), F.ceil(F.col("n_queries") / QUERY_BLOCK).cast("int").alias("nq"))
    spread = lambda n: F.pmod(F.xxhash64("id", "v"), F.col(n)).cast("int")
    index = vectors.join(blocks, "dim").select("dim", spread("nr").alias("r"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("q"), F.lit(False).alias("is_query"), "id", "v", F.lit(0).cast("long").alias("mark"))
    asked = queries.join(blocks, "dim").select("dim", F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("r"), spread("nq").alias("q"), F.lit(True).alias("is_query"), "id", "v", F.xxhash64("v").alias("mark"))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        flag = np.array(t["is_query"].to_pylist(), bool)
        ids = t["id"].to_numpy()
        dim = int(key[0].as_py())
        v = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(ids), dim)
        marks = t["mark"].to_numpy()
        none = (np.zeros(0, np.int64),) * 4
        found = [none]
        # Queries of one id and different vectors are different queries: in rounds, of which each has an id once.
        if flag.any() and not flag.all():
            names, asked_v, mark = ids[flag], v[flag], marks[flag]
            order = np.lexsort((mark, names))
            names, asked_v, mark = names[order], asked_v[order], mark[order]
            turn = np.arange(len(names)) - np.searchsorted(names, names, "left")
            for i in range(int(turn.max()) + 1):
                sel = turn == i
                a, b, score = block_top(ids[~flag], v[~flag], names[sel], asked_v[sel], k)
                found.append((a, b, score, mark[sel][np.searchsorted(names[sel], a)]))
        a, b, score, mark = (np.concatenate(x) for x in zip(*found))
        return pa.table({"query_id": pa.array(a, pa.int64()), "mark": pa.array(mark, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(score, pa.int64())})

    # A cell has few bytes and much work, so there are as many tasks as cells; grouping keeps to the same keys.
    cells = blocks.agg(F.coalesce(F.sum(F.col("nr").cast("long") * F.col("nq")), F.lit(0))).first()[0]
    best = index.unionByName(asked).repartition(max(1, min(int(cells), TASKS)), "dim", "r", "q").groupBy("dim", "r", "q").applyInArrow(run, "query_id long, mark long, vec_id long, score long")
    order = Window.partitionBy("query_id", "mark").orderBy(F.col("score").desc(), "vec_id")  # k rows a block of rows
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256), "topk-index")
    return top_k(rows, rows.where(F.pmod("id", F.lit(50)) == 0), 5)


QUERIES = {"op6_topk": op6_topk}
ORACLE = {
    "op6_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
}

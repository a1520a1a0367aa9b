"""Toxicity by class-conditional Kneser-Ney bigram models.

Each class c (toxic, ordinary) has an interpolated model of the words of its documents, over all tokens. v is the word before w, or the start of the
text. A bigram backs off to its word, a word to its stem (the first STEM bytes of its first run
of letters and digits), so that rare inflections share what is known of them, and a stem
to continuation counts, which both classes share:

    P_c(w | v) = max(n_c(v w) - D, 0) / n_c(v .) + D * |{u : n_c(v u) > 0}| / n_c(v .) * P_c(w)    (P_c(w) where the class has no v)
    P_c(w)     = max(n_c(w) - D', 0) / N_c + D' * |{u : n_c(u) > 0}| / N_c * Q_c(stem) * k(w) / k(stem)
    Q_c(s)     = max(m_c(s) - D'', 0) / N_c + D'' * |{s : m_c(s) > 0}| / N_c * k(s) / K

k(w) is the exact number of different (preceding word, w), over both classes; k(s) its sum over the words of s, and K over all. Each discount is that
of its class and order, n1 / (n1 + 2 n2) from the numbers of its types seen once and twice (HALF where one of them is 0), so it is below 1.
Every bigram of every training row counts in n_c(v .), in the types after v, in k and in the discounts. A bigram that a single ordinary token has, and no
toxic one (CUTOFF), has no row of its own to look up: all its mass, which is close to nothing at these discounts, is left to the backoff.

Counting. Training rows are packed in chunks of about CHUNK tokens, in which bigrams are added up first. A chunk sends each distinct bigram once to a cell, which
is told by some bits of its word and some of the word before; so neither a frequent word nor a frequent context meets in one task. A cell adds up its bigrams;
what it tells of its words and contexts adds up over the cells, since each pair is in one cell. The number of cells grows with the training text.

Scoring. Documents stay where they are while words, stems and bigrams of the model have at most MODEL_ROWS rows, which is checked: then they are broadcast (10 to
15 bytes a row). Beyond, each chunk's distinct keys are joined with them and come back to the chunk; both ways give the same numbers.

A document's evidence is its length-normalised log-likelihood ratio: over the whole text, over its best window of WINDOW words, and over
its best single word, each by P_c(w | v), by P_c(w) and by Q_c(stem), as bigrams are much rarer than words, and words than stems. A logistic curve over these nine is fitted on a
bounded sample of SAMPLE labelled rows, for each of which the counts are taken without the document itself.

Defined results: a null or wordless text has no evidence (all ratios 0); a null id is held out of training; a label counts if any row
of its id has it; rows that repeat others get equal scores, and each counts in training; a very long text is scored whole, in one piece; an empty table
gives no rows; without both classes among the labels, every score is the share of toxic ones. docs may have columns of any names but those of the
result and names that begin with two underscores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnp
from .common import discard, parts, ship, stored, table

STEM = 5
WINDOW = 8
SAMPLE = 20_000
MODEL_ROWS = 12_000_000
#: Labelled ids that are broadcast to find the training rows; with more, the tables are joined by id.
LABEL_ROWS = 2_000_000
#: Tokens of a chunk, and bytes of training text to a cell, about.
CHUNK = 500_000
CELL_BYTES = 4_000_000
#: Ordinary tokens that a bigram without a toxic one needs for a row of its own.
CUTOFF = 2
HALF = 0.5
#: Bigrams, words, stems; and the ratios of a document: three by each.
ORDERS = 3
RATIOS = 3 * ORDERS
U64 = np.uint64
#: Of a word or a stem: its tokens by class, its different contexts; and as a context: tokens after it by class, types after it by class.
NUMBERS = ("n_toxic", "n_other", "k", "after_toxic", "after_other", "types_toxic", "types_other")
#: A number that a byte does not hold is kept apart.
FULL = 255


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text has remainder 0 by 5."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def packed(a: np.ndarray) -> bytes:
    """Non-negative integers in the narrowest type that holds them, with the size of that type in front."""
    top = int(a.max()) if len(a) else 0
    size = next(s for s in (1, 2, 4, 8) if top < 1 << 8 * s)
    return bytes([size]) + a.astype(f"<u{size}").tobytes()


def unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1)


#: Bytes of a word's key (and of a context's, which is a word or 0 for the start of a text), and of a stem's.
KEY, STEM_KEY = 6, 5


def narrow(a: np.ndarray, size: int) -> bytes:
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def widened(b: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(b) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(b, np.uint8).reshape(-1, size)
    return out.view("<u8").ravel().astype(U64)


#: Keys of words are below 2^48, those of stems from there to 2^49, those of bigrams from 2^62 to 2^63.
STEMS, PAIRS = U64(1 << 48), U64(1 << 62)


class Tokens:
    """The tokens of texts, with keys."""

    def __init__(self, texts: pa.Array):
        hashes, stems, self.row = textnp.lower_words_and_stems(*textnp.bytes_of(texts), STEM)
        self.doc = np.repeat(np.arange(len(self.row) - 1), np.diff(self.row))
        self.words, first, self.word = np.unique(hashes >> U64(64 - 8 * KEY), return_index=True, return_inverse=True)
        self.stems = (stems[first] >> U64(64 - 8 * STEM_KEY)) + STEMS
        self.before = np.empty_like(self.word)  # 1 more than the place of the word before; 0: the start of a text
        self.before[1:] = self.word[:-1] + 1
        self.before[self.row[:-1][self.row[:-1] < self.row[1:]]] = 0
        self.contexts = np.concatenate((np.zeros(1, U64), self.words))
        code, self.pair = np.unique(self.word * len(self.contexts) + self.before, return_inverse=True)
        self.w, self.v = code // len(self.contexts), code % len(self.contexts)  # of each distinct bigram

    def keys(self) -> np.ndarray:
        """Of the distinct bigrams."""
        return pair_keys(self.contexts[self.v], self.words[self.w])


def pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (textnp.mixed(v * U64(textnp.BASE) + w) >> U64(2)) | PAIRS


# ---- counting

CELLS = "cell long, w binary, s binary, run binary, v binary, n_toxic binary, n_other binary"
SUMS = "kind byte, h long, stem long, a long, b long, c long, d long"
WORD, CONTEXT, PAIR, TYPES = range(4)


def of_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together or cut to about CHUNK tokens."""
    some, size = [], 0
    for batch in batches:
        for part in parts(batch):
            some, size = [*some, part], size + part.nbytes
            if size > CHUNK * 7:
                yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]
                some, size = [], 0
    if some:
        yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]


def cells_of(docs: pa.RecordBatch, bits: int) -> pa.RecordBatch:
    """A row for each cell that has bigrams of docs (text, __toxic)."""
    v_bits = bits // 2
    t = Tokens(docs["text"])
    label = np.array(docs["__toxic"].to_pylist(), bool)[t.doc]
    toxic, other = (np.bincount(t.pair[label == c], minlength=len(t.w)) for c in (True, False))
    top = U64(8 * KEY)
    cell = ((t.words[t.w] >> (top - U64(bits - v_bits))) << U64(v_bits)) | (t.contexts[t.v] >> (top - U64(v_bits)))
    order = np.argsort(cell, kind="stable")
    cell, w, v, toxic, other = cell[order].astype(np.int64), t.w[order], t.v[order], toxic[order], other[order]
    rows = []
    edges = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True]))) if len(cell) else []
    for s, e in zip(edges[:-1], edges[1:]):
        own = w[s:e]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        rows.append((int(cell[s]), narrow(t.words[own[first]], KEY), narrow(t.stems[own[first]] - STEMS, STEM_KEY), packed(np.diff(np.append(first, len(own)))), narrow(t.contexts[v[s:e]], KEY), packed(toxic[s:e]), packed(other[s:e])))
    names = [x.split()[0] for x in CELLS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary() if i else pa.int64()) for i in range(len(names))], names=names)


def sent(training: DataFrame, bits: int) -> DataFrame:
    """A row for each chunk and cell of training (text, __toxic): its distinct words, their stems and how many contexts follow; contexts; counts by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs in of_chunks(batches):
            yield cells_of(docs, bits)  # whose arrays are gone before the next chunk's are made

    return training.mapInArrow(run, CELLS)


def summed(group: pa.Table) -> pa.Table:
    """What a cell tells of its words (tokens by class, contexts), contexts (tokens and types by class), bigrams above the cutoff, and types seen once and twice."""
    cols = {c: group[c].to_pylist() for c in group.column_names if c != "cell"}
    runs = [unpacked(x) for x in cols["run"]]
    uw, first, w = np.unique(np.concatenate([np.repeat(widened(x, KEY), r) for x, r in zip(cols["w"], runs)]), return_index=True, return_inverse=True)
    stem = np.concatenate([np.repeat(widened(x, STEM_KEY), r) for x, r in zip(cols["s"], runs)])[first] + STEMS
    uv, v = np.unique(widened(b"".join(cols["v"]), KEY), return_inverse=True)
    code, of = np.unique(w * len(uv) + v, return_inverse=True)
    # Sums of integers below 2^53 are exact in bincount.
    add = lambda at, x, n: np.bincount(at, x.astype(float), n).astype(np.int64)
    t, o = (add(of, np.concatenate([unpacked(x) for x in cols[c]]), len(code)) for c in ("n_toxic", "n_other"))
    w, v = code // len(uv), code % len(uv)
    keep = (t > 0) | (o >= CUTOFF)
    none = lambda n: np.zeros(n, np.int64)
    blocks = [
        (WORD, uw, stem, add(w, t, len(uw)), add(w, o, len(uw)), add(w, np.ones(len(w)), len(uw)), none(len(uw))),
        (CONTEXT, uv, None, add(v, t, len(uv)), add(v, o, len(uv)), add(v, t > 0, len(uv)), add(v, o > 0, len(uv))),
        (PAIR, pair_keys(uv[v[keep]], uw[w[keep]]), None, t[keep], o[keep], none(int(keep.sum())), none(int(keep.sum()))),
        (TYPES, none(1), None, *(np.array([int((x == i).sum())]) for x in (t, o) for i in (1, 2))),
    ]
    sizes = [len(b[1]) for b in blocks]
    whole = lambda i: pa.array(np.concatenate([b[i].astype(np.int64) for b in blocks]))
    stems = pa.concat_arrays([pa.nulls(n, pa.int64()) if b[2] is None else pa.array(b[2].astype(np.int64)) for b, n in zip(blocks, sizes)])
    kinds = pa.array(np.repeat(np.array([b[0] for b in blocks], np.int8), sizes))
    return pa.table([kinds, whole(1), stems, *map(whole, (3, 4, 5, 6))], names=[x.split()[0] for x in SUMS.split(", ")])


class Model:
    """Sizes and discounts by class (toxic, other) of bigrams, words and stems."""

    def __init__(self, words: dict, stems: dict, types: list[int]):
        def discounts(n: list[int]) -> np.ndarray:
            return np.array([a / (a + 2 * b) if a and b else HALF for a, b in zip(n[::2], n[1::2])])

        of = lambda r, kind: np.array([r[f"{kind}_{c}"] or 0 for c in ("toxic", "other")], float)
        ones = lambda r: [r[f"n{i}_{c}"] or 0 for c in ("toxic", "other") for i in (1, 2)]
        self.total, self.k = of(words, "n"), float(words["k"] or 0)
        self.known = bool((self.total > 0).all())
        self.pair_discount, self.word_discount, self.stem_discount = discounts(types), discounts(ones(words)), discounts(ones(stems))
        if self.known:
            self.word_rest, self.stem_rest = self.word_discount * of(words, "types") / self.total, self.stem_discount * of(stems, "types") / self.total

    def ratio(self, pair: np.ndarray, before: np.ndarray, word: np.ndarray, stem: np.ndarray) -> np.ndarray:
        """log P_toxic / P_other of w after v, of w alone and of its stem, as ORDERS columns; rows of: pair: counts by class; before, word, stem: NUMBERS."""
        if not self.known:
            return np.zeros((len(pair), ORDERS))
        k_stem = np.maximum(stem[:, 2], 1)
        p = []
        for c in (0, 1):
            q = np.maximum(stem[:, c] - self.stem_discount[c], 0) / self.total[c] + self.stem_rest[c] * k_stem / self.k
            one = np.maximum(word[:, c] - self.word_discount[c], 0) / self.total[c] + self.word_rest[c] * q * np.maximum(word[:, 2], 1) / k_stem
            after = np.maximum(before[:, 3 + c], 1)
            two = (np.maximum(pair[:, c] - self.pair_discount[c], 0) + self.pair_discount[c] * before[:, 5 + c] * one) / after
            p.append((np.where((before[:, 3 + c] > 0) & (before[:, 5 + c] > 0), two, one), one, q))
        return np.column_stack([np.log(a / b) for a, b in zip(*p)])


def counted(training: DataFrame, bits: int) -> tuple[DataFrame, DataFrame, Model]:
    """(h, NUMBERS) of all words and stems; (h, n_toxic, n_other) of bigrams; sizes and discounts."""
    ship(training.sparkSession)
    sums = stored(sent(training, bits).groupBy("cell").applyInArrow(summed, SUMS), "toxic-sums")
    when = lambda kind, c: F.sum(F.when(F.col("kind") == kind, F.col(c)).otherwise(0))
    columns = [*((WORD, c) for c in "abc"), *((CONTEXT, c) for c in "abcd")]
    words = sums.where(F.col("kind").isin(WORD, CONTEXT)).groupBy("h").agg(F.max("stem").alias("stem"), *(when(k, c).alias(n) for n, (k, c) in zip(NUMBERS, columns)))
    words = stored(words, "toxic-words")
    stems = stored(words.where("stem IS NOT NULL").groupBy("stem").agg(*(F.sum(c).alias(c) for c in NUMBERS[:3])), "toxic-stems")
    some = lambda c, cond: F.sum(F.when(cond, 1).otherwise(0)).alias(c)
    size = [F.sum("k").alias("k")] + [x for c in ("toxic", "other") for x in (F.sum(f"n_{c}").alias(f"n_{c}"), some(f"types_{c}", F.col(f"n_{c}") > 0), some(f"n1_{c}", F.col(f"n_{c}") == 1), some(f"n2_{c}", F.col(f"n_{c}") == 2))]
    types = sums.where(F.col("kind") == TYPES).agg(*(F.sum(c) for c in "abcd")).first()
    model = Model(words.agg(*size).first().asDict(), stems.agg(*size).first().asDict(), [x or 0 for x in types])
    no = F.lit(0).cast("long")
    rows = words.select("h", *NUMBERS).unionByName(stems.select(F.col("stem").alias("h"), *NUMBERS[:3], *(no.alias(c) for c in NUMBERS[3:])))
    return rows, sums.where(F.col("kind") == PAIR).select("h", F.col("a").alias("n_toxic"), F.col("b").alias("n_other")), model


# ---- scoring


class Known:
    """Numbers by sorted key, a byte each; rows with a larger one stand apart."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, values = keys[order], values[order]
        large = np.flatnonzero((values >= FULL).any(1))
        self.large, self.exact = self.keys[large], values[large].astype(np.float64)
        self.values = np.minimum(values, FULL).astype(np.uint8)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The numbers of h, zeros where it is unknown."""
        out = np.zeros((len(h), self.values.shape[1]))
        for keys, values in ((self.keys, self.values), (self.large, self.exact)):
            if len(keys) and len(h):
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[at] == h
                out[hit] = values[at[hit]]
        return out


def collected(rows: DataFrame, columns: tuple[str, ...]) -> Known:
    """rows (h, columns) on the driver; their number was checked. Small numbers travel in two bytes."""
    short = rows.select("h", *(F.least(F.col(c), F.lit(FULL)).cast("short").alias(c) for c in columns)).toArrow()
    of = lambda t: (t["h"].to_numpy().astype(U64), np.column_stack([t[c].to_numpy().astype(np.uint8) for c in columns]))
    out = Known(*of(short))
    del short
    large = rows.where(F.greatest(*columns) >= FULL).select("h", *columns).toArrow()
    apart = Known(large["h"].to_numpy().astype(U64), np.column_stack([large[c].to_numpy() for c in columns]))
    out.large, out.exact = apart.large, apart.exact
    return out


def evidence(row: np.ndarray, llr: np.ndarray) -> np.ndarray:
    """(rows, 3): mean ratio of all words, of the best window, of the best word."""
    out = np.zeros((len(row) - 1, 3))
    full = np.flatnonzero(row[1:] > row[:-1])
    if not len(full):
        return out
    c = np.concatenate(([0.0], np.cumsum(llr)))
    size = np.diff(row)
    out[full, 0] = (c[row[1:]] - c[row[:-1]])[full] / size[full]
    out[full, 2] = np.maximum.reduceat(llr, row[:-1][full])
    # Windows that begin in a row and end in it; a shorter row is one window.
    ends = np.minimum(np.arange(len(llr)) + WINDOW, np.repeat(row[1:], size))
    begins = np.maximum(ends - WINDOW, np.repeat(row[:-1], size))
    out[full, 1] = np.maximum.reduceat((c[ends] - c[begins]) / np.repeat(np.minimum(size, WINDOW), size), row[:-1][full])
    return out


def both_evidence(t: Tokens, llr: np.ndarray) -> np.ndarray:
    return np.hstack([evidence(t.row, llr[:, i]) for i in range(ORDERS)])


def without_itself(model: Model, t: Tokens, token: np.ndarray, label: np.ndarray, pair: np.ndarray, before: np.ndarray, word: np.ndarray, stem: np.ndarray) -> np.ndarray:
    """Ratios of the tokens named, with the counts taken without the document of each; label: its class. before is by place in t.contexts."""
    doc, p = t.doc[token], t.pair[token]

    def own(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        _, of, counts = np.unique(doc * n + ids, return_inverse=True, return_counts=True)
        return counts[of], of

    _, stem_of = np.unique(t.stems, return_inverse=True)
    n_pair, which = own(p, len(t.w))
    n_before, same = own(t.v[p], len(t.contexts))
    n_word, n_stem = own(t.w[p], len(t.words))[0], own(stem_of[t.w[p]], len(t.words))[0]
    x, y, w, s = pair[p].copy(), before[t.v[p]].copy(), word[t.w[p]].copy(), stem[t.w[p]].copy()
    # Types after a context that the document alone has; each counts once, at the first of its tokens. A bigram below the cutoff has no row: it is the document's own.
    at = np.arange(len(p))
    alone = n_pair >= x[at, 1 - label]
    first = np.zeros(len(p), bool)
    first[np.unique(which, return_index=True)[1]] = True
    lost = np.bincount(same, alone & first)[same] if len(p) else np.zeros(0)
    for numbers, column, less in ((x, 1 - label, n_pair), (y, 4 - label, n_before), (y, 6 - label, lost), (w, 1 - label, n_word), (s, 1 - label, n_stem)):
        numbers[at, column] = np.maximum(numbers[at, column] - less, 0)
    x[(x[:, 0] == 0) & (x[:, 1] < CUTOFF), 1] = 0
    return model.ratio(x, y, w, s)


EXTRA = [f"{k}{i}" for k in "ex" for i in range(RATIOS)]


def scored(docs: pa.RecordBatch, keep: list[str], model: Model, t: Tokens, words: Known, pairs: Known) -> pa.RecordBatch:
    """docs (text, __sampled: the label of a row of the sample) with e0 ... e8; and with x0 ... x8, the same without the document's own counts, in the sample."""
    e, x = np.zeros((docs.num_rows, RATIOS)), np.zeros((docs.num_rows, RATIOS))
    label = np.array([-1 if y is None else y for y in docs["__sampled"].to_pylist()], np.int64)
    if len(t.pair):
        pair, before, stem = pairs.find(t.keys()), words.find(t.contexts), words.find(t.stems)
        word = before[1:]
        e = both_evidence(t, model.ratio(pair, before[t.v], word[t.w], stem[t.w])[t.pair])
        token = np.flatnonzero(label[t.doc] >= 0)
        if len(token):
            llr = np.zeros((len(t.pair), ORDERS))
            llr[token] = without_itself(model, t, token, label[t.doc[token]], pair, before, word, stem)
            x = both_evidence(t, llr)
    numbers = [pa.array(e[:, i]) for i in range(RATIOS)] + [pa.array(x[:, i], mask=label < 0) for i in range(RATIOS)]
    return pa.RecordBatch.from_arrays([*(docs[c] for c in keep), *numbers], names=[*keep, *EXTRA])


def with_evidence(docs: DataFrame, words: DataFrame, pairs: DataFrame, model: Model, keep: list[T.StructField], model_rows: int = MODEL_ROWS) -> DataFrame:
    """The columns `keep` of docs, and EXTRA; stored."""
    names = [f.name for f in keep]
    schema = T.StructType([*keep, *(T.StructField(c, T.DoubleType()) for c in EXTRA)])
    spark = docs.sparkSession
    ship(spark)
    if words.count() + pairs.count() <= model_rows:
        shared = spark.sparkContext.broadcast((collected(words, NUMBERS), collected(pairs, NUMBERS[:2])))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in parts(batch):
                    yield scored(part, names, model, Tokens(part["text"]), *shared.value)

        out = stored(docs.mapInArrow(run, schema), "toxic-evidence")
        shared.destroy()  # nothing reads it again, and workers would keep it beside the next one
        return out

    # Beyond that size: distinct keys of each chunk meet the tables in a join, and come back to their chunk as an array.
    chunks = stored(chunked(docs), "toxic-chunks")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, part in opened(batches):
            t = Tokens(part["text"])
            h = np.concatenate((t.contexts, np.unique(t.stems), t.keys())).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), chunk)), pa.array(h)], names=["of", "h"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part, found in opened(batches, "found"):
            of = found.values.flatten() if found.is_valid else [pa.array([], pa.int64())] * (1 + len(NUMBERS))
            keys, values = of[0].to_numpy().astype(U64), np.column_stack([x.to_numpy() for x in of[1:]])
            pair = keys >= PAIRS
            yield from parts(scored(part, names, model, Tokens(part["text"]), Known(keys[~pair], values[~pair]), Known(keys[pair], values[pair][:, :2])))

    no = F.lit(0).cast("long")
    every = words.unionByName(pairs.select("h", *NUMBERS[:2], *(no.alias(c) for c in NUMBERS[2:])))
    found = chunks.select("chunk", "docs").mapInArrow(distinct, "of long, h long").join(every, "h").groupBy("of").agg(F.collect_list(F.struct("h", *NUMBERS)).alias("found"))
    out = stored(chunks.join(found, F.col("chunk") == F.col("of"), "left").select("chunk", "docs", "found").mapInArrow(joined, schema), "toxic-evidence")
    discard(chunks)
    return out


def chunked(docs: DataFrame) -> DataFrame:
    """(chunk, docs): docs in chunks of about CHUNK tokens, each as one Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for n, docs in enumerate(of_chunks(batches)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(docs)
            yield pa.RecordBatch.from_arrays([pa.array([task << 32 | n], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "docs"])

    return docs.mapInArrow(run, "chunk long, docs binary")


def opened(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            docs = pa.ipc.open_stream(batch["docs"][i].as_py()).read_all().combine_chunks().to_batches()
            if docs:
                yield (batch["chunk"][i].as_py(), docs[0], *(batch[c][i] for c in names))


def fitted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (bias last) of a logistic curve, by Newton's method with a small ridge."""
    a = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(a.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        ridge = np.diag([0.05] * x.shape[1] + [1e-6])
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def toxicity(docs: DataFrame, labels: DataFrame, model_rows: int = MODEL_ROWS, keep_text: bool = False) -> DataFrame:
    """docs (doc_id, text and any others) with held_out, score and predicted, without text unless keep_text is set. labels: (doc_id, toxic)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("__toxic"))
    known = stored(known, "toxic-labels")
    total, positive = known.agg(F.count("*"), F.coalesce(F.sum("__toxic"), F.lit(0))).first()
    ids = F.broadcast(known) if total <= LABEL_ROWS else known
    training = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("__id")).select("text", "__toxic")
    size = training.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(4, int(np.ceil(np.log2(max(1, size / CELL_BYTES)))))
    words, pairs, model = counted(training, bits)
    share = min(1.0, SAMPLE / max(1, total))
    # At most about SAMPLE ids, whatever the size of the corpus.
    sample = known.where(F.pmod(F.xxhash64("__id", F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000)).withColumnRenamed("__toxic", "__sampled")
    marked = docs.join(F.broadcast(sample), F.col("doc_id") == F.col("__id"), "left").drop("__id")
    fields = [f for f in docs.schema.fields if keep_text or f.name != "text"]
    out = with_evidence(marked, words, pairs, model, [*fields, marked.schema["__sampled"]], model_rows)
    seen = out.where("__sampled IS NOT NULL").select("__sampled", *(F.col(f"x{i}") for i in range(RATIOS))).toPandas()
    seen = seen.sort_values(list(seen.columns), ignore_index=True)  # the same weights in every run
    if len(seen) and seen["__sampled"].nunique() == 2:
        w = fitted(seen[[f"x{i}" for i in range(RATIOS)]].to_numpy(), seen["__sampled"].to_numpy(float))
    else:
        rate = min(max(positive / total, 1e-6), 1 - 1e-6) if total else 0.5
        w = np.append(np.zeros(RATIOS), np.log(rate / (1 - rate)))
    z = sum((F.col(f"e{i}") * F.lit(float(w[i])) for i in range(RATIOS)), F.lit(float(w[RATIOS])))
    score = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
    out = out.select("*", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    return out.drop("__sampled", *(f"x{i}" for i in range(RATIOS)), *(f"e{i}" for i in range(3, RATIOS)))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")).select("doc_id", "held_out", "score", "predicted", F.col("e0").alias("mean_llr"), F.col("e1").alias("window_llr"), F.col("e2").alias("word_llr"))


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLE: dict[str, str] = {}

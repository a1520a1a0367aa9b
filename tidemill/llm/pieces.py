"""SentencePiece encoding and decoding with a unigram lattice, giant texts by a max-plus parallel scan.

A text is cut at places that no piece crosses (before a space mark that follows another character, around characters that no piece has), so
each word between two such places is segmented alone, for all its occurrences in a batch. The library's own lattice search does that, reading the
same pieces with the same integer scores; in its 32-bit floats their sums over a word of up to LIBRARY_CHARS are exact. Longer words take the search here.

One rule settles ties, the library's: of the best ways to an end, the one whose last piece starts earliest. It depends on the best scores up to each place
alone, so a text has one segmentation, whatever chunks it is cut into.

Giant texts are cut into chunks of CHUNK characters anywhere. A chunk's boundary states are how far a piece of the chunk before reaches into
it; its transfer matrix has the best score from each state at its start to each state at its end. The max-plus product is
associative, so all prefix products come from a doubling scan; they give the best score of every state at each boundary. From those each chunk is
traced back by itself, for every state at its end: which state at its start that comes from, and the pieces between. What is left is to follow
one state a chunk from the text's end. Between its first and last safe place a chunk's matrix is a sum of a column, a number and a row, and its trace is
the same for all states; a chunk without safe places (one giant word) pays for all states.

Scores are integers (thousandths of a log-probability), so sums do not depend on their order. A vocabulary of the merge type has ranks in
the place of scores; its pieces get the Zipf-Mandelbrot probability of their rank. A character without a piece costs UNKNOWN more than the
worst piece, as in the library, and is spelled in byte pieces.

Defined results: null and empty texts have no tokens and decode to the empty text; a literal space mark decodes as a space, as the format has
it; equal texts, repeated rows among them, have equal tokens; an empty table gives no rows; docs may have columns of any names but the results' (ids,
chunks) and `__mark`.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, stored, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
CHUNK = 32_768
UNKNOWN = 10
SCALE = 1000
MANDELBROT = 2.7
NEVER = -(1 << 60)
#: Words that a task remembers, and characters of a word that the library segments.
MEMORY = 200_000
LIBRARY_CHARS = 1000
#: Chunks that a task takes, and matrices whose products are made at once.
TASK_CHUNKS = 16
SCAN = 256
#: Where a session names another vocabulary.
MODEL_SETTING = "spark.tidemill.pieces.model"


@lru_cache(4)
def read_model(path: str) -> tuple[list[str], list[int], list[int], bool, bytes]:
    """Pieces, integer scores, kinds (1: normal, 4: user-defined, 6: byte), whether a space mark goes before a text, and a model of words. On the driver."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only vocabularies that leave text as it is are supported")
    kinds = [p.type for p in model.pieces]
    if model.trainer_spec.model_type == 1:
        scores = [round(p.score * SCALE) for p in model.pieces]
    else:
        order = sorted((i for i, k in enumerate(kinds) if k in (1, 4)), key=lambda i: (-model.pieces[i].score, i))
        total = sum(1 / (r + MANDELBROT) for r in range(len(order)))
        scores = [0] * len(kinds)
        for r, i in enumerate(order):
            scores[i] = -round(SCALE * math.log((r + MANDELBROT) * total))
    prefix = model.normalizer_spec.add_dummy_prefix
    model.trainer_spec.model_type, model.normalizer_spec.add_dummy_prefix = 1, False
    for p, s in zip(model.pieces, scores):
        p.score = float(s)
    return [p.piece for p in model.pieces], scores, kinds, prefix, model.SerializeToString()


class Memory(dict):
    """Words that were segmented before; it starts anew when it is full."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        self.make = make

    def __missing__(self, word: str) -> bytes:
        out = self.make(word)
        if len(word) <= 64:
            if len(self) >= MEMORY:
                self.clear()
            self[word] = out
        return out


class Lattice:
    """Segmentation with one vocabulary."""

    def __init__(self, pieces: list[str], scores: list[int], kinds: list[int], prefix: bool, model: bytes | None = None) -> None:
        self.library = None
        if model is not None:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.prefix = MARK if prefix else ""
        known = [(p, i) for i, (p, k) in enumerate(zip(pieces, kinds)) if k in (1, 4) and p]
        self.ids = {p: (i, scores[i]) for p, i in known}
        self.table: dict[str, tuple[int, int] | None] = {p[:n]: None for p, _ in known for n in range(1, len(p))}  # None: only begins pieces
        self.table.update(self.ids)
        self.reach = max(len(p) for p, _ in known)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == 6}
        self.unknown = min(scores[i] for _, i in known) - UNKNOWN
        self.unknown_id = next((i for i, k in enumerate(kinds) if k == 2), 0)
        self.spelled = [bytes([int(p[3:5], 16)]) if k == 6 else b"" if k == 3 else p.encode() for p, k in zip(pieces, kinds)]
        inside = any(MARK in p.lstrip(MARK) for p, _ in known)
        letters = set().union(*(p for p, _ in known))
        self.alone = "".join(c for c in "\n\t\r" if c not in letters)
        a = re.escape(self.alone)
        self.words = re.compile(rf"{MARK}*[^{MARK}{a}]+|{MARK}+" + (f"|[{a}]" if a else "")) if not inside else re.compile(r"(?s).+")
        self.cuts = None if inside else re.compile(rf"(?<=[^{MARK}])(?={MARK})" + (f"|(?=[{a}])|(?<=[{a}])" if a else ""))
        self.code = [i.to_bytes(4, "little") for i in range(len(pieces))]
        # What a token adds to the score; a character in byte pieces adds it with its first byte.
        self.worth = np.array([s if k in (1, 4) else 0 for s, k in zip(scores, kinds)], np.int64)
        for b, i in self.bytes.items():
            self.worth[i] = 0 if 0x80 <= b < 0xC0 else self.unknown
        self.worth[self.unknown_id] = self.unknown
        self.memory = Memory(self.segmented)

    def forward(self, text: str, best: list[int], back: list, upto: int) -> None:
        """Best scores of all ends of pieces that start before upto; back: (start, id) of the last piece. Earlier starts win ties."""
        get, ids, reach, end = self.table.get, self.ids, self.reach, len(text)
        for i in range(min(upto, end)):
            base = best[i]
            if base <= NEVER:
                continue
            if text[i] not in ids:
                s = base + self.unknown
                if s > best[i + 1]:
                    best[i + 1], back[i + 1] = s, (i, -1)
            for j in range(i + 1, (i + reach if i + reach < end else end) + 1):
                hit = get(text[i:j], 0)
                if hit == 0:
                    break
                if hit is not None:
                    s = base + hit[1]
                    if s > best[j]:
                        best[j], back[j] = s, (i, hit[0])

    def spell(self, text: str, back: list, start: int, end: int) -> bytes:
        """The ids of the pieces from start to end, as little-endian 32-bit numbers."""
        out: list[bytes] = []
        code = self.code
        while end > start:
            i, piece = back[end]
            if piece >= 0:
                out.append(code[piece])
            else:
                out.append(b"".join(code[self.bytes[b]] for b in text[i:end].encode()) if self.bytes else code[self.unknown_id])
            end = i
        out.reverse()
        return b"".join(out)

    def scored(self, text: str) -> tuple[bytes, int]:
        """Ids (as little-endian 32-bit numbers) and score of a word."""
        best, back = [0] + [NEVER] * len(text), [None] * (len(text) + 1)
        self.forward(text, best, back, len(text))
        return self.spell(text, back, 0, len(text)), best[-1]

    def segmented(self, text: str) -> bytes:
        return self.scored(text)[0]

    def learn(self, words: set[str]) -> None:
        """Segments the words of a batch that are not known yet, all at once."""
        new = [w for w in words if w not in self.memory and len(w) <= LIBRARY_CHARS]
        if self.library is None or not new:
            return
        if len(self.memory) + len(new) > MEMORY:
            self.memory.clear()
            new = [w for w in words if len(w) <= LIBRARY_CHARS]
        code = self.code
        self.memory.update(zip(new, (b"".join([code[i] for i in ids]) for ids in self.library.encode(new, num_threads=1))))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        words = [self.words.findall(self.normal(t)) for t in texts]
        self.learn(set().union(*words))
        get = self.memory.__getitem__
        return [b"".join(map(get, w)) for w in words]

    def normal(self, text: str) -> str:
        return self.prefix + text.replace(" ", MARK) if text else ""

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.memory.__getitem__, self.words.findall(self.normal(text))))

    def decode(self, ids: np.ndarray) -> str:
        spelled = self.spelled
        text = b"".join([spelled[i] for i in ids.tolist()]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text

    # A chunk: its own characters text[:size], and as many of the next as a piece may reach.

    def safe(self, text: str, size: int) -> tuple[int, int] | None:
        """The first safe place that all states are before, and the last one of the chunk."""
        if self.cuts is None:
            return None
        places = [m.start() for m in self.cuts.finditer(text, 0, size + 1) if self.reach <= m.start() <= size]
        return (places[0], places[-1]) if places else None

    def transfer(self, text: str, size: int) -> np.ndarray:
        """(states, states) best scores."""
        m = self.reach
        out = np.full((m, m), NEVER, np.int64)
        found = self.safe(text, size)
        if found is None:
            for i in range(min(m, size + 1)):
                best = [NEVER] * (len(text) + 1)
                best[i] = 0
                self.forward(text, best, [None] * (len(text) + 1), size)
                for j in range(min(m, len(text) - size + 1)):
                    if best[size + j] > NEVER:
                        out[i, j] = best[size + j]
            if size < m:  # a piece that covers the whole chunk and more
                for i in range(size, m):
                    out[i, i - size] = 0
            return out
        a, b = found
        head = np.full(m, NEVER, np.int64)
        for i in range(m):
            best = [NEVER] * (a + 1)
            best[i] = 0
            self.forward(text[:a], best, [None] * (a + 1), a)
            head[i] = best[a]
        middle = int(self.worth[np.frombuffer(self.encode_word_run(text[a:b]), "<i4")].sum())
        rest = text[b:]
        best = [0] + [NEVER] * len(rest)
        self.forward(rest, best, [None] * (len(rest) + 1), size - b)
        tail = np.full(m, NEVER, np.int64)
        for j in range(min(m, len(text) - size + 1)):
            tail[j] = best[size - b + j]
        ok = (head[:, None] > NEVER) & (tail[None, :] > NEVER)
        out[ok] = (head[:, None] + middle + tail[None, :])[ok]
        return out

    def encode_word_run(self, text: str) -> bytes:
        """The ids of a text between two safe places."""
        words = self.words.findall(text)
        self.learn(set(words))
        return b"".join(map(self.memory.__getitem__, words))

    def walk(self, text: str, size: int, before: list[int]) -> tuple[bytes, list[int], list[bytes]]:
        """The pieces that start in the chunk, as a part that all ways share and one for each state at its end, and the state at its start that each comes from.

        before: the best scores of the states at its start. A state that nothing reaches comes from -1. Earlier starts win ties, so a state keeps its own score
        against an equal one from within the chunk.
        """
        m, found = self.reach, self.safe(text, size)
        ends = range(min(m, len(text) - size + 1))
        shared, enter, tails = b"", [-1] * m, [b""] * m

        def entered(upto: int) -> tuple[list[int], list]:
            best, back = [NEVER] * (upto + 1), [None] * (upto + 1)
            for i in range(min(m, upto + 1)):
                best[i] = before[i]
            return best, back

        def root(back: list, at: int) -> int:
            while back[at] is not None:
                at = back[at][0]
            return at

        if found is None:
            best, back = entered(len(text))
            self.forward(text, best, back, size)
            for j in ends:
                if best[size + j] > NEVER:
                    enter[j] = root(back, size + j)
                    tails[j] = self.spell(text, back, enter[j], size + j)
            return shared, enter, tails
        a, b = found
        best, back = entered(a)
        self.forward(text[:a], best, back, a)
        start = root(back, a)
        shared = self.spell(text, back, start, a) + self.encode_word_run(text[a:b])
        rest = text[b:]
        best, back = [0] + [NEVER] * len(rest), [None] * (len(rest) + 1)
        self.forward(rest, best, back, size - b)
        for j in ends:
            if best[size - b + j] > NEVER:
                enter[j], tails[j] = start, self.spell(rest, back, 0, size - b + j)
        return shared, enter, tails


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus products of stacks of matrices."""
    return np.maximum((a[..., :, :, None] + b[..., None, :, :]).max(-2), NEVER)


def prefix_products(m: np.ndarray) -> np.ndarray:
    """m[0], m[0] m[1], ... by doubling: the product is associative."""
    out, step = m.copy(), 1
    while step < len(out):
        out[step:] = product(out[:-step], out[step:])
        step *= 2
    return out


def prefix_scores(m: np.ndarray) -> np.ndarray:
    """The best scores of all states at the start of each chunk with these matrices; the text starts in state 0."""
    before = np.full((len(m), m.shape[1]), NEVER, np.int64)
    now = np.full(m.shape[1], NEVER, np.int64)
    now[0] = 0
    for at in range(0, len(m), SCAN):
        upto = product(now[None, None, :], prefix_products(m[at : at + SCAN]))[:, 0, :]
        before[at], before[at + 1 : at + SCAN] = now, upto[:-1]
        now = upto[-1]
    return before


def followed(enter: list[list[int]]) -> list[int]:
    """The state at the end of each chunk on the way that ends in state 0 of the last; enter: for each chunk, where its end states come from."""
    states, now = [], 0
    for of in reversed(enter):
        states.append(now)
        now = of[now]
    return states[::-1]


def vocabulary(spark: SparkSession, model: str | None) -> str:
    return model or spark.conf.get(MODEL_SETTING, MODEL)


def tokens(docs: DataFrame, model: str | None = None, chunk: int = CHUNK, text_col: str = "text") -> DataFrame:
    """docs with `ids`, the tokens as little-endian 32-bit numbers, and `chunks`. model: a vocabulary's path, else the session's."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_model(vocabulary(spark, model)))  # the vocabulary: of a size of its own, not the data's
    made: dict = {}

    def lattice() -> Lattice:
        if "it" not in made:
            made["it"] = Lattice(*shared.value)
        return made["it"]

    columns = docs.columns
    giant = F.coalesce(F.length(text_col) > chunk, F.lit(False))

    def whole(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        it = lattice()
        ids = it.encode_all([t or "" for t in batch[text_col].to_pylist()])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary()), pa.array([1] * len(ids), pa.int32())], names=[*columns, "ids", "chunks"])

    plain = arrow_map(docs.where(~giant), whole, T.StructType([*docs.schema.fields, T.StructField("ids", T.BinaryType()), T.StructField("chunks", T.IntegerType())]))
    large = docs.where(giant).withColumn("__mark", F.sha2(text_col, 256))
    texts = large.select("__mark", F.col(text_col).alias("text")).dropDuplicates(["__mark"])

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        it = lattice()
        for mark, text in zip(batch["__mark"].to_pylist(), batch["text"].to_pylist()):
            text = it.normal(text)
            n = -(-len(text) // chunk)
            part = [text[k * chunk : (k + 1) * chunk + it.reach] for k in range(n)]
            size = [min(chunk, len(text) - k * chunk) for k in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array([mark] * n), pa.array(range(n), pa.int32()), pa.array(size, pa.int32()), pa.array(part, pa.string())], names=["mark", "k", "size", "part"])

    chunks = stored(arrow_map(texts, cut, "mark string, k int, size int, part string"), "pieces-chunks")
    # Few bytes hold much work, so tasks are dealt by the number of chunks.
    tasks = max(1, -(-chunks.count() // TASK_CHUNKS))
    dealt = chunks.repartition(tasks, "mark", "k")

    def matrices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        it = lattice()
        m = [it.transfer(t, n).tobytes() for t, n in zip(batch["part"].to_pylist(), batch["size"].to_pylist())]
        yield pa.RecordBatch.from_arrays([batch["mark"], batch["k"], pa.array(m, pa.binary())], names=["mark", "k", "m"])

    def scan(t: pa.Table) -> pa.Table:
        t = t.sort_by("k")
        side = math.isqrt(len(t["m"][0].as_py()) // 8)
        before = prefix_scores(np.frombuffer(b"".join(t["m"].to_pylist()), np.int64).reshape(-1, side, side))
        return pa.table({"mark": t["mark"], "k": t["k"], "before": pa.array(list(before), pa.list_(pa.int64()))})

    scores = arrow_map(dealt, matrices, "mark string, k int, m binary").groupBy("mark").applyInArrow(scan, "mark string, k int, before array<long>")

    def walked(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        it = lattice()
        rows = [it.walk(*x) for x in zip(*(batch[c].to_pylist() for c in ("part", "size", "before")))]
        kinds = (pa.binary(), pa.list_(pa.int32()), pa.list_(pa.binary()))
        yield pa.RecordBatch.from_arrays([batch["mark"], batch["k"], *(pa.array(list(c), t) for c, t in zip(zip(*rows), kinds))], names=["mark", "k", "shared", "enter", "tails"])

    ways = arrow_map(dealt.join(scores.repartition(tasks, "mark", "k"), ["mark", "k"]).select("mark", "k", "part", "size", "before"), walked, "mark string, k int, shared binary, enter array<int>, tails array<binary>")

    def glue(t: pa.Table) -> pa.Table:
        t = t.sort_by("k")
        last = followed(t["enter"].to_pylist())
        ids = b"".join(x for shared, tails, j in zip(t["shared"], t["tails"], last) for x in (shared.as_py(), tails[j].as_py()))
        return pa.table({"mark": t["mark"][:1], "ids": pa.array([ids], pa.binary()), "chunks": pa.array([len(last)], pa.int32())})

    glued = ways.groupBy("mark").applyInArrow(glue, "mark string, ids binary, chunks int")
    back = large.join(glued, F.col("__mark") == F.col("mark"), "left").select(*columns, "ids", "chunks")
    return plain.unionByName(back)


def checked(encoded: DataFrame, model: str | None = None, text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """encoded (of tokens()) without its text: n_tokens, ids_sha256, decoded_sha256, round_trip, and ids as an array if asked for."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_model(vocabulary(encoded.sparkSession, model)))
    made: dict = {}
    names = [f for f in encoded.schema.fields if f.name not in (text_col, "ids")]
    columns = [f.name for f in names]
    more = T.StructType.fromDDL("n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + (", ids array<int>" if with_ids else ""))
    schema = T.StructType([*names, *more.fields])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        it = made.setdefault("it", None) or made.update(it=Lattice(*shared.value)) or made["it"]
        n, digest, back, same, ids = [], [], [], [], []
        for text, raw in zip(batch[text_col].to_pylist(), batch["ids"].to_pylist()):
            x = np.frombuffer(raw, "<i4")
            text, again = text or "", it.decode(x)
            n.append(len(x))
            digest.append(hashlib.sha256(raw).hexdigest())
            back.append(hashlib.sha256(again.encode()).hexdigest())
            same.append(again == text)
            ids.append(x)
        extra = [pa.array(n, pa.int64()), pa.array(digest), pa.array(back), pa.array(same, pa.bool_())] + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), *extra], names=[*columns, "n_tokens", "ids_sha256", "decoded_sha256", "round_trip", *(["ids"] if with_ids else [])])

    return arrow_map(encoded, run, schema)


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return checked(tokens(docs), with_ids=False)


QUERIES = {"op7_pieces": op7_pieces}
ORACLE: dict[str, str] = {}

"""The corpus operators against brute force, and on tables of edge cases and empty tables."""

import base64
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tidemill.llm import components, media, minhash, mixing, pieces, registry, secrets, sharding, suffix, textnp, topk, toxicity, warc
from tidemill.llm.common import new_path, stored

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, folder):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source").collect()]


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, nothing, name):
    assert registry.QUERIES[name](spark, nothing).collect() == []


SQL_DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SQL_DATA).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SQL_DATA}/{t}.parquet')")
    want = con.execute(registry.ORACLE[name])
    names = [c[0] for c in want.description]
    got = registry.QUERIES[name](spark, SQL_DATA)
    assert sorted(got.columns) == sorted(names)
    cell = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    assert Counter(tuple(map(cell, r)) for r in got.select(*names).collect()) == Counter(tuple(map(cell, r)) for r in want.fetchall())


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    """Texts above the size at which batches are cut (PART_BYTES), one of them twice, beside short ones."""
    rng, folder = random.Random(12), str(tmp_path_factory.mktemp("long"))
    words = ["".join(rng.choice("aeilnorst") for _ in range(rng.randrange(2, 9))) for _ in range(4000)]
    text = " ".join(rng.choice(words) for _ in range(110_000))
    assert len(text) > 600_000
    rows = [(1, text, "a"), (2, text, "b"), (3, text + " end", "a"), (4, "short", None), (6, "x" * 650_000, "b")]
    spark.createDataFrame([(*r, "en", 0) for r in rows], "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(r[0], "u", r[1]) for r in rows], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - {"op6_topk"}))
def test_very_long_texts(spark, long_texts, name):
    got = {r[0]: r for r in registry.QUERIES[name](spark, long_texts).collect()}
    assert sorted(got) == [1, 2, 3, 4, 6]
    if name == "op2_minhash":
        assert [got[i]["component_id"] for i in (1, 2, 3, 4, 6)] == [1, 1, 1, 4, 6]
    if name == "op3_suffix":
        assert [got[i]["n_bytes"] - got[i]["n_removed"] for i in (1, 2, 3, 4)] == [0, 0, 4, 5] and got[6]["n_removed"] == 650_000
    if name == "op7_pieces":
        assert got[1]["chunks"] > 10 and all(r["round_trip"] for r in got.values())
    if name == "op1_warc":
        assert got[2]["refers_to"] == 1 and got[6]["payload_bytes"] == 650_000


def test_empty_pipeline(spark, nothing):
    assert corpus_pipeline.run(spark, nothing).collect() == []


def lowered(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORDS.findall(text or "")]


def shingle_set(text, n):
    w = lowered(text)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def groups(ids, texts, n):
    sets, parent, seen = [shingle_set(t, n) for t in texts], {i: i for i in ids}, defaultdict(list)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in enumerate(sets):
        for j, common in Counter(j for x in s for j in seen[x]).items():
            if 100 * common >= 80 * (len(s) + len(sets[j]) - common):
                a, b = sorted((find(ids[k]), find(ids[j])))
                parent[b] = a
        for x in s:
            seen[x].append(k)
    return {i: (len(s), find(i)) for i, s in zip(ids, sets)}


def test_minhash(spark, edge, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("abcdefghij") for _ in range(60)) for _ in range(4)]
    texts = ["", None, "one", "ONE", "a  b", "A b"]
    for i in range(160):
        w = base[i % 4].split()
        for _ in range(rng.randrange(7)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for n in (2, 5):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, n).collect()}
        assert got == groups(list(range(len(texts))), texts, n)
    rows = minhash.op2_minhash(spark, edge).collect()
    assert len(rows) == len(docs_of(spark, edge))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows if r["doc_id"] is not None)


def test_minhash_verifies_pairs_alone_in_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SIGMAS", -100.0)  # signatures rule out everything
    words = [f"w{i}" for i in range(200)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:-1], "other"])), (3, "nothing like it")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3}


def test_minhash_rows_of_one_id_are_one_node(spark):
    a, b = "one text of some words", "quite another text with other words"
    df = spark.createDataFrame([(3, a), (5, a), (5, b), (9, b), (10, "apart from all")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(df).collect())
    assert got == [(3, 3), (5, 3), (5, 3), (9, 3), (10, 10)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 100 + rng.randrange(i)) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}


def cut_by_force(texts, least):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + least] for b in raw for i in range(len(b) - least + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - least + 1):
            if seen[b[i : i + least]] > 1:
                gone[i : i + least] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [1000, 1])
def test_suffix(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "RANGES", (5, 2, 1))
    rng = random.Random(3)
    shared = ["".join(rng.choice("abcé") for _ in range(60)) for _ in range(3)]
    texts = [None, "", "short", "z" * 200]
    for i in range(70):
        t = "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(120)))
        t = [t + shared[0][rng.randrange(10) :] + t[::-1], shared[1] + t, t + shared[2][: rng.randrange(60)], t][i % 4]
        texts.append(texts[-1] if i % 11 == 0 else t + "ab" * (i % 9))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted(suffix.without_repeats(df, 24, 6, hot).collect(), key=lambda r: r["doc_id"])
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got] == cut_by_force(texts, 24)


def test_suffix_edges(spark, edge):
    docs = docs_of(spark, edge)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.op3_suffix(spark, edge).collect())
    assert got == Counter((d[0], *x) for d, x in zip(docs, cut_by_force([d[1] for d in docs], 400)))


def test_shared_prefixes():
    rng = random.Random(9)
    codes = np.array([0, *(rng.randrange(1, 4) for _ in range(300)), 0, *(rng.randrange(1, 3) for _ in range(200)), 0], np.int16)
    order, shared = suffix.shared_prefixes(codes, 12)
    text = [tuple(codes[i : i + 12]) for i in range(len(codes))]
    for k in range(1, len(order)):
        a, b = text[order[k - 1]], text[order[k]]
        if len(a) == len(b) == 12 and 0 not in a and 0 not in b:
            assert shared[k] == (a == b)


def test_mixing(spark, edge):
    docs, rows = docs_of(spark, edge), mixing.mixture(spark, edge).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(d[0] for d in docs)
    sizes = Counter()
    for _, text, source in docs:
        sizes[source] += len(WORDS.findall(text or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, free, left = {}, set(order), sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] / total > 3 * sizes[s]}
        for s in above or free:
            target[s] = 3 * sizes[s] if above else left * weight[s] / total
        left -= sum(target[s] for s in above)
        free = free - above if above else set()
    taken = Counter()
    for r in rows:
        assert (r["source_size"], r["taken"] <= 3 * r["size"]) == (sizes[r["source"]], True)
        assert r["target"] == pytest.approx(target[r["source"]])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mixture(spark, edge).collect()))
    # The draw: by key within a source, after the complete epochs, each document whole until the words run out.
    by_source = defaultdict(list)
    for r in rows:
        by_source[r["source"]].append(r)
    for source, inside in by_source.items():
        left = round(target[source]) - sum(r["epochs"] * r["size"] for r in inside)
        for k, group in itertools.groupby(sorted(inside, key=lambda r: r["es_key"]), key=lambda r: r["es_key"]):
            group = list(group)
            part = sum(r["taken"] - r["epochs"] * r["size"] for r in group)
            assert part == min(left, sum(r["size"] for r in group))
            left -= part
        assert left == 0


@pytest.mark.parametrize("sizes", [[5, 1, 1, 90], [10], [0, 0], [3, 3, 3, 3, 3, 3, 3], [1, 1000, 2, 50, 700, 0, 9], [100, 1, 1]])
def test_targets(spark, sizes):
    names = [f"s{i:02}" for i in range(len(sizes) - 1)] + [None]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")).collect()}
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    want, free, left = {}, set(names), sum(sizes)
    while free:
        total = sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] / total > 3 * sizes[names.index(s)]}
        for s in above or free:
            want[s] = 3 * sizes[names.index(s)] if above else left * weight[s] / total
        left -= sum(want[s] for s in above)
        free = free - above if above else set()
    assert got == pytest.approx(want)


def test_mixing_prefers_weight(spark):
    rows = [(i, "a", 10, i) for i in range(400)] + [(1000 + i, "b", 10, i) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, mark long")
    from pyspark.sql import functions as F

    out = mixing.mix(df, F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0)).where("source = 'b'").groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.sum("taken").alias("t"))
    by = {r["odd"]: r["t"] for r in out.collect()}
    assert by[0] > by[1]


def base_spans(text):
    assign = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    return sorted(found + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24])


def test_secrets(spark, edge, tmp_path):
    secret = ["Secret=token:abcdef", "API_KEY = 'zzzzzz9' 😀 password: hunter22", "AKIAAKIA" + "Q" * 20, "0123456789abcdef" * 3 + "g", "passwd=abc tokenX", "token = " + "f00d" * 10, "key AbCdEfGhIjKlMnOpQrStUvWxYz0123456789"]
    texts = secret + [d[1] for d in docs_of(spark, edge)] + ["password=example1"] * 30
    spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in secrets.op5_secrets(spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        want = base_spans(text or "")
        said = [f"{k}:{a}:{b}" for a, _, b, k in want]
        assert rows[i]["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert [rows[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x[3] == k for x in want) for k in ("assign", "access", "hex")]
        assert set(said) <= set(filter(None, rows[i]["spans"].split(",")))
    assert rows[6]["spans"] == "blob:4:40" and rows[6]["n_live"] == 1
    assert rows[len(texts) - 1]["n_live"] == 0 and rows[1]["n_live"] == 2  # a value that thirty owners have is an example
    assert len(secrets.op5_secrets(spark, edge).collect()) == len(docs_of(spark, edge))


def test_secrets_of_one_owner_stay_live(spark, tmp_path):
    rows = [(i, f"token = hot9secret {i % 3}", "hot") for i in range(260)] + [(1000 + i, "token = copied77", f"s{i}") for i in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    live = {r["doc_id"]: r["n_live"] for r in secrets.op5_secrets(spark, str(tmp_path)).collect()}
    assert all(n == (1 if i < 1000 else 0) for i, n in live.items())
    docs = spark.createDataFrame([(*r, "en", 0) for r in rows], "doc_id long, text string, source string, lang string, n_chars long")
    texts = {r["doc_id"]: r["text"] for r in corpus_pipeline.without_secrets(spark, docs, str(tmp_path)).collect()}
    assert all(("[SECRET]" in t) == (i < 1000) for i, t in texts.items())


def test_topk_of_one_id_with_two_vectors(spark):
    rows = [(0, [1, 0], 2), (0, [0, 1], 2), *((i, [i, 100 - i], 2) for i in range(1, 9))]
    vectors = spark.createDataFrame(rows, "id long, v array<long>, dim int")
    got = Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(vectors, vectors.where("id = 0"), 3).collect())
    assert got == Counter([(0, 1, 8, 8), (0, 2, 7, 7), (0, 3, 6, 6), (0, 1, 1, 99), (0, 2, 2, 98), (0, 3, 3, 97)])


def test_topk(spark, edge):
    got = [tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in topk.op6_topk(spark, edge).collect()]
    rows = [(r["vec_id"], [math.floor(256 * x) for x in r["embedding"]]) for r in spark.read.parquet(f"{edge}/embeddings.parquet").collect() if r["vec_id"] is not None and r["embedding"] and all(x is not None and math.isfinite(x) for x in r["embedding"])]
    want = []
    for q, v in {(i, tuple(v)) for i, v in rows if i % 50 == 0}:
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("n,d,scale", [(300, 8, 100), (130, 64, 40), (70, 4, 3), (4, 3, 2), (200, 5, 2**33)])
def test_bit_slices(n, d, scale):
    rng = np.random.default_rng(n)
    x, ids = rng.integers(-scale, scale, (n, d)), rng.permutation(n) * 3
    x[n // 2] = x[0]
    if scale > 2**20:
        x[:, 1:] //= 2**28
        x[:, 0] //= 2**6
    a, b, s = topk.block_top(ids, x, ids[:70], x[:70], 5)
    want = [(int(i), j, -k) for i, v in zip(ids[:70], x[:70]) for k, j in sorted((-int(v @ y), int(j)) for j, y in zip(ids, x) if j != i)[:5]]
    assert sorted(zip(a.tolist(), b.tolist(), s.tolist())) == sorted(want)


def test_sharding(spark, edge):
    docs = docs_of(spark, edge)
    rows = sharding.shards(spark.read.parquet(f"{edge}/documents.parquet"), limit=2000).collect()
    assert Counter((r["doc_id"], r["n_bytes"]) for r in rows) == Counter((d[0], len((d[1] or "").encode())) for d in docs)
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    for bits, inside in by.items():
        assert sum(r["n_bytes"] for r in inside) == inside[0]["shard_bytes"] and len(inside) == inside[0]["shard_docs"]
        assert inside[0]["oversized"] == (inside[0]["shard_bytes"] > 2000) and (not inside[0]["oversized"] or len({r["n_bytes"] for r in inside}) == 1)
        assert not any(other != bits and other.startswith(bits) for other in by)


def test_write_shards(spark, edge, tmp_path):
    sharding.write_shards(spark.read.parquet(f"{edge}/documents.parquet"), f"{tmp_path}/s", limit=5000)
    assert spark.read.parquet(f"{tmp_path}/s").count() == len(docs_of(spark, edge))


def test_media(spark, edge):
    docs, rows = docs_of(spark, edge), media.op10_media(spark, edge).collect()
    want = Counter()
    for i, text, _ in docs:
        b = (text or "").encode()
        p = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        want[i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")) for r in rows) == want


def test_media_tensors(spark, edge):
    rows = media.op10_media(spark, edge).collect()
    images = {r["doc_id"]: r for r in media.stored_media(spark.read.parquet(f"{edge}/documents.parquet").where("doc_id <> 5"), new_path(spark, "media")).collect()}
    for r in rows:
        assert len(r["rgb"]) == 3 * r["height"] * r["width"] and r["feature"].startswith(f"{r['height']}x{r['width']}:")
        if r["doc_id"] in images:
            tensor = media.rgb(*media.coefficients([bytes(images[r["doc_id"]]["media"])])[0])
            assert tensor.tobytes() == bytes(r["rgb"])
    table = spark.createDataFrame([(i, bytes(x["media"])) for i, x in images.items()] + [(-1, None)], "doc_id long, media binary")
    got = {r["doc_id"]: r for r in media.decoded(table).collect()}
    want = {r["doc_id"]: bytes(r["rgb"]) for r in rows}
    assert got[-1]["rgb"] is None and got[-1]["height"] is None
    assert all(bytes(got[i]["rgb"]) == want[i] for i in images)


def test_media_shapes():
    for blocks in (1, 6, 7, 6 * 512, 6 * 513, 6 * 512 * 4095, 6 * 512 * 4095 + 1, 2**31 // 64):
        across, down = media.shape(blocks)
        assert 0 < across <= 4095 and 0 < down <= 4095 and across * down * 6 >= blocks


def test_media_any_bytes():
    rng = random.Random(1)
    payloads = [bytes(rng.randrange(256) for _ in range(64 * n)) for n in (1, 2, 6, 7, 50, 3100)]
    assert [media.payload_of(*c) for c in media.coefficients(media.encode(payloads))] == payloads


class BitWriter:
    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += format(value, f"0{n}b") if n else ""

    def done(self):
        self.bits += "1" * (-len(self.bits) % 8)
        return bytes(int(self.bits[i : i + 8], 2) for i in range(0, len(self.bits), 8)).replace(b"\xff", b"\xff\x00")


def signed(v):
    n = abs(v).bit_length()
    return (v if v >= 0 else v + (1 << n) - 1), n


def sparse_jpeg(coef, across, down, interleaved):
    """A scalar progressive encoder of sparse coefficients, after the standard: runs of zeros, ends of bands over blocks, refinement with new coefficients."""
    symbols = bytes(r << 4 | s for r in range(16) for s in range(12))
    tables = media.huffman(0, 0, 4, media.CATEGORIES) + media.segment(0xC4, bytes([0x10]) + bytes([0] * 7 + [192] + [0] * 8) + symbols)
    code = {s: i for i, s in enumerate(symbols)}
    out = [b"\xff\xd8", media.segment(0xDB, b"\x00" + bytes(range(1, 65))), media.segment(0xC2, b"\x08" + (8 * down * 2).to_bytes(2, "big") + (8 * across * 2).to_bytes(2, "big") + b"\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00"), tables]
    cut = lambda v, al: (abs(v) >> al) * (1 if v >= 0 else -1)
    w, pred = BitWriter(), [0, 0, 0]
    assert interleaved
    for y in range(down):
        for x in range(across):
            for c, n in ((0, 4), (1, 1), (2, 1)):
                for k in range(n):
                    b = (2 * y + k // 2) * 2 * across + 2 * x + k % 2 if c == 0 else y * across + x
                    v = coef[c][b][0] >> 1
                    bits, size = signed(v - pred[c])
                    pred[c] = v
                    w.put(size, 4)
                    w.put(bits, size)
    out += [media.segment(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x00\x01"), w.done()]
    w = BitWriter()
    for y in range(down):
        for x in range(across):
            for c, n in ((0, 4), (1, 1), (2, 1)):
                for k in range(n):
                    b = (2 * y + k // 2) * 2 * across + 2 * x + k % 2 if c == 0 else y * across + x
                    w.put(coef[c][b][0] & 1, 1)
    out += [media.segment(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x00\x10"), w.done()]

    def flush(w, run):
        if run:
            n = run.bit_length() - 1
            w.put(code[n << 4], 8)
            w.put(run - (1 << n), n)

    for c in range(3):
        for ss, se in ((1, 5), (6, 63)):
            w, run = BitWriter(), 0
            for block in coef[c]:
                zeros, last = 0, max([k for k in range(ss, se + 1) if cut(block[k], 1)], default=None)
                if last is None:
                    run += 1
                    continue
                flush(w, run)
                run = 0
                for k in range(ss, last + 1):
                    v = cut(block[k], 1)
                    if not v:
                        zeros += 1
                        continue
                    while zeros > 15:
                        w.put(code[0xF0], 8)
                        zeros -= 16
                    bits, size = signed(v)
                    w.put(code[zeros << 4 | size], 8)
                    w.put(bits, size)
                    zeros = 0
                run = 1 if last < se else 0
                if run:
                    flush(w, 1)
                    run = 0
            flush(w, run)
            out += [media.segment(0xDA, bytes((1, c + 1, 0, ss, se, 1))), w.done()]
        w, run, held = BitWriter(), 0, ""
        for block in coef[c]:
            new = [k for k in range(1, 64) if abs(block[k]) == 1]
            pos = 1
            if new:
                flush(w, run)
                w.bits += held
                run, held = 0, ""
            for k in new:
                zeros, fix = 0, ""
                for j in range(pos, k):
                    if abs(block[j]) > 1:
                        fix += str(abs(block[j]) & 1)
                    else:
                        zeros += 1
                        if zeros == 16:
                            w.put(code[0xF0], 8)
                            w.bits += fix
                            zeros, fix = 0, ""
                w.put(code[zeros << 4 | 1], 8)
                w.put(block[k] > 0, 1)
                w.bits += fix
                pos = k + 1
            if pos < 64:
                run += 1
                held += "".join(str(abs(block[j]) & 1) for j in range(pos, 64) if abs(block[j]) > 1)
        flush(w, run)
        w.bits += held
        out += [media.segment(0xDA, bytes((1, c + 1, 0, 1, 63, 0x10))), w.done()]
    return b"".join([*out, b"\xff\xd9"])


def test_progressive_decoder():
    rng = random.Random(4)
    across, down = 3, 2
    value = lambda: rng.choice([0] * 12 + [1, -1, 2, -3, 7, -60, 255])
    coef = [[[rng.randrange(-300, 300), *(value() if rng.random() < 0.7 else 0 for _ in range(63))] if rng.random() < 0.7 else [0] * 64 for _ in range(n)] for n in (4 * across * down, across * down, across * down)]
    frame, parts = media.coefficients([sparse_jpeg(coef, across, down, True)])[0]
    for want, got in zip(coef, parts):
        assert got.tolist() == want
    tensor = media.rgb(frame, parts)
    assert tensor.shape == (32, 48, 3)
    # A flat image: only DC, grey.
    flat = [[[80] + [0] * 63 for _ in part] for part in coef]
    for part in flat[1:]:
        for block in part:
            block[0] = 0
    tensor = media.rgb(*media.coefficients([sparse_jpeg(flat, across, down, True)])[0])
    assert (tensor == 138).all()


def test_warc(spark, edge, monkeypatch):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        rows = warc.op1_warc(spark, edge).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    pages = [tuple(r) for r in spark.read.parquet(f"{edge}/pages.parquet").select("page_id", "html").collect()]
    first, want = {}, Counter()
    for i, html in pages:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    for i, html in pages:
        b, f = (html or "").encode(), first.get(html or "")
        revisit = f is not None and f != i
        want[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", f if revisit else None] += 1
    assert Counter(tuple(r) for r in rows) == want


@pytest.mark.parametrize("block", ["300", "100000"])
def test_warc_magic_in_url(spark, block):
    odd = {0: "http://x/WARC/1.0", 3: "http://x/WARC/1.1/WARC/1.", 4: "WARC/1.", 11: "WARC/1.WARC/1.1 a"}
    rows = [(i, odd.get(i, f"http://x/{i}"), f"<p>{i}</p>" + "WARC/1.1 " * (i % 4 == 3)) for i in range(12)]
    path = new_path(spark, "w")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        got = warc.digests(warc.read_warc(spark, path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = sorted((i, u, len(t), base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()) for i, u, t in rows)
    assert sorted((r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"]) for r in got) == want


def test_warc_min_bytes(spark):
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb")], "page_id long, url string, html string")
    path = new_path(spark, "w")
    warc.write_warc(df, path, min_bytes=3)
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.digests(warc.read_warc(spark, path)).collect()) == [(1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3)]


def test_pieces_like_the_library(spark, edge):
    import sentencepiece

    names, scores, kinds, prefix, model = pieces.read_model(pieces.MODEL)
    alone, lib = pieces.Lattice(names, scores, kinds, prefix), sentencepiece.SentencePieceProcessor(model_proto=model)
    batch = pieces.Lattice(names, scores, kinds, prefix, model)
    texts = [d[1] or "" for d in docs_of(spark, edge)] + ["The quick brown fox.\nIs jumping  over", "naïve café déjà-vu", "日本語😀", "aaaaaaa" * 9]
    total = lambda ids: sum(scores[i] for i in ids if kinds[i] != 6)
    for t, raw in zip(texts, batch.encode_all(texts)):
        assert raw == alone.encode(t)
        mine, theirs = np.frombuffer(raw, "<i4").tolist(), lib.encode(alone.normal(t))
        assert mine == theirs or total(mine) == total(theirs)
        assert alone.decode(np.array(mine, int)) == t.replace("▁", " ")


def in_chunks(it, text, chunk):
    t = it.normal(text)
    n = -(-len(t) // chunk)
    part, size = [t[k * chunk : (k + 1) * chunk + it.reach] for k in range(n)], [min(chunk, len(t) - k * chunk) for k in range(n)]
    before = pieces.prefix_scores(np.stack([it.transfer(p, s) for p, s in zip(part, size)]))
    ways = [it.walk(p, s, b.tolist()) for p, s, b in zip(part, size, before)]
    return b"".join(shared + tails[j] for (shared, _, tails), j in zip(ways, pieces.followed([w[1] for w in ways])))


@pytest.mark.parametrize("chunk", [1, 3, 17, 40, 100])
def test_chunks_are_segmented_as_the_whole(spark, edge, chunk, monkeypatch):
    monkeypatch.setattr(pieces, "SCAN", 7)
    model = pieces.read_model(pieces.MODEL)
    it = pieces.Lattice(*model)
    texts = [d[1] or "" for d in docs_of(spark, edge)][:40] + ["abc" * 60, "zq" * 90 + " b", "a" * 150, "   " * 30, "é日" * 40]
    for text in [t[:600] for t in texts if t]:
        assert in_chunks(it, text, chunk) == it.encode(text)


def test_pieces_of_texts_above_the_chunk(spark):
    """Two texts above the default chunk, one of them a single word."""
    rng = random.Random(11)
    rows = [(1, " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(1, 12))) for _ in range(6000))), (2, "".join(rng.choice("ab") for _ in range(pieces.CHUNK + 500))), (3, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (bytes(r["ids"]), r["chunks"]) for r in pieces.tokens(df).collect()}
    it = pieces.Lattice(*pieces.read_model(pieces.MODEL))
    for i, text in rows:
        assert got[i][0] == it.encode(text) and (got[i][1] > 1) == (i < 3)


def test_product_is_associative():
    rng = np.random.default_rng(0)
    a, b, c = (rng.integers(-50, 0, (5, 5)) for _ in range(3))
    assert (pieces.product(pieces.product(a, b), c) == pieces.product(a, pieces.product(b, c))).all()


def test_pieces_query(spark, edge):
    df = spark.read.parquet(f"{edge}/documents.parquet").select("doc_id", "text")
    small = pieces.checked(pieces.tokens(df, chunk=500)).collect()
    whole = pieces.op7_pieces(spark, edge).collect()
    assert len(small) == len(whole) == len(docs_of(spark, edge))
    columns = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip")
    assert Counter(tuple(r[c] for c in columns) for r in small) == Counter(tuple(r[c] for c in columns) for r in whole)
    assert max(r["chunks"] for r in small) > 1


def test_toxicity(spark, tmp_path):
    rng = random.Random(7)
    words = [a + b for a in ("ka", "lo", "mi", "re", "tu", "vo") for b in ("n", "s", "r", "l", "m")]
    rows, labels = [], []
    for i in range(1200):
        bad = i % 6 == 0
        w = [rng.choice(words) for _ in range(rng.randrange(10, 90))]
        for _ in range(2 * bad):
            w.insert(rng.randrange(len(w)), "grubl" + rng.choice(["ak", "en", "is", "or"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in toxicity.op8_toxicity(spark, str(tmp_path)).collect()}
    held = [i for i in got if got[i]["held_out"]]
    assert held and all((zlib.crc32(str(i).encode()) % 5 == 0) == got[i]["held_out"] for i in got)
    assert sum(got[i]["predicted"] == dict(labels)[i] for i in held) / len(held) > 0.97
    joined = toxicity.toxicity(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"), model_rows=0).collect()
    assert all(abs(r["score"] - got[r["doc_id"]]["score"]) < 1e-3 for r in joined)


def test_toxicity_edges(spark, edge):
    rows = toxicity.op8_toxicity(spark, edge).collect()
    assert len(rows) == len(docs_of(spark, edge)) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_toxicity_counts_every_preceding_word(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(toxicity, "CHUNK", 100)
    rng = random.Random(5)
    texts = [(" ".join(f"w{rng.randrange(300)} hub" if rng.random() < 0.5 else f"w{rng.randrange(300)}" for _ in range(60)), int(i % 5 == 0)) for i in range(60)]
    rows = spark.createDataFrame(texts, "text string, __toxic int").repartition(5)
    words, kept, model = toxicity.counted(rows, 6)
    got, pairs_of = {r["h"]: r for r in words.collect()}, {r["h"]: (r["n_toxic"], r["n_other"]) for r in kept.collect()}
    pairs = Counter((v, w, c) for t, c in texts for v, w in zip(["", *t.split()], t.split()))
    names = sorted({w for _, w, _ in pairs})
    assert len({v for v, w, _ in pairs if w == "hub"}) > 200
    t = toxicity.Tokens(pa.array(names))
    key = dict(zip(names, t.words[t.word].tolist())) | {"": 0}
    for w in names:
        n = got[key[w]]
        assert n["k"] == len({v for v, x, _ in pairs if x == w})
        assert n["n_toxic"] == sum(n for (_, x, c), n in pairs.items() if x == w and c == 1)
        assert n["types_other"] == len({x for v, x, c in pairs if v == w and c == 0})
        assert n["after_other"] == sum(n for (v, _, c), n in pairs.items() if v == w and c == 0)
    both = {(v, w): (pairs[v, w, 1], pairs[v, w, 0]) for v, w, _ in pairs}
    of = {p: int(toxicity.pair_keys(np.array([key[p[0]]], np.uint64), np.array([key[p[1]]], np.uint64))[0]) for p in both}
    assert pairs_of == {of[p]: n for p, n in both.items() if n[0] or n[1] >= toxicity.CUTOFF}
    once, twice = (sum(n[1] == i for n in both.values()) for i in (1, 2))
    assert model.pair_discount[1] == pytest.approx(once / (once + 2 * twice))


def test_toxicity_ratio_by_brute_force(spark, tmp_path):
    """mean_llr of texts from the formulas of the docstring, with dictionaries."""
    rng = random.Random(8)
    stems = ["alpha", "betaa", "gamma"]
    rows = [(i, " ".join(rng.choice(stems) + rng.choice("abcd") for _ in range(rng.randrange(1, 30))), int(i % 4 == 0)) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    got = {r["doc_id"]: r["e0"] for r in toxicity.toxicity(docs.select("doc_id", "text"), docs.select("doc_id", "toxic")).collect()}
    n, pre = [Counter(), Counter()], [Counter(), Counter()]
    for i, t, c in rows:
        if zlib.crc32(str(i).encode()) % 5:
            w = t.split()
            n[c].update(w)
            pre[c].update(zip(["", *w], w))
    stem_of = lambda w: w[:5]
    k = Counter(w for _, w in {*pre[0], *pre[1]})
    ks = Counter()
    for w, m in k.items():
        ks[stem_of(w)] += m
    discount = lambda counts: (lambda a, b: a / (a + 2 * b) if a and b else 0.5)(sum(x == 1 for x in counts.values()), sum(x == 2 for x in counts.values()))

    def p(c, v, w):
        total, s = sum(n[c].values()), Counter()
        for x, m in n[c].items():
            s[stem_of(x)] += m
        q = max(s[stem_of(w)] - discount(s), 0) / total + discount(s) * len(s) / total * max(ks[stem_of(w)], 1) / sum(k.values())
        one = max(n[c][w] - discount(n[c]), 0) / total + discount(n[c]) * len(n[c]) / total * q * max(k[w], 1) / max(ks[stem_of(w)], 1)
        after = {x: m for (u, x), m in pre[c].items() if u == v}
        if not after:
            return one
        d, seen = discount(pre[c]), pre[c][v, w]
        if pre[1][v, w] == 0 and pre[0][v, w] < toxicity.CUTOFF:
            seen = 0
        return (max(seen - d, 0) + d * len(after) * one) / sum(after.values())

    for i, t, _ in rows:
        w = t.split()
        assert got[i] == pytest.approx(sum(math.log(p(1, v, x) / p(0, v, x)) for v, x in zip(["", *w], w)) / len(w), abs=1e-9)


def test_toxicity_of_a_sequence(spark):
    rng = random.Random(6)
    rows = []
    for i in range(900):
        words, bad = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(20, 60))], i % 3 == 0
        at = rng.randrange(len(words))
        words[at:at] = ["red", "door"] if bad else ["door", "red"]
        rows.append((i, " ".join(words), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.toxicity(docs.select("doc_id", "text"), docs.select("doc_id", "toxic")).where("held_out").collect()
    assert sum(r["predicted"] == rows[r["doc_id"]][2] for r in got) / len(got) > 0.97


def test_tokens_of_a_chunk_take_little_memory():
    """A chunk of 3.5 MB: two workers of an executor have one each, beside a heap that takes most of its memory."""
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(5000)]
    texts = [" ".join(rng.choice(words) for _ in range(500)) for _ in range(1000)]
    column = pa.array([*texts[:500], " ".join(texts[500:])])
    tracemalloc.start()
    t = toxicity.Tokens(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(t.word) == 500_000 and list(np.diff(t.row)) == [500] * 500 + [250_000]
    assert peak < 100_000_000


def test_words_and_stems_in_pieces():
    import pyarrow as pa

    rng = random.Random(3)
    for _ in range(200):
        texts = [rng.choice([None, "", "".join(rng.choice(["a", "B", "é", "-", " ", "\t", "日", "1"]) for _ in range(rng.randrange(60)))]) for _ in range(5)]
        body, at = textnp.bytes_of(pa.array(texts, pa.string()))
        hashes, row = textnp.lower_word_hashes(body, at)
        whole = textnp.lower_words_and_stems(body, at, 5)
        assert np.array_equal(whole[0], hashes) and np.array_equal(whole[2], row)
        for size in (1, 2, 7, 50):
            assert all(np.array_equal(x, y) for x, y in zip(textnp.lower_words_and_stems(body, at, 5, size), whole))


def test_word_hashes():
    import pyarrow as pa

    texts = ["", None, "a", "A b", "a  B\tc\x0bd", "x y z x y", "é è", "é\x85 x"]
    sets = textnp.shingle_sets(pa.array(texts), 2)
    assert [len(s) for s in sets] == [len(shingle_set(t, 2)) for t in texts]


def test_pipeline(spark, edge):
    docs = spark.read.parquet(f"{edge}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, edge)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        path = new_path(spark, "stage")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
        if name == "near_duplicates":
            texts = [r["text"] for r in docs.collect()]
            assert len([t for t in texts if t == "a b"]) == 1
        if name == "secrets":
            texts = [r["text"] or "" for r in docs.collect()]
            assert any("[SECRET]" in t for t in texts) and not any("abc123xyz" in t for t in texts)
    assert docs.where("round_trip").count() >= counts[-1] - 3


def secret_spans(text):
    """(start, end, kind, value) of base spans and mixed blobs."""
    value = {(m.start(), m.end()): m[2] for m in re.finditer(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text)}
    found = [(a, b, k, value[a, b] if k == "assign" else text[a:b]) for a, _, b, k in base_spans(text)]
    blobs = [m for m in re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}", text) if re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[0-9]", m[0])]
    return found + [(m.start(), m.end(), "blob", m[0]) for m in blobs]


def test_pipeline_by_brute_force(spark, edge, tmp_path):
    """Each stage, on what the stage before it kept, against a plain version; the toxic rows are those of the model, which has a test of its own."""
    every = spark.read.parquet(f"{edge}/documents.parquet").where("doc_id IS NOT NULL AND (doc_id <> 5 OR text NOT LIKE 'another%')")
    every.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{edge}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    toxic = {r["doc_id"] for r in toxicity.toxicity(every.select("doc_id", "text"), labels).where("predicted = 1").collect()}
    got = {}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = new_path(spark, "stage")
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        got[name] = [(r["doc_id"], r["source"], r["text"]) for r in docs.collect()] if name != "tokens" else docs.collect()

    want = [(r["doc_id"], r["source"], r["text"]) for r in every.collect() if r["doc_id"] not in toxic]
    assert toxic and Counter(got["toxicity"]) == Counter(want)
    once = list(dict.fromkeys(want))
    of = groups([r[0] for r in once], [r[2] for r in once], 5)
    want = [r for r in once if of[r[0]][1] == r[0]]
    assert len(want) < len(got["toxicity"]) and Counter(got["near_duplicates"]) == Counter(want)

    owners = defaultdict(set)
    for _, source, text in want:
        for *_, value in secret_spans(text or ""):
            owners[value].add(source)

    def redacted(text):
        spans = secret_spans(text or "")
        base = [x for x in spans if x[2] != "blob"]
        live = [x for x in spans if len(owners[x[3]]) < 6 and (x[2] != "blob" or not any(b[0] < x[1] and x[0] < b[1] for b in base))]
        out, at = "", 0
        for a, b, kind, _ in sorted(live, key=lambda x: (x[0], ("assign", "access", "hex", "blob").index(x[2]))):
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        return out + text[at:] if live else text

    want = [(i, source, redacted(text)) for i, source, text in want]
    assert any("[SECRET]" in (r[2] or "") for r in want) and Counter(got["secrets"]) == Counter(want)

    size = {r[0]: len(WORDS.findall(r[2] or "")) for r in want}
    quality = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None}
    key = {i: -math.log((int(hashlib.md5(f"17\x1f{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / {1: 2.0, 0: 0.5}.get(quality.get(i), 1.0) for i in size}
    target = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame([(r[1], size[r[0]]) for r in want], "source string, size long").groupBy("source").agg({"size": "sum"}).toDF("source", "source_size")).collect()}
    copies = Counter()
    for source in {r[1] for r in want}:
        inside = sorted((r for r in want if r[1] == source), key=lambda r: (key[r[0]], r[0]))
        total = sum(size[r[0]] for r in inside)
        epochs = int(target[source] // total) if total else 0
        left = round(target[source]) - epochs * total
        for r in inside:
            copies[r] += (epochs + (left > 0)) if size[r[0]] else 0
            left -= size[r[0]]
    assert Counter(got["mixture"]) == +copies

    it = pieces.Lattice(*pieces.read_model(pieces.MODEL))
    texts = {r[0]: r[2] or "" for r in want}
    assert len(got["tokens"]) == len(got["mixture"])
    for r in got["tokens"]:
        raw = it.encode(texts[r["doc_id"]])
        assert (r["ids"], r["decoded_sha256"]) == (np.frombuffer(raw, "<i4").tolist(), hashlib.sha256(it.decode(np.frombuffer(raw, "<i4")).encode()).hexdigest())

import random

import pytest

EDGE_TEXTS = [None, "", " ", "one", "a b", "a b", "The  QUICK\tbrown\x0bfox\x85 jumps", "é" * 700, "x " * 3000, "token = 'abc123xyz' and AKIA" + "A1B2" * 5, "日本語 " * 200, "▁ mark", "WARC/1.1\r\n\r\n"]


def make(spark, folder, n=60, seed=1, empty=False):
    """Small tables with nulls, empty and long texts, repeated rows, and extra columns whose names operators use themselves."""
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta", "iota", "tau"]
    docs = [(i, t, "en", f"src{i % 3}", 0) for i, t in enumerate(EDGE_TEXTS)]
    for i in range(len(docs), len(docs) + n):
        bad = i % 5 == 1
        text = " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(rng.randrange(1, 80))) + (" you scum idiot" if bad else "")
        docs.append((i, text, rng.choice(["en", "de"]), rng.choice(["src0", "src0", "srcß", None]), len(text)))
    docs += [docs[-1], (None, "no id here at all", None, None, None), (5, "another text with the id of a row", "en", "src0", 1)]
    extra = [(*d, "x", 1, 1.0, 7) for d in docs]
    spark.createDataFrame([] if empty else extra, "doc_id long, text string, lang string, source string, n_chars long, mark string, size int, score double, key int").write.parquet(f"{folder}/documents.parquet")
    labels = [(d[0], 1, int("scum" in (d[1] or ""))) for d in docs if d[0] is not None and d[0] % 4 != 3] + [(None, 1, 1), (9, None, None)]
    spark.createDataFrame([] if empty else [(*x, "t", "s", 1, 0.5) for x in labels], "doc_id long, quality int, toxic int, text string, source string, label_id int, score double").write.parquet(f"{folder}/labels.parquet")
    pages = [(i, None if i % 7 == 0 else f"http://x/{i}\r\n", None if i % 9 == 0 else ("same" if i % 3 == 0 else f"<p>{i} WARC/1.1\r\nContent-Length: 3\r\n\r\n</p>" * (i % 5))) for i in range(40)]
    pages += [pages[-1], (None, "u", "null id")]
    spark.createDataFrame([] if empty else [(*x, "b", 1, 2, "h", "p", 3) for x in pages], "page_id long, url string, html string, block string, first int, n int, sha1 string, payload string, id int").write.parquet(f"{folder}/pages.parquet")
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(6)], 0) for i in range(120)]
    vectors += [(200, None, 0), (250, [float("nan")] * 6, 0), (251, [None, 1.0, 1.0, 1.0, 1.0, 1.0], 0), (300, [1.0, 2.0], 0), (301, [1.0, 2.0], 0), (None, [0.5] * 6, 0), (350, vectors[0][1], 0), (0, vectors[0][1], 0)]
    spark.createDataFrame([] if empty else [(*x, 1, 2, 3, 4, [5]) for x in vectors], "vec_id long, embedding array<float>, label int, id int, dim int, mark int, score int, v array<int>").write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.fixture(scope="session")
def edge(spark, tmp_path_factory):
    return make(spark, str(tmp_path_factory.mktemp("edge")))


@pytest.fixture(scope="session")
def nothing(spark, tmp_path_factory):
    return make(spark, str(tmp_path_factory.mktemp("nothing")), empty=True)

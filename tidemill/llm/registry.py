"""The queries of this subpackage and their SQL."""

from . import media, minhash, mixing, pieces, secrets, sharding, suffix, topk, toxicity, warc

MODULES = (warc, minhash, suffix, mixing, secrets, topk, pieces, toxicity, sharding, media)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in MODULES for k, v in m.ORACLE.items()}

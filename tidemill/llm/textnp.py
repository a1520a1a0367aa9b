"""Words, shingles and hashes of whole Arrow columns of text with numpy, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2^64
_rng = np.random.Generator(np.random.PCG64(20240607))
#: A random 64-bit value for each byte; and the same with A-Z as a-z.
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
LOWER_VALUE = BYTE_VALUE.copy()
LOWER_VALUE[65:91] = BYTE_VALUE[97:123]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII letters and digits, and all bytes of other characters.
IS_LETTER = np.zeros(256, bool)
IS_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Bytes of text that are hashed at once.
PIECE = 1 << 17

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse, for i < n at least."""
    have = _powers.get("p")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        for name, base in (("p", BASE), ("i", pow(BASE, -1, 2**64))):
            out = np.ones(size, np.uint64)
            out[1:] = U64(base)
            _powers[name] = np.multiply.accumulate(out)
    return _powers["p"], _powers["i"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def bytes_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a text column one after another, and where each row starts (one more at the end); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()).fill_null("" if not (pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def prefix_hash(body: np.ndarray, values: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """C with C[e] - C[s] = the polynomial of body[s:e], times BASE**s."""
    p, _ = powers(len(body) + 1)
    out = np.zeros(len(body) + 1, np.uint64)
    np.cumsum(values[body] * p[: len(body)], out=out[1:])
    return out


def range_hash(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, inverse = powers(len(c))
    return mixed((c[ends] - c[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def words_of(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (one more at the end)."""
    if not len(body):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    word = ~IS_SPACE[body]
    first = np.zeros(len(body) + 1, bool)
    first[at] = True  # no word goes over the end of a row
    starts = np.flatnonzero(word & (first[:-1] | np.concatenate(([True], ~word[:-1]))))
    ends = np.flatnonzero(word & (first[1:] | np.concatenate((~word[1:], [True])))) + 1
    return starts, ends, np.searchsorted(starts, at)


def lower_word_hashes(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word with A-Z as a-z, and for each row the index of its first word."""
    starts, ends, row = words_of(body, at)
    return range_hash(prefix_hash(body, LOWER_VALUE), starts, ends), row


def pieces_of(body: np.ndarray, at: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Starts and ends of pieces of `size` bytes, or more up to the next end of a word; all together are the body."""
    start = 0
    while start < len(body):
        end = min(start + size, len(body))
        stop = at[np.searchsorted(at, end)]
        while end < stop:
            space = IS_SPACE[body[end : min(end + size, stop)]]
            if space.any():
                end += int(space.argmax())
                break
            end += len(space)
        yield start, int(end)
        start = int(end)


def lower_words_and_stems(body: np.ndarray, at: np.ndarray, stem: int, size: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As lower_word_hashes, with a hash of each word's stem in the middle: the first `stem` bytes of its first run of letters and digits (without such, of
    the word); it never equals the hash of a word by design. A byte takes a hundred in arrays, so pieces of `size` bytes are hashed one after another."""
    none = np.zeros(0, np.uint64)
    hashes, stems, firsts = [none], [none], [np.zeros(0, np.int64)]
    for s, e in pieces_of(body, at, size):
        part = body[s:e]
        starts, ends, _ = words_of(part, at[np.searchsorted(at, s) : np.searchsorted(at, e, "right")] - s)
        c = prefix_hash(part, LOWER_VALUE)
        letter = np.flatnonzero(IS_LETTER[part])
        other = np.flatnonzero(~IS_LETTER[part])
        first = np.concatenate((letter, [len(part)]))[np.searchsorted(letter, starts)]
        first = np.where(first < ends, first, starts)
        last = np.concatenate((other, [len(part)]))[np.searchsorted(other, first)]
        last = np.minimum(np.where(last > first, last, ends), np.minimum(ends, first + stem))
        hashes.append(range_hash(c, starts, ends))
        stems.append(mixed(range_hash(c, first, last) + U64(BASE)))
        firsts.append(starts + s)
    return np.concatenate(hashes), np.concatenate(stems), np.searchsorted(np.concatenate(firsts), at)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word shingles of one row's word hashes; of the whole sequence if it is shorter; none without words."""
    if not len(hashes):
        return hashes
    k = min(n, len(hashes))
    out = np.full(len(hashes) - k + 1, 0x243F6A8885A308D3 + k, np.uint64)
    for i in range(k):
        out = mixed(out * U64(BASE) + hashes[i : i + len(out)])
    return out


def shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each row."""
    hashes, row = lower_word_hashes(*bytes_of(column))
    return [np.unique(shingles(hashes[s:e], n)) for s, e in zip(row[:-1], row[1:])]

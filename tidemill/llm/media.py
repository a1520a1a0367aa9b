"""Media columns: progressive JPEG, decoded with numpy to full-resolution RGB tensors; and bytes stored losslessly as its coefficients.

Decoding. Scans of any spectral selection and successive approximation, interleaved or not, with or without restart intervals, are
accumulated into coefficient arrays; the inverse transform is one product with a 64 x 64 matrix of scaled integers (exact in floats, so equal images
give equal pixels anywhere), chroma is repeated to full resolution, and colours are converted in integers. Entropy-coded segments do
not depend on each other; all segments of a batch that share tables and scan parameters advance in step, a block at a time, on arrays.
Runs of one Huffman symbol, which tell where every coefficient stands, are read at once.

Storing bytes. A group of 64 bytes becomes a block: coefficient k is 256 + byte k, non-zero and of nine digits whatever the byte is. A 4:2:0 colour
image of whole MCUs holds the blocks in order, luma first; the comment says how many bytes count.

Defined results: null and empty texts are a payload of 64 zero bytes; a null media value decodes to nulls; JPEG processes other than progressive are an
error; a text of any length that a column holds is one image; rows that repeat another have equal values; an empty table gives no rows; columns besides id
and text, or media, may have any names but the results'.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, new_path, table

UNIT = 64
RESTART = 16
#: MCUs in a row of an image that holds bytes, and the most rows, and MCUs in a row, that the format has: 6.4 GB, three times what a value of a column holds.
ROW_MCUS, MAX_MCUS = 512, 4095
BAND = 48  # coefficients 1..BAND in one scan at full precision, the others by successive approximation


@lru_cache(1)
def zigzag() -> np.ndarray:
    """Row * 8 + column of the k-th coefficient: along the anti-diagonals, each the other way from the last."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


SHIFT = 20


@lru_cache(1)
def inverse() -> np.ndarray:
    """Pixels of each coefficient in zigzag order, times 2^SHIFT, rounded."""
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    a = np.cos((2 * x + 1) * u * math.pi / 16) * np.where(u == 0, math.sqrt(0.125), 0.5)
    full = np.einsum("ux,vy->uvxy", a, a).reshape(64, 64)
    return np.rint(full[zigzag()] * 2**SHIFT)


# ---- writing


def segment(code: int, body: bytes) -> bytes:
    return bytes((0xFF, code)) + (len(body) + 2).to_bytes(2, "big") + body


def huffman(kind: int, slot: int, length: int, symbols: bytes) -> bytes:
    """A table whose codes are all of one length, in the order of the symbols."""
    return segment(0xC4, bytes((kind << 4 | slot,)) + bytes(len(symbols) if i + 1 == length else 0 for i in range(16)) + symbols)


CATEGORIES = bytes(range(12))
RST = [bytes((0xFF, 0xD0 + i)) for i in range(8)]
HEADERS = {
    "dc": huffman(0, 0, 4, CATEGORIES),
    "low": huffman(1, 0, 7, b"\x09"),  # seven zeros, then 1 and the byte
    "high": huffman(1, 0, 8, b"\x08"),
    "more": huffman(1, 0, 1, b"\x00"),
}
SCANS = (("dc", 0, 0, 0, 1), ("low", 1, BAND, 0, 0), ("high", BAND + 1, 63, 0, 1), ("dc_more", 0, 0, 1, 0), ("more", BAND + 1, 63, 1, 0))


def shape(blocks: int) -> tuple[int, int]:
    """MCUs across and down; rows are longer than ROW_MCUS only where there would be too many."""
    mcus = -(-blocks // 6)
    across = max(ROW_MCUS, -(-mcus // MAX_MCUS))
    down = -(-mcus // across)
    return -(-mcus // down), down


def dc_bits(dc: np.ndarray, first: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The first DC scan of all blocks; first: the blocks that start a segment. Bytes, and where each segment starts (one more at the end)."""
    value = dc.astype(np.int64) >> 1
    before = np.concatenate(([0], value[:-1]))
    before[first] = 0
    diff = value - before
    cat = np.frexp(np.abs(diff).astype(np.float64))[1].astype(np.int64)
    bits, size = (cat << cat) | np.where(diff >= 0, diff, diff + (1 << cat) - 1), 4 + cat
    upto = np.cumsum(size)
    lengths = (np.add.reduceat(size, first) + 7) // 8
    at = np.concatenate(([0], np.cumsum(lengths)))
    begun = np.zeros(len(dc), np.int64)
    begun[first] = 1
    owner = np.cumsum(begun) - 1
    inside = upto - size - (upto - size)[first][owner]
    pos = at[:-1][owner] * 8 + inside
    out = np.ones(at[-1] * 8, np.uint8)
    for j in range(int(size.max())):
        on = size > j
        out[pos[on] + j] = (bits[on] >> (size[on] - 1 - j)) & 1
    return np.packbits(out).tobytes(), at


def stuffed(data: bytes) -> bytes:
    return data.replace(b"\xff", b"\xff\x00") if b"\xff" in data else data


def encode(payloads: list[bytes]) -> list[bytes]:
    """An image for each payload, of a positive multiple of UNIT bytes."""
    plan, pieces, first, at = [], [], [], 0
    for p in payloads:
        n = len(p) // UNIT
        across, down = shape(n)
        total = across * down * 6
        pieces += [p, bytes((total - n) * UNIT)]
        begins = (at, at + across * down * 4, at + across * down * 5, at + total)
        segments = [[(s, min(s + RESTART, e)) for s in range(b, e, RESTART)] for b, e in zip(begins, begins[1:])]
        plan.append((len(p), across, down, segments))
        first += [s for comp in segments for s, _ in comp]
        at += total
    blocks = np.frombuffer(b"".join(pieces), np.uint8).reshape(-1, 64)
    value = blocks.astype(np.int16) + 256
    dc, dc_at = dc_bits(value[:, 0], np.array(first))
    low = np.ones((len(blocks), BAND, 2), np.uint8)
    low[:, :, 1] = blocks[:, 1 : BAND + 1]
    high = np.zeros((len(blocks), 63 - BAND, 2), np.uint8)
    high[:, :, 1] = value[:, BAND + 1 :] >> 1
    more = np.zeros((len(blocks), 64 - BAND), np.uint8)
    more[:, 1:] = blocks[:, BAND + 1 :] & 1
    bodies = {"low": (low.tobytes(), BAND * 2), "high": (high.tobytes(), (63 - BAND) * 2), "more": (np.packbits(more, axis=1).tobytes(), (64 - BAND) // 8)}
    last_dc = blocks[:, 0] & 1
    out, k = [], 0
    for size, across, down, segments in plan:
        image = [b"\xff\xd8", segment(0xFE, b"payload " + str(size).encode()), segment(0xDB, b"\x00" + b"\x01" * 64)]
        image.append(segment(0xC2, b"\x08" + (16 * down).to_bytes(2, "big") + (16 * across).to_bytes(2, "big") + b"\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00"))
        image.append(segment(0xDD, RESTART.to_bytes(2, "big")))
        for name, ss, se, ah, al in SCANS:
            image.append(HEADERS.get(name, b""))
            j = k
            for c, comp in enumerate(segments):
                image.append(segment(0xDA, bytes((1, c + 1, 0, ss, se, ah << 4 | al))))
                if name == "dc":
                    parts = [dc[dc_at[j + i] : dc_at[j + i + 1]] for i in range(len(comp))]
                elif name == "dc_more":
                    parts = []
                    for s, e in comp:
                        bits = np.ones(-(-(e - s) // 8) * 8, np.uint8)
                        bits[: e - s] = last_dc[s:e]
                        parts.append(np.packbits(bits).tobytes())
                else:
                    body, width = bodies[name]
                    parts = [body[s * width : e * width] for s, e in comp]
                j += len(comp)
                image += [x for i, part in enumerate(parts) for x in ((RST[(i - 1) % 8], stuffed(part)) if i else (stuffed(part),))]
        k = j
        image.append(b"\xff\xd9")
        out.append(b"".join(image))
    return out


# ---- reading


@lru_cache(64)
def lookup_table(spec: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Length and symbol of the code at the head of each 16-bit window; length 0: none."""
    size, symbol = np.zeros(65536, np.int64), np.zeros(65536, np.int64)
    code, k = 0, 16
    for length in range(1, 17):
        for _ in range(spec[length - 1]):
            at = code << (16 - length)
            size[at : at + (1 << (16 - length))] = length
            symbol[at : at + (1 << (16 - length))] = spec[k]
            code, k = code + 1, k + 1
        code <<= 1
    return size, symbol


class Bits:
    """Windows of up to 16 bits anywhere in a buffer."""

    def __init__(self, data: bytes) -> None:
        b = np.frombuffer(data + b"\xff" * 64, np.uint8).astype(np.uint32)
        self.words = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]

    def peek(self, pos: np.ndarray) -> np.ndarray:
        w = self.words[np.minimum(pos >> 3, len(self.words) - 1)]
        return ((w << (pos & 7).astype(np.uint32)) >> np.uint32(16)).astype(np.int64)

    def take(self, pos: np.ndarray, n: np.ndarray) -> np.ndarray:
        """n (0 to 16) bits at each position."""
        return self.peek(pos) >> (16 - n)


def extended(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The signed value of size bits."""
    return np.where(bits < (1 << np.maximum(size - 1, 0)), bits - (1 << size) + 1, bits) * (size > 0)


def decode_streams(coef: np.ndarray, streams: list[tuple[bytes, np.ndarray, np.ndarray]], scan: tuple[int, int, int, int], tables: dict[int, bytes] | bytes) -> None:
    """Adds one scan to coef (blocks, 64). streams: a segment's bytes, its blocks in order, and each block's component (for DC tables and predictions)."""
    ss, se, ah, al = scan
    streams = sorted(streams, key=lambda s: -len(s[1]))  # so that those still at work come first
    sizes = np.array([len(s[1]) for s in streams])
    starts = np.concatenate(([0], np.cumsum([len(s[0]) + 8 for s in streams])))[:-1]
    bits = Bits(b"".join(s[0] + b"\xff" * 8 for s in streams))
    steps = int(sizes.max()) if len(sizes) else 0
    blocks = np.zeros((len(streams), steps), np.int64)
    comps = np.zeros((len(streams), steps), np.int64)
    for i, (_, b, c) in enumerate(streams):
        blocks[i, : len(b)], comps[i, : len(b)] = b, c
    pos = starts.astype(np.int64) * 8
    run = np.zeros(len(streams), np.int64)
    pred = np.zeros((len(streams), 4), np.int64)
    for step in range(steps):
        live = int(np.searchsorted(-sizes, -step, "left"))
        b = blocks[:live, step]
        if ss == 0 and ah:
            coef[b, 0] |= (bits.peek(pos[:live]) >> 15) << al
            pos[:live] += 1
        elif ss == 0:
            c, i = comps[:live, step], np.arange(live)
            window = bits.peek(pos[:live])
            length, size = np.zeros(live, np.int64), np.zeros(live, np.int64)
            for comp, spec in tables.items():
                of = c == comp
                if of.any():
                    t = lookup_table(spec)
                    length[of], size[of] = t[0][window[of]], t[1][window[of]]
            pos[:live] += length
            pred[i, c] += extended(bits.take(pos[:live], size), size)
            pos[:live] += size
            coef[b, 0] = pred[i, c] << al
        elif not ah:
            ac_first(coef, b, pos[:live], run[:live], bits, lookup_table(tables), ss, se, al)
        else:
            ac_more(coef, b, pos[:live], run[:live], bits, lookup_table(tables), ss, se, al)


def ac_first(coef, b, pos, run, bits, table, ss, se, al) -> None:
    length, symbol = table
    n = se - ss + 1
    waiting = run > 0
    run[waiting] -= 1
    at = np.flatnonzero(~waiting)
    if not len(at):
        return
    # Whole blocks of one symbol without a run: every code's place is known.
    window = bits.peek(pos[at])
    size = symbol[window]
    stride = length[window] + size
    same = (size > 0) & (size < 16)
    if same.any():
        pick = at[same]
        width, size = stride[same][:, None], size[same][:, None]
        code = length[window[same]][:, None]
        where = pos[pick][:, None] + np.arange(n)[None, :] * width
        seen = bits.peek(where)
        good = ((symbol[seen] == size) & (length[seen] == code)).all(1)
        if good.any():
            pick, size, code = pick[good], size[good], code[good]
            value = extended(bits.take(where[good] + code, size), np.broadcast_to(size, (len(pick), n)))
            coef[b[pick], ss : se + 1] = value << al
            pos[pick] += n * width[good][:, 0]
            done = np.zeros(len(b), bool)
            done[pick] = True
            at = at[~done[at]]
    k = np.full(len(b), ss, np.int64)
    while len(at):
        window = bits.peek(pos[at])
        if (length[window] == 0).any():
            raise ValueError("a Huffman code that no table has")
        pos[at] += length[window]
        r, s = symbol[window] >> 4, symbol[window] & 15
        end = (s == 0) & (r < 15)
        e = at[end]
        run[e] = (1 << r[end]) - 1 + bits.take(pos[e], r[end])
        pos[e] += r[end]
        go, r, s = at[~end], r[~end], s[~end]
        k[go] += r
        put = s > 0
        g = go[put]
        coef[b[g], np.minimum(k[g], 63)] = extended(bits.take(pos[g], s[put]), s[put]) << al
        pos[g] += s[put]
        k[go] += 1
        at = go[k[go] <= se]


def ac_more(coef, b, pos, run, bits, table, ss, se, al) -> None:
    length, symbol = table
    n = se - ss + 1
    old = coef[b, ss : se + 1]
    k = np.zeros(len(b), np.int64)
    column = np.arange(n)[None, :]

    def correct(at: np.ndarray, upto: np.ndarray) -> None:
        """A bit for each coefficient from k up to `upto` that was not zero before this scan."""
        mine = (old[at] != 0) & (column >= k[at][:, None]) & (column < upto[:, None])
        order = np.cumsum(mine, 1) - 1
        bit = bits.peek(pos[at][:, None] + order) >> 15
        v = coef[b[at], ss : se + 1]
        coef[b[at], ss : se + 1] = v + np.where(mine & (bit == 1), np.sign(old[at]) << al, 0)
        pos[at] += mine.sum(1)

    at = np.flatnonzero(run == 0)
    while len(at):
        window = bits.peek(pos[at])
        if (length[window] == 0).any():
            raise ValueError("a Huffman code that no table has")
        pos[at] += length[window]
        r, s = symbol[window] >> 4, symbol[window] & 15
        end = (s == 0) & (r < 15)
        e = at[end]
        run[e] = (1 << r[end]) + bits.take(pos[e], r[end])
        pos[e] += r[end]
        go, r, s = at[~end], r[~end], s[~end]
        if not len(go):
            break
        sign = np.where(s > 0, np.where(bits.peek(pos[go]) >> 15, 1, -1), 0)
        pos[go] += s > 0
        empty = (old[go] == 0) & (column >= k[go][:, None])
        count = np.cumsum(empty, 1)
        target = np.where(empty & (count == (r + 1)[:, None]), column, n).min(1)
        correct(go, np.minimum(target, n))
        new = (s > 0) & (target < n)
        coef[b[go[new]], ss + target[new]] = sign[new] << al
        k[go] = target + 1
        at = go[k[go] < n]
    ends = np.flatnonzero(run > 0)
    if len(ends):
        correct(ends, np.full(len(ends), n))
        run[ends] -= 1


NEXT = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
RESTARTS = re.compile(rb"\xff[\xd0-\xd7]")


def parse(image: bytes) -> tuple[dict, list]:
    """Frame and scans: (parameters, components, tables, restart interval, segments)."""
    at, frame, tables, quant, interval, scans, comment = 2, {}, {}, {}, 0, [], b""
    if image[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    while at + 4 <= len(image):
        code = image[at + 1]
        if code == 0xFF:
            at += 1
            continue
        if code == 0xD9:
            break
        size = int.from_bytes(image[at + 2 : at + 4], "big")
        body = image[at + 4 : at + 2 + size]
        at += 2 + size
        if code == 0xC2:
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            frame = {"height": int.from_bytes(body[1:3], "big"), "width": int.from_bytes(body[3:5], "big"), "parts": parts}
        elif code in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("not a progressive JPEG image")
        elif code == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                quant[body[i] & 15] = np.frombuffer(body[i + 1 : i + 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8).astype(np.int64)
                i += 1 + 64 * (1 + wide)
        elif code == 0xC4:
            i = 0
            while i < len(body):
                n = sum(body[i + 1 : i + 17])
                tables[body[i]] = body[i + 1 : i + 17 + n]
                i += 17 + n
        elif code == 0xDD:
            interval = int.from_bytes(body, "big")
        elif code == 0xFE:
            comment = body
        elif code == 0xDA:
            n = body[0]
            which = [([p[0] for p in frame["parts"]].index(body[1 + 2 * i]), body[2 + 2 * i]) for i in range(n)]
            ss, se, a = body[1 + 2 * n : 4 + 2 * n]
            end = m.start() if (m := NEXT.search(image, at)) else len(image)
            segments = [x.replace(b"\xff\x00", b"\xff") for x in RESTARTS.split(image[at:end])]
            scans.append(((ss, se, a >> 4, a & 15), which, dict(tables), interval, segments))
            at = end
    frame |= {"quant": quant, "comment": comment}
    return frame, scans


def coefficients(images: list[bytes]) -> list[tuple[dict, list[np.ndarray]]]:
    """For each image the frame, and per component the coefficients (blocks in raster order, 64) in zigzag order."""
    jobs, groups, total = [], defaultdict(list), 0
    for image in images:
        frame, scans = parse(image)
        hmax, vmax = max(p[1] for p in frame["parts"]), max(p[2] for p in frame["parts"])
        mx, my = -(-frame["width"] // (8 * hmax)), -(-frame["height"] // (8 * vmax))
        grids = []
        for _, h, v, _ in frame["parts"]:
            grids.append((total, mx * h, my * v, -(-(-(-frame["width"] * h // hmax)) // 8), -(-(-(-frame["height"] * v // vmax)) // 8)))
            total += mx * h * my * v
        for params, which, tables, interval, segments in scans:
            if len(which) == 1:
                base, across, _, w, h = grids[which[0][0]]
                order = base + (np.arange(h)[:, None] * across + np.arange(w)[None, :]).ravel() if w != across else base + np.arange(w * h)
                comp, per = np.full(len(order), which[0][0]), 1
            else:
                parts = []
                for c, _ in which:
                    base, across, _, _, _ = grids[c]
                    _, h, v, _ = frame["parts"][c]
                    y, x, j, i = np.ix_(np.arange(my), np.arange(mx), np.arange(v), np.arange(h))
                    parts.append((base + (y * v + j) * across + x * h + i).reshape(my * mx, h * v))
                order, per = np.concatenate(parts, 1).ravel(), sum(p.shape[1] for p in parts)
                comp = np.tile(np.concatenate([np.full(p.shape[1], c) for p, (c, _) in zip(parts, which)]), my * mx)
            if params[0] == 0:
                spec = tuple(sorted((c, tables.get(t >> 4, b"")) for c, t in which)) if not params[2] else ()
            else:
                spec = tables[0x10 | (which[0][1] & 15)]
            step = interval * per if interval else len(order)
            # Scans refine what earlier ones left: of one coefficient, those with the larger bit come first. Images go together where their scans are the same.
            groups[params[2] > 0, -params[2], params, spec].extend((data, order[i * step : (i + 1) * step], comp[i * step : (i + 1) * step]) for i, data in enumerate(segments) if i * step < len(order))
        jobs.append((frame, grids))
    coef = np.zeros((total, 64), np.int32)
    for key in sorted(groups, key=lambda k: k[:3]):
        decode_streams(coef, groups[key], key[2], dict(key[3]) if key[2][0] == 0 else key[3])
    return [(frame, [coef[base : base + across * down] for base, across, down, _, _ in grids]) for frame, grids in jobs]


def rgb(frame: dict, parts: list[np.ndarray]) -> np.ndarray:
    """The image as (height, width, 3) bytes."""
    hmax, vmax = max(p[1] for p in frame["parts"]), max(p[2] for p in frame["parts"])
    planes = []
    for (_, h, v, q), coef in zip(frame["parts"], parts):
        across = -(-frame["width"] // (8 * hmax)) * h
        pixels = (coef * frame["quant"][q]).astype(np.float64) @ inverse()
        pixels = np.clip(np.floor(pixels * 2.0**-SHIFT + 128.5), 0, 255).astype(np.int32)
        plane = pixels.reshape(-1, across, 8, 8).transpose(0, 2, 1, 3).reshape(-1, across * 8)
        planes.append(plane.repeat(vmax // v, 0).repeat(hmax // h, 1)[: frame["height"], : frame["width"]])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, 2).astype(np.uint8)
    y, cb, cr = planes[0] << 16, planes[1] - 128, planes[2] - 128
    half = 1 << 15
    # 1.402, 0.344136, 0.714136 and 1.772, times 2^16.
    out = np.stack(((y + 91881 * cr + half) >> 16, (y - 22554 * cb - 46802 * cr + half) >> 16, (y + 116130 * cb + half) >> 16), 2)
    return np.clip(out, 0, 255).astype(np.uint8)


def payload_of(frame: dict, parts: list[np.ndarray]) -> bytes:
    """The bytes that encode() stored."""
    size = int(frame["comment"].removeprefix(b"payload "))
    return (np.concatenate(parts)[: size // UNIT] - 256).astype(np.uint8).tobytes()


# ---- columns


def stored_media(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A table (doc_id, n_bytes, media) under path, read again; a text's UTF-8 bytes, filled with zeros, are the payload."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw = [t or b"" for t in batch["t"].to_pylist()]
        images = encode([t + bytes(max(UNIT, -(-len(t) // UNIT) * UNIT) - len(t)) for t in raw])
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len(t) for t in raw], pa.int64()), pa.array(images, pa.binary())], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    out = arrow_map(rows, run, "doc_id long, n_bytes long, media binary")
    out.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def decoded(media: DataFrame, media_col: str = "media") -> DataFrame:
    """media with height, width and rgb, the tensor's bytes."""
    from pyspark.sql import types as T

    schema = T.StructType([*media.schema.fields, T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("rgb", T.BinaryType())])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        images = batch[media_col].to_pylist()
        some = [i for i, x in enumerate(images) if x is not None]
        tensors = dict(zip(some, (rgb(*c) for c in coefficients([images[i] for i in some]))))
        of = lambda f, kind: pa.array([f(tensors[i]) if i in tensors else None for i in range(len(images))], kind)
        columns = [of(lambda t: t.shape[0], pa.int32()), of(lambda t: t.shape[1], pa.int32()), of(lambda t: t.tobytes(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "height", "width", "rgb"])

    return arrow_map(media, run, schema)


FEATURE = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, height int, width int, rgb binary"


def features(media: DataFrame) -> DataFrame:
    """What the stored bytes give: the payload's digests, the size and mean colour (in thousandths) of the decoded tensor, and the tensor."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        images, rows = batch["media"].to_pylist(), []
        for image, (frame, parts) in zip(images, coefficients(images)):
            payload, tensor = payload_of(frame, parts), rgb(frame, parts)
            mean = tensor.reshape(-1, 3).sum(0, dtype=np.int64) * 1000 // (tensor.size // 3)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(image), hashlib.sha256(image).hexdigest(), f"{tensor.shape[0]}x{tensor.shape[1]}:{','.join(map(str, mean))}", *tensor.shape[:2], tensor.tobytes()))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=[x.split()[0] for x in FEATURE.split(", ")])

    return arrow_map(media, run, FEATURE)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of the contract; and the tensors, which are stored wherever the result is."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return features(stored_media(docs, new_path(spark, "media")))


QUERIES = {"op10_media": op10_media}
ORACLE: dict[str, str] = {}

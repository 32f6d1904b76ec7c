"""Baseline JPEG as a media column: markers, Huffman scans, DC-only luminance thumbnails.

``decode`` parses any baseline (SOF0) stream of 8-bit samples with one interleaved scan or scans of
one component each: it builds the Huffman tables, splits the scan at restart markers and decodes
all restart intervals of a batch in lockstep, one symbol of every interval a numpy step.
``write_payloads`` stores arbitrary bytes losslessly in the format's own unit, the quantised
coefficient: 192 bytes are one 4:4:4 unit (three blocks of 64 coefficients in zigzag order), a
byte's coefficient being its place in ``BYTE_ORDER`` (0, 1, -1, 2, -2, ...), quantisation 1, a
restart interval for each unit.  The number of units goes into a comment segment, as the image
rounds them up to a rectangle.

Defined cases: a null or empty text is one unit of blanks; equal texts give equal files; repeated
rows are stored each; an empty table gives no rows; columns other than doc_id and text are not
read; a file that is cut short or is not baseline raises ``ValueError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm import storage

UNIT = 192
SIDE_MOST = 8191
BATCH_UNITS = 8192
#: Fixed value: bytes in falling order of use in text; the others follow in their own order.
_COMMON = b" etanoirshldcumpgfvbwyqxkjz.,\nETANOIRSHLDCUMPGFVBWYQXKJZ0123456789-'\"()!?:;/&%$#*\xc3\xa9\xa8\xbc\xa0\xaa\xa4\xb6"
BYTE_ORDER = np.array([*_COMMON, *(b for b in range(256) if b not in _COMMON)], np.uint8)
_RANK = np.empty(256, np.int16)
_RANK[BYTE_ORDER] = np.arange(256)
TO_COEFFICIENT = np.where(_RANK % 2, (_RANK + 1) // 2, -(_RANK // 2)).astype(np.int16)

#: The zigzag order of an 8 x 8 block follows from its diagonals.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))


# ---- Huffman tables


def code_lengths(counts: np.ndarray) -> tuple[list[int], list[int]]:
    """BITS and HUFFVAL of a length-limited (16) code for symbols with these counts."""
    used = [int(s) for s in np.argsort(-counts, kind="stable") if counts[s] > 0]
    groups = [(int(counts[s]), [s]) for s in used] + [(0, [256])]  # 256 keeps the all-ones code free
    depth = dict.fromkeys([*used, 256], 0)
    while len(groups) > 1:
        groups.sort(key=lambda g: g[0])
        (a, x), (b, y) = groups[:2]
        for s in x + y:
            depth[s] += 1
        groups[:2] = [(a + b, x + y)]
    bits = [0] * 64
    for d in depth.values():
        bits[max(d, 1)] += 1
    for n in range(63, 16, -1):  # move pairs up until no code is longer than 16
        while bits[n]:
            j = n - 2
            while not bits[j]:
                j -= 1
            bits[n] -= 2
            bits[n - 1] += 1
            bits[j + 1] += 2
            bits[j] -= 1
    last = max(n for n in range(17) if bits[n])
    bits[last] -= 1
    return bits[1:17], used


def codes(bits: list[int], values: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Code and length of each symbol."""
    code, size, at, now = np.zeros(256, np.uint32), np.zeros(256, np.int64), 0, 0
    for n, count in enumerate(bits, 1):
        for s in values[at : at + count]:
            code[s], size[s] = now, n
            now += 1
        at, now = at + count, now << 1
    return code, size


def lookup(bits: list[int], values: list[int]) -> np.ndarray:
    """For every 16 bits ahead: symbol | length << 8; length 0 where no code fits."""
    table, at, now = np.zeros(1 << 16, np.int32), 0, 0
    for n, count in enumerate(bits, 1):
        for s in values[at : at + count]:
            table[now << 16 - n : now + 1 << 16 - n] = s | n << 8
            now += 1
        at, now = at + count, now << 1
    return table


# ---- encoding


def symbols(units: np.ndarray) -> tuple[np.ndarray, ...]:
    """Units (n, 192) -> for every Huffman symbol in order: unit, is_ac, symbol, extra bits, size."""
    n = len(units)
    flat = units.reshape(-1).astype(np.int32)
    k = np.arange(flat.size) & 63
    at = np.flatnonzero((flat != 0) | (k == 0))
    v, ka, block = flat[at], k[at], at >> 6
    before = np.empty_like(ka)
    before[:1], before[1:] = 0, ka[:-1]  # blocks begin with k = 0, so this stays inside a block
    run = np.where(ka, ka - before - 1, 0)
    size = _SIZE[np.abs(v)]
    extra = np.where(v < 0, v + (1 << size) - 1, v)
    last = np.empty(len(at), bool)
    last[-1:], last[:-1] = True, block[1:] != block[:-1]
    ends = last & (ka < 63)
    zrl = run >> 4
    each = 1 + zrl + ends
    start = np.cumsum(each) - each
    total = int(each.sum())
    unit, ac, sym = np.repeat(block // 3, each), np.ones(total, bool), np.full(total, 0xF0, np.int32)
    ext, sz = np.zeros(total, np.int32), np.zeros(total, np.int32)
    own = start + zrl
    ac[own], sym[own], ext[own], sz[own] = ka > 0, ((run & 15) << 4) | size, extra, size
    sym[own[ends] + 1] = 0
    assert n * 3 == (block[-1] + 1 if n else 0)
    return unit, ac, sym, ext, sz


_SIZE = np.array([int(i).bit_length() for i in range(1 << 12)], np.int32)


def scan_bytes(units: np.ndarray, dc: tuple, ac: tuple) -> list[bytes]:
    """Entropy-coded bytes of each unit: padded with ones, stuffed, no markers."""
    unit, is_ac, sym, ext, size = symbols(units)
    code = np.where(is_ac, ac[0][sym], dc[0][sym]).astype(np.int64)
    length = np.where(is_ac, ac[1][sym], dc[1][sym]) + size
    value = (code << size) | ext
    bits = np.bincount(unit, length, len(units)).astype(np.int64)
    space = (bits + 7) // 8
    begin = np.cumsum(space) - space
    ahead = np.cumsum(length) - length
    first = np.cumsum(bits) - bits
    at = ahead - first[unit] + 8 * begin[unit]
    pad = 8 * space - bits  # ones at the end
    value = np.concatenate([value, (1 << pad) - 1])
    length = np.concatenate([length, pad])
    at = np.concatenate([at, 8 * begin + bits])
    word, shift = at >> 5, 64 - (at & 31) - length
    placed = value << shift
    high, low = (placed >> 32) & 0xFFFFFFFF, placed & 0xFFFFFFFF
    total = int(space.sum())
    words = np.bincount(word, high, total // 4 + 3) + np.bincount(word + 1, low, total // 4 + 3)
    raw = words.astype(np.uint32).astype(">u4").view(np.uint8)[:total]
    ff = np.flatnonzero(raw == 255)
    raw = np.insert(raw, ff + 1, 0)
    stop = begin + space + np.searchsorted(ff, begin + space)
    blob, stop = raw.tobytes(), stop.tolist()
    return [blob[a:b] for a, b in zip([0, *stop], stop, strict=False)]


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The text's bytes with blanks up to a positive multiple of UNIT, and how many are its own."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" "), len(raw)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, bits: list[int], values: list[int]) -> bytes:
    return bytes([kind, *bits, *values])


def _fixed_tables() -> tuple:
    """The writer's DC and AC tables: codes for all symbols, lengths from a stated falling weight."""
    size_weight = [2000, 700, 1000, 1300, 1300, 600, 60, 8, 4, 2, 1, 1]
    dc = np.zeros(257)
    dc[:12] = size_weight
    ac = np.zeros(257)
    for run in range(16):
        for size in range(1, 11):
            ac[run << 4 | size] = size_weight[size] * 0.16**run if run < 4 else size_weight[size] * 0.16**4 / (1 + run)
    ac[0xF0] = ac[0] = 20
    scale = lambda w: np.where(w > 0, np.maximum(1, np.round(w * 100)), 0).astype(np.int64)
    return code_lengths(scale(dc)), code_lengths(scale(ac))


_DC, _AC = _fixed_tables()
_DC_CODES, _AC_CODES = codes(*_DC), codes(*_AC)


def write_payloads(payloads: list[bytes]) -> list[bytes]:
    """A baseline JPEG for each payload (a positive multiple of UNIT bytes)."""
    counts = [len(p) // UNIT for p in payloads]
    scans: list[bytes] = []
    whole = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, UNIT)
    for at in range(0, len(whole), BATCH_UNITS):
        scans += scan_bytes(TO_COEFFICIENT[whole[at : at + BATCH_UNITS]], _DC_CODES, _AC_CODES)
    empty = scan_bytes(np.zeros((1, UNIT), np.int16), _DC_CODES, _AC_CODES)[0]
    tables = _segment(0xC4, _table(0x00, *_DC) + _table(0x10, *_AC))
    out, at = [], 0
    for n in counts:
        wide = min(SIDE_MOST, int(np.ceil(np.sqrt(n))))
        high = -(-n // wide)
        if high > SIDE_MOST:
            raise ValueError("a payload of over 12 GB does not fit an image")
        head = b"\xff\xd8" + _segment(0xFE, b"units=%d" % n) + _segment(0xDB, bytes([0, *[1] * 64])) + _segment(0xC0, struct.pack(">BHHB", 8, 8 * high, 8 * wide, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0]))
        head += tables + _segment(0xDD, struct.pack(">H", 1)) + _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
        mine = scans[at : at + n] + [empty] * (wide * high - n)
        body = [x for i, scan in enumerate(mine) for x in (scan, _RESTART[i & 7])]
        out.append(head + b"".join(body[:-1]) + b"\xff\xd9")
        at += n
    return out


_RESTART = [bytes([0xFF, 0xD0 + i]) for i in range(8)]


# ---- decoding


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    comments: list[bytes] = field(default_factory=list)
    scans: list[tuple] = field(default_factory=list)  # (component, dc, ac)s, restart interval, bytes
    planes: list[np.ndarray] = field(default_factory=list)  # of each component: (rows, columns, 64), zigzag


def parse(data: bytes) -> Image:
    """Read the markers of one baseline stream; entropy-coded bytes stay as they are."""
    image, at, interval, tables = Image(), 2, 0, {}
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 4 > len(data) and data[at : at + 2] != b"\xff\xd9" or data[at] != 255:
            raise ValueError("the JPEG is cut short")
        marker = data[at + 1]
        if marker == 0xD9:
            if not image.scans:
                raise ValueError("no scan")
            return image
        n = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                image.quantisers[body[0] & 15] = np.frombuffer(body[1:], ">u2" if wide else "u1", 64).astype(np.int32)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                bits = list(body[1:17])
                tables[body[0]] = (tuple(bits), tuple(body[17 : 17 + sum(bits)]))
                body = body[17 + sum(bits) :]
        elif marker == 0xC0:
            _, image.height, image.width, count = struct.unpack_from(">BHHB", body)
            image.components = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * count, 3)]
        elif 0xC1 <= marker <= 0xCF and marker != 0xCC and marker != 0xC8:
            raise ValueError("not a baseline JPEG")
        elif marker == 0xFE:
            image.comments.append(body)
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            ids = [c[0] for c in image.components]
            parts = [(ids.index(body[1 + 2 * i]), tables[body[2 + 2 * i] >> 4], tables[16 | body[2 + 2 * i] & 15]) for i in range(body[0])]
            end = at
            while True:  # to the next marker that is no restart
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    raise ValueError("the JPEG is cut short")
                if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                    end += 2
                else:
                    break
            image.scans.append((parts, interval, data[at:end]))
            at = end


def _geometry(image: Image) -> tuple[int, int, int, int]:
    h, v = max(c[1] for c in image.components), max(c[2] for c in image.components)
    return h, v, -(-image.width // (8 * h)), -(-image.height // (8 * v))


def decode(files: list[bytes]) -> list[Image]:
    """Parse all files and decode their scans together, restart intervals in lockstep."""
    images = [parse(f) for f in files]
    tables: dict[tuple, int] = {}
    lanes: list[tuple] = []  # first block in the output, blocks, layout
    layouts: dict[tuple, int] = {}
    shapes: list[list[tuple]] = []
    raw: list[bytes] = []
    begin, block = 0, 0
    starts: list[int] = []
    for image in images:
        h, v, across, down = _geometry(image)
        if not image.width or not image.height:
            raise ValueError("an image without size")
        shapes.append([])
        for parts, interval, data in image.scans:
            units = across * down
            if len(parts) == 1:
                _, ch, cv, _ = image.components[parts[0][0]]
                wide, high = -(-(-(-image.width * ch // h)) // 8), -(-(-(-image.height * cv // v)) // 8)
                units, layout, kinds = wide * high, [0], [(1, 1)]
            else:
                kinds = [image.components[p[0]][1:3] for p in parts]
                layout = [i for i, (a, b) in enumerate(kinds) for _ in range(a * b)]
            own = tuple((i, tables.setdefault(parts[i][1], len(tables)), tables.setdefault(parts[i][2], len(tables))) for i in layout)
            key = layouts.setdefault(own, len(layouts))
            shapes[-1].append((parts, kinds, len(layout), units, block))
            each = interval or units
            cuts = [0]
            if interval:
                flat = np.frombuffer(data, np.uint8)
                marks = np.flatnonzero((flat[:-1] == 255) & (flat[1:] >= 0xD0) & (flat[1:] <= 0xD7))
                cuts += (marks + 2).tolist()
            pieces = [(a, (b - 2)) for a, b in zip(cuts, [*cuts[1:], len(data) + 2], strict=True)]
            if len(pieces) != -(-units // each):
                raise ValueError("restart intervals are missing")
            for i, (a, _) in enumerate(pieces):
                count = min(each, units - i * each) * len(layout)
                lanes.append((block, count, key))
                starts.append(begin + a)
                block += count
            raw.append(data)
            begin += len(data)
    coefficients = _lockstep(b"".join(raw), np.array(starts), lanes, layouts, tables, block)
    for image, scans in zip(images, shapes, strict=True):
        h, v, across, down = _geometry(image)
        planes: dict[int, np.ndarray] = {}
        for parts, kinds, per, units, first in scans:
            data = coefficients[first : first + units * per].reshape(units, per, 64)
            if len(parts) == 1:
                _, ch, cv, _ = image.components[parts[0][0]]
                planes[parts[0][0]] = data.reshape(-1, -(-(-(-image.width * ch // h)) // 8), 64)
                continue
            at = 0
            for (c, _, _), (a, b) in zip(parts, kinds, strict=True):
                part = data[:, at : at + a * b].reshape(down, across, b, a, 64)
                planes[c] = part.transpose(0, 2, 1, 3, 4).reshape(down * b, across * a, 64)
                at += a * b
        image.planes = [planes[c] for c in sorted(planes)]
    return images


def _lockstep(data: bytes, starts: np.ndarray, lanes: list, layouts: dict, tables: dict, blocks: int) -> np.ndarray:
    """Coefficients (blocks, 64) of all lanes; each step takes one symbol from every live lane."""
    flat = np.frombuffer(data, np.uint8)
    # drop stuffed zeros, so that a lane's bits are contiguous
    stuffed = np.flatnonzero((flat[:-1] == 255) & (flat[1:] == 0)) + 1 if len(flat) else np.zeros(0, np.int64)
    starts = starts - np.searchsorted(stuffed, starts)
    b = np.concatenate([np.delete(flat, stuffed), np.full(8, 255, np.uint8)]).astype(np.uint64)
    window = b[:-4] << np.uint64(32) | b[1:-3] << np.uint64(24) | b[2:-2] << np.uint64(16) | b[3:-1] << np.uint64(8) | b[4:]
    window = window.astype(np.int64)
    look = np.stack([lookup(list(t[0]), list(t[1])) for t in tables]).ravel()
    per = max(len(x) for x in layouts)
    layout = np.zeros((len(layouts), per, 3), np.int64)
    length = np.array([len(x) for x in layouts])
    for i, x in enumerate(layouts):
        layout[i, : len(x)] = x
    out = np.zeros(blocks * 64, np.int16)
    first, left, kind = (np.array(x, np.int64) for x in zip(*lanes, strict=True))
    alive = np.arange(len(lanes))
    pos, base, left = starts.astype(np.int64) * 8, first * 64, left.copy()
    place = np.zeros(len(lanes), np.int64)
    k = np.zeros(len(lanes), np.int64)
    predicted = np.zeros((len(lanes), 4), np.int64)
    limit = 8 * (len(b) - 5)
    while len(alive):
        at = layout[kind, place]
        table = np.where(k == 0, at[:, 1], at[:, 2])
        if pos.max(initial=0) >= limit:
            raise ValueError("a scan is cut short")
        ahead = window[pos >> 3] >> (8 - (pos & 7))  # 32 bits, of which the top 16 name the code
        found = look[(table << 16) + ((ahead >> 16) & 0xFFFF)]
        bits = found >> 8
        if not bits.all():
            raise ValueError("a scan holds no code")
        symbol = found & 255
        size = symbol & 15
        extra = ((ahead & 0xFFFFFFFF) >> (32 - bits - size)) & ((1 << size) - 1)
        value = np.where(extra < (1 << size) >> 1, extra - (1 << size) + 1, extra)
        pos = pos + bits + size
        dc = k == 0
        run = np.where(dc, 0, symbol >> 4)
        end = ~dc & (symbol == 0)
        if dc.any():
            lane, comp = alive[dc], at[dc, 0]
            predicted[lane, comp] += value[dc]
            value[dc] = predicted[lane, comp]
        spot = k + run
        writes = ~end & ((size > 0) | dc)
        if (spot[writes] > 63).any():
            raise ValueError("a block overflows")
        out[(base + spot)[writes]] = value[writes]
        k = np.where(end, 64, spot + 1)
        over = k >= 64
        if over.any():
            k[over] = 0
            base[over] += 64
            left[over] -= 1
            place[over] = (place[over] + 1) % length[kind[over]]
            done = left == 0
            if done.any():
                go = ~done
                alive, pos, base, left, kind, place, k = (x[go] for x in (alive, pos, base, left, kind, place, k))
    return out.reshape(-1, 64)


def payload_from(image: Image) -> bytes:
    """The bytes that ``write_payloads`` stored."""
    units = next(int(c[6:]) for c in image.comments if c.startswith(b"units="))
    y, cb, cr = (p.reshape(-1, 64)[:units] for p in image.planes)
    values = np.stack([y, cb, cr], 1).reshape(-1).astype(np.int32)
    return BYTE_ORDER[np.where(values > 0, 2 * values - 1, -2 * values)].tobytes()


def thumbnail(image: Image) -> np.ndarray:
    """DC-only luminance: a pixel for each block of the first component."""
    h, v = image.components[0][1], image.components[0][2]
    most_h, most_v, _, _ = _geometry(image)
    wide = -(-(-(-image.width * h // most_h)) // 8)
    high = -(-(-(-image.height * v // most_v)) // 8)
    quantiser = image.quantisers[image.components[0][3]][0]
    dc = image.planes[0][:high, :wide, 0].astype(np.int32) * int(quantiser)
    return np.clip(np.round(dc / 8) + 128, 0, 255).astype(np.uint8)


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits: whether each of 8 x 9 sampled pixels is darker than the one right of it."""
    rows = np.arange(8) * pixels.shape[0] // 8
    columns = np.arange(9) * pixels.shape[1] // 9
    small = pixels[rows][:, columns].astype(np.int16)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def feature(image: Image) -> str:
    """Dimensions, the thumbnail's SHA-256 and its difference hash."""
    pixels = thumbnail(image)
    return f"{image.width}x{image.height};thumb={hashlib.sha256(pixels.tobytes()).hexdigest()[:32]};dhash={difference_hash(pixels)}"


# ---- media column


def _by_size(items: list[tuple], most: int) -> Iterator[list[tuple]]:
    """Items in lists whose first members add up to ``most`` bytes or one item."""
    batch, total = [], 0
    for item in items:
        if batch and total + len(item[0]) > most:
            yield batch
            batch, total = [], 0
        batch.append(item)
        total += len(item[0])
    if batch:
        yield batch


MEDIA = "doc_id long, n_bytes long, media binary"
ROWS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def write_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the stored file of every document."""
    storage.small_batches(docs.sparkSession, 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*payload_of(t), d) for d, t in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            for some in _by_size(rows, BATCH_UNITS * UNIT):
                media = write_payloads([x[0] for x in some])
                yield pa.RecordBatch.from_arrays([pa.array([x[2] for x in some], pa.int64()), pa.array([x[1] for x in some], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, MEDIA)


def read_media(stored: DataFrame) -> DataFrame:
    """Decode every stored file: payload digests, file digests and the thumbnail feature."""
    storage.small_batches(stored.sparkSession, 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            files = [(m, d, n) for d, n, m in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            for some in _by_size(files, BATCH_UNITS * UNIT):
                out = []
                for (media, doc_id, n), image in zip(some, decode([x[0] for x in some]), strict=True):
                    payload = payload_from(image)
                    out.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(image)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [x.split()[0] for x in ROWS.split(", ")])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, ROWS)


def media_documents(docs: DataFrame) -> DataFrame:
    return read_media(storage.staged(write_media(docs), "media"))

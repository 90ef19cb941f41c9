"""Media columns: baseline JPEG of flat blocks, its Huffman decoder, and DC-only thumbnails.

A payload byte is the brightness of one 8x8 block: with a quantiser step of 8 the block's DC coefficient is the byte less 128,
and all its AC coefficients are zero, so a greyscale image keeps the payload without loss. Each row of 64 blocks is a
restart interval. Images have at most ``MAX_ROWS`` rows; a longer payload is a sequence of images.

The decoder parses the markers of any baseline file (one or three components, subsampling, any tables, with or without restarts), and decodes
the scan in lockstep: all restart intervals of all images of a batch advance one symbol at a time in numpy. The luminance DC
values are the thumbnail, an eighth of the image in each direction.

Defined results: a null or empty text is 64 zero bytes; equal texts give equal values; damaged media raise an error that names the fault; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_slice

SIDE = 64
MAX_ROWS = 8000
STEP = 8
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

#: Fixed values of the JPEG standard: the typical luminance DC table (numbers of codes by length, then categories).
DC_COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = tuple(range(12))
#: The AC table has the end-of-block symbol alone: no block has another one.
AC_COUNTS = (1, *[0] * 15)
AC_SYMBOLS = (0,)


def _codes(counts: tuple[int, ...], symbols: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), as the standard builds codes from counts."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[at]] = (code, length)
            code += 1
            at += 1
        code <<= 1
    return out


def _encoder_tables() -> tuple[np.ndarray, np.ndarray]:
    """By difference + 255: the bits of a whole flat block (DC category, DC bits, end of block) and their number."""
    dc, eob = _codes(DC_COUNTS, DC_SYMBOLS), _codes(AC_COUNTS, AC_SYMBOLS)[0]
    bits, size = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        cat = abs(d).bit_length()
        code, n = dc[cat]
        value = (code << cat) | (d if d >= 0 else d + (1 << cat) - 1)
        bits[d + 255], size[d + 255] = (value << eob[1]) | eob[0], n + cat + eob[1]
    return bits, size


_BITS, _SIZE = _encoder_tables()


def _marker(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def _head(rows: int) -> bytes:
    dht = bytes([0x00, *DC_COUNTS, *DC_SYMBOLS]) + bytes([0x10, *AC_COUNTS, *AC_SYMBOLS])
    return (
        b"\xff\xd8"
        + _marker(0xDB, bytes([0, *[STEP] * 64]))
        + _marker(0xC0, struct.pack(">BHHB3B", 8, rows * 8, SIDE * 8, 1, 1, 0x11, 0))
        + _marker(0xC4, dht)
        + _marker(0xDD, struct.pack(">H", SIDE))
        + _marker(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


def scan_bytes(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of rows of samples, each row an interval padded with ones and stuffed, and each row's length."""
    rows = samples.reshape(-1, SIDE).astype(np.int64) - 128
    diff = np.diff(rows, axis=1, prepend=0) + 255
    value, size = _BITS[diff], _SIZE[diff]
    total = size.sum(axis=1)
    n_bytes = (total + 7) >> 3
    starts = np.concatenate([[0], np.cumsum(n_bytes)])
    at = (starts[:-1] * 8)[:, None] + np.cumsum(size, axis=1) - size
    # A block's bits, at most 18, lie in four bytes from the first on.
    word = (value << (32 - (at & 7) - size).astype(np.uint64)).ravel()
    first = (at >> 3).ravel()
    out = np.zeros(int(starts[-1]) + 4, np.int64)
    for k in range(4):
        part = ((word >> np.uint64(24 - 8 * k)) & np.uint64(255)).astype(np.float64)
        out += np.bincount(first + k, weights=part, minlength=len(out)).astype(np.int64)
    out = out[: int(starts[-1])].astype(np.uint8)
    out[starts[1:] - 1] |= ((1 << (n_bytes * 8 - total)) - 1).astype(np.uint8)
    full = out == 255
    row_of = np.repeat(np.arange(len(rows)), n_bytes)
    stuffed = np.repeat(out, 1 + full)
    place = np.arange(len(out)) + np.cumsum(full)
    stuffed[place[full]] = 0
    return stuffed, n_bytes + np.bincount(row_of[full], minlength=len(rows))


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """A JPEG for each payload, whose length is a multiple of 64."""
    samples = np.frombuffer(b"".join(payloads), np.uint8)
    if not len(samples):
        return [b"" for _ in payloads]
    coded, lengths = scan_bytes(samples)
    raw, ends = coded.tobytes(), np.cumsum(lengths).tolist()
    out, row, at = [], 0, 0
    for p in payloads:
        parts = []
        for lo in range(0, len(p) // SIDE, MAX_ROWS):
            n = min(MAX_ROWS, len(p) // SIDE - lo)
            parts.append(_head(n))
            for k in range(n):
                end = ends[row]
                parts.append(raw[at:end])
                if k + 1 < n:
                    parts.append(bytes((0xFF, 0xD0 + k % 8)))
                at, row = end, row + 1
            parts.append(b"\xff\xd9")
        out.append(b"".join(parts))
    return out


class Image:
    """What the markers of one baseline image say, with its entropy-coded intervals."""

    def __init__(self) -> None:
        self.width = self.height = self.restart = 0
        self.quant: dict[int, np.ndarray] = {}
        self.tables: dict[tuple[int, int], bytes] = {}
        self.frame: list[tuple[int, int, int, int]] = []
        self.scan: list[tuple[int, int, int]] = []
        self.intervals: list[bytes] = []


def parse(media: bytes) -> list[Image]:
    """All images of a stored form, in order."""
    out, at = [], 0
    while at < len(media):
        if media[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at += 2
        image = Image()
        while True:
            if at + 2 > len(media) or media[at] != 0xFF:
                raise ValueError("a marker is missing")
            kind = media[at + 1]
            at += 2
            if kind == 0xD9:
                break
            (n,) = struct.unpack_from(">H", media, at)
            body = media[at + 2 : at + n]
            at += n
            if kind == 0xDB:
                while body:
                    wide, k = body[0] >> 4, body[0] & 15
                    image.quant[k] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int64)
                    body = body[65 + 64 * wide :]
            elif kind == 0xC4:
                while body:
                    n = sum(body[1:17])
                    image.tables[body[0] >> 4, body[0] & 15] = body[1 : 17 + n]
                    body = body[17 + n :]
            elif kind == 0xC0:
                depth, image.height, image.width, n = struct.unpack_from(">BHHB", body)
                if depth != 8:
                    raise ValueError("only samples of 8 bits are baseline")
                image.frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC1 <= kind <= 0xCF and kind != 0xC8 and kind != 0xCC:
                raise ValueError("the image is not baseline")
            elif kind == 0xDD:
                (image.restart,) = struct.unpack(">H", body)
            elif kind == 0xDA:
                image.scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                start = at
                while True:
                    at = media.find(b"\xff", at)
                    if at < 0 or at + 1 >= len(media):
                        raise ValueError("the scan has no end")
                    mark = media[at + 1]
                    if mark == 0:
                        at += 2
                    elif 0xD0 <= mark <= 0xD7:
                        image.intervals.append(media[start:at])
                        at = start = at + 2
                    else:
                        image.intervals.append(media[start:at])
                        break
        out.append(image)
    return out


_lookups: dict[bytes, np.ndarray] = {}


def _lookup(table: bytes) -> np.ndarray:
    """By the next 16 bits: symbol << 8 | length of its code; 0 where no code fits."""
    found = _lookups.get(table)
    if found is None:
        found = np.zeros(1 << 16, np.int64)
        for symbol, (code, n) in _codes(tuple(table[:16]), tuple(table[16:])).items():
            found[code << (16 - n) : (code + 1) << (16 - n)] = symbol << 8 | n
        if len(_lookups) < 64:
            _lookups[table] = found
    return found


def _layout(image: Image) -> tuple:
    """(blocks of an MCU as (component, DC table, AC table), MCUs a row, MCU rows, the luminance's h and v)."""
    named = {c[0]: c for c in image.frame}
    if not image.scan or len(image.scan) != len(image.frame):
        raise ValueError("only a single scan of all components is read")
    if len(image.frame) == 1:
        across, down = -(-image.width // 8), -(-image.height // 8)
        _, dc, ac = image.scan[0]
        return ((0, image.tables[0, dc], image.tables[1, ac]),), across, down, 1, 1
    h, v = max(c[1] for c in image.frame), max(c[2] for c in image.frame)
    blocks = []
    for k, (name, dc, ac) in enumerate(image.scan):
        blocks += [(k, image.tables[0, dc], image.tables[1, ac])] * (named[name][1] * named[name][2])
    return tuple(blocks), -(-image.width // (8 * h)), -(-image.height // (8 * v)), named[image.scan[0][0]][1], named[image.scan[0][0]][2]


def _decode_lanes(lanes: list[bytes], counts: np.ndarray, blocks: tuple) -> np.ndarray:
    """DC values of the first component, lanes x (most MCUs x its blocks); every lane is an interval of ``counts`` MCUs."""
    data = np.frombuffer(b"".join([x.replace(b"\xff\x00", b"\xff") + b"\xff\xff\xff\xff" for x in lanes]), np.uint8)
    lengths = np.array([len(x) - x.count(b"\xff\x00") + 4 for x in lanes], np.int64)
    limit = np.cumsum(lengths) * 8
    pos = limit - lengths * 8
    wide = np.concatenate([data, np.full(4, 255, np.uint8)]).astype(np.int64)
    window = wide[:-4] << 24 | wide[1:-3] << 16 | wide[2:-2] << 8 | wide[3:-1]  # 32 bits from each byte on

    def peek(p: np.ndarray, n: int) -> np.ndarray:
        return (window[p >> 3] >> (32 - n - (p & 7))) & ((1 << n) - 1)

    mine = [k for k, b in enumerate(blocks) if b[0] == 0]
    most = int(counts.max())
    out = np.zeros((most * len(mine), len(lanes)), np.int64)
    before = np.zeros((max(b[0] for b in blocks) + 1, len(lanes)), np.int64)
    luts = [(_lookup(b[1]), _lookup(b[2])) for b in blocks]
    even = bool((counts == most).all())
    row = 0
    for mcu in range(most):
        live = slice(None) if even else np.flatnonzero(counts > mcu)
        for k, (component, _, _) in enumerate(blocks):
            dc, ac = luts[k]
            p = pos[live]
            hit = dc[peek(p, 16)]
            cat = hit >> 8
            p = p + (hit & 255)
            if not (hit & 255).all():
                raise ValueError("a code is not in its table")
            v = (window[p >> 3] >> (32 - cat - (p & 7))) & ((1 << cat) - 1)
            p = p + cat
            v = np.where((cat > 0) & (v < (1 << np.maximum(cat - 1, 0))), v - (1 << cat) + 1, v)
            before[component][live] += v
            # AC symbols are only passed over: an end of block, a run of 16 zeros, or a run and a coefficient.
            left, place = np.arange(len(p)), np.ones(len(p), np.int64)
            while len(left):
                hit = ac[peek(p[left], 16)]
                if not (hit & 255).all():
                    raise ValueError("a code is not in its table")
                symbol = hit >> 8
                p[left] += (hit & 255) + (symbol & 15)
                place[left] += (symbol >> 4) + 1
                left = left[(symbol != 0) & (place[left] < 64)]
            pos[live] = p
            if component == 0:
                out[row][live] = before[0][live]
                row += 1
    if (pos > limit - 32 + 7).any():
        raise ValueError("a scan ends early")
    return out.T


def thumbnails(images: list[Image]) -> list[np.ndarray]:
    """The DC-only luminance of each image: a sample for each 8x8 block, 0 to 255."""
    by: dict[tuple, list[int]] = {}
    laid = [_layout(x) for x in images]
    for i, (blocks, *_rest) in enumerate(laid):
        by.setdefault(blocks, []).append(i)
    out: list[np.ndarray] = [np.zeros((0, 0), np.uint8)] * len(images)
    for blocks, members in by.items():
        lanes, counts = [], []
        for i in members:
            image, (_, across, down, _, _) = images[i], laid[i]
            total, each = across * down, images[i].restart or across * down
            need = [min(each, total - lo) for lo in range(0, total, each)]
            if len(image.intervals) != len(need):
                raise ValueError("a restart interval is missing")
            lanes += image.intervals
            counts += need
        values = _decode_lanes(lanes, np.array(counts), blocks)
        own, lane = sum(b[0] == 0 for b in blocks), 0
        for i in members:
            image, (_, across, down, h, v) = images[i], laid[i]
            n = len(image.intervals)
            flat = np.concatenate([values[lane + k, : counts[lane + k] * own] for k in range(n)]) if counts[lane] != counts[lane + n - 1] else values[lane : lane + n, : counts[lane] * own].ravel()
            lane += n
            grid = flat.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h) if own > 1 else flat.reshape(down, across)
            grid = grid[: -(-image.height // 8), : -(-image.width // 8)]
            step = image.quant[next(c[3] for c in image.frame if c[0] == image.scan[0][0])][0]
            out[i] = np.clip((grid * step) // 8 + 128, 0, 255).astype(np.uint8)
    return out


def difference_hash(thumb: np.ndarray) -> str:
    """64 bits: whether each of 8x8 cell means is over that of the cell to the right, on a 9-wide grid."""
    rows, cols = thumb.shape
    at_r = np.arange(8) * rows // 8
    at_c = np.arange(9) * cols // 9
    n_r = np.maximum(np.append(at_r[1:], rows) - at_r, 1)
    n_c = np.maximum(np.append(at_c[1:], cols) - at_c, 1)
    sums = np.add.reduceat(np.add.reduceat(thumb.astype(np.int64), at_r, axis=0), at_c, axis=1)
    mean = sums / (n_r[:, None] * n_c[None, :])
    return np.packbits(mean[:, :-1] > mean[:, 1:]).tobytes().hex()


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the media column."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raws = [x or b"" for x in batch.column("raw").to_pylist()]
        media = encode_many([r + bytes(-len(r) % SIDE if r else SIDE) for r in raws])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(r) for r in raws], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("raw")).mapInArrow(each_slice(run, "raw"), "doc_id long, n_bytes long, media binary")


def features(stored: DataFrame) -> DataFrame:
    """Reads the media column back: digests of the payload, dimensions and thumbnail hashes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, media = [], batch.column("media").to_pylist()
        parsed = [parse(m) for m in media]
        thumbs = iter(thumbnails([x for images in parsed for x in images]))
        for m, images in zip(media, parsed, strict=True):
            own = [next(thumbs) for _ in images]
            payload = b"".join(t.tobytes() for t in own)
            feature = ";".join(f"{x.width}x{x.height}:{difference_hash(t)}" for x, t in zip(images, own, strict=True))
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature))
        cols = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=[x.split()[0] for x in FEATURES.split(", ")])

    return stored.mapInArrow(each_slice(run, "media"), FEATURES)


def op3(docs: DataFrame) -> DataFrame:
    return features(store(docs))

"""Media columns: progressive JPEG.

The decoder accumulates spectral-selection and successive-approximation scans in coefficient arrays, transforms them
back in numpy, upsamples chroma and gives full-resolution RGB tensors. The encoder stores a payload without loss in
the format's unit, the quantised coefficient: each byte becomes one coefficient of magnitude class 8, whose eight
appended bits are the byte. That class has no zero, so every coded field has the same width, which lets whole scans
be read at once; scans of any other file go through the general bit reader.

Cases: a null text is an empty one, whose payload is 64 zero bytes; whole texts are stored; equal texts give equal
values; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from printloom.llm.common import chunks

BLOCK = 64
#: Most 16-pixel units in a row of them: the format's widths end at 65,535.
MAX_ACROSS = 4095

#: Luma and chroma component: number, sampling factors.
COMPONENTS = ((1, 2, 2), (2, 1, 1), (3, 1, 1))
#: The scans that the encoder writes: components, first and last coefficient, bit position before, bit position now.
SCANS = (((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 1), ((0,), 6, 63, 0, 1), ((1,), 1, 63, 0, 1), ((2,), 1, 63, 0, 1), ((0, 1, 2), 0, 0, 1, 0), ((0,), 1, 63, 1, 0), ((1,), 1, 63, 1, 0), ((2,), 1, 63, 1, 0))


def _zigzag() -> np.ndarray:
    """Row-major place of each coefficient in the order in which files store them."""
    return np.array([8 * y + x for y, x in sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))])


ZIGZAG = _zigzag()


def _basis() -> np.ndarray:
    """Matrix from a block's coefficients in stored order to its 64 samples."""
    c = np.array([[math.cos((2 * x + 1) * u * math.pi / 16) * (math.sqrt(1 / 8) if u == 0 else 0.5) for x in range(8)] for u in range(8)])
    return np.kron(c, c)[ZIGZAG]


BASIS = _basis()


# --- writing ---------------------------------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, number: int, codes: list[tuple[int, int]]) -> bytes:
    """A Huffman table; codes: (length, symbol) in ascending order of length."""
    counts = [sum(n == k for n, _ in codes) for k in range(1, 17)]
    return _segment(0xC4, bytes((kind << 4 | number, *counts, *(s for _, s in codes))))


#: DC differences: class 8 - k has k + 1 bits of code, so code and appended bits are nine in all.
DC_CODES = [(k + 1, 8 - k) for k in range(9)]


def _scan_head(comps: tuple[int, ...], ss: int, se: int, ah: int, al: int) -> bytes:
    return _segment(0xDA, bytes((len(comps), *(x for c in comps for x in (COMPONENTS[c][0], 0)), ss, se, ah << 4 | al)))


@lru_cache(maxsize=64)
def _scan_heads() -> tuple[bytes, ...]:
    """Before each scan, the table that it needs."""
    out = []
    for comps, ss, se, ah, al in SCANS:
        table = b"" if ss == 0 and ah else _table(0, 0, DC_CODES) if ss == 0 else _table(1, 0, [(1, 0 if ah else 7)])
        out.append(table + _scan_head(comps, ss, se, ah, al))
    return tuple(out)


_QUANT = _segment(0xDB, bytes((0, *[1] * 64)))


def _shape(blocks: int) -> tuple[int, int]:
    """Units of 16 x 16 pixels across and down that hold so many blocks, six in each."""
    units = -(-blocks // 6)
    across = min(units, MAX_ACROSS)
    return across, -(-units // across)


@lru_cache(maxsize=512)
def _interleaved(across: int, down: int) -> np.ndarray:
    """Blocks (luma in raster order, then both chroma planes) in the order of a scan of all components."""
    unit = np.arange(across * down)
    y, x = unit // across, unit % across
    luma = [(2 * y + j) * 2 * across + 2 * x + i for j in (0, 1) for i in (0, 1)]
    n = across * down
    return np.stack([*luma, 4 * n + unit, 5 * n + unit], 1).ravel()


def _stuffed(data: bytes) -> bytes:
    return data.replace(b"\xff", b"\xff\x00")


def _packed_bits(fields: np.ndarray, width: int) -> bytes:
    """Numbers as bit fields of one width, filled up with ones."""
    bits = (fields[:, None] >> np.arange(width - 1, -1, -1)) & 1
    flat = bits.astype(np.uint8).ravel()
    return np.packbits(np.concatenate([flat, np.ones(-len(flat) % 8, np.uint8)])).tobytes()


def write_payload(payload: bytes) -> bytes:
    """A progressive JPEG (YCbCr, 4:2:0) whose coefficients are the payload's bytes; its length must be a multiple of 64."""
    blocks = len(payload) // BLOCK
    across, down = _shape(blocks)
    n = across * down
    b = np.zeros((6 * n, BLOCK), np.uint8)
    b.ravel()[: len(payload)] = np.frombuffer(payload, np.uint8)
    high, low = _halves(b)
    planes = {0: slice(0, 4 * n), 1: slice(4 * n, 5 * n), 2: slice(5 * n, 6 * n)}
    order = _interleaved(across, down)
    dc = np.where(b[:, 0] >= 128, b[:, 0], b[:, 0].astype(np.int16) - 255).astype(np.int16)
    # the blocks of each component in the order of the interleaved scan, for the differences
    place = np.tile(np.array([0, 0, 0, 0, 1, 2]), n)
    head = [b"\xff\xd8", _segment(0xEC, b"payload\0" + struct.pack(">Q", len(payload))), _QUANT]
    head.append(_segment(0xC2, struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + b"".join(bytes((c, h << 4 | v, 0)) for c, h, v in COMPONENTS)))
    out = head
    for (comps, ss, se, ah, _), start in zip(SCANS, _scan_heads()):
        if ss == 0 and not ah:
            first = (dc >> 1)[order]
            diff = np.empty_like(first)
            for c in comps:
                at = np.flatnonzero(place == c)
                own = first[at]
                own[1:] -= first[at[:-1]]
                diff[at] = own
            size = _bit_length(np.abs(diff))
            appended = np.where(diff < 0, diff + (1 << size) - 1, diff)
            data = _packed_bits(((1 << (8 - size)) - 1 << (size + 1)) | appended, 9)
        elif ss == 0:
            data = _packed_bits((dc & 1)[order], 1)
        elif not ah:
            data = high[planes[comps[0]], ss : se + 1].tobytes()  # code 0 and seven bits
        else:
            data = np.packbits(low[planes[comps[0]]], axis=1).tobytes()  # end of block, then a bit a coefficient
        out += [start, _stuffed(data)]
    return b"".join([*out, b"\xff\xd9"])


def _halves(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of coefficients of class 8: the appended bits of the magnitude's upper seven bits, and its last bit (0 at the DC's place)."""
    positive = b >= 128
    magnitude = np.where(positive, b, 255 - b)
    high = magnitude >> 1
    low = magnitude & 1
    low[:, 0] = 0
    return np.where(positive, high, 127 - high), low


def _bit_length(x: np.ndarray) -> np.ndarray:
    return _LENGTHS[x]


_LENGTHS = np.array([i.bit_length() for i in range(1 << 12)], np.int64)


# --- reading ---------------------------------------------------------------------------------------------------------


class Bits:
    """Bits of a scan, most significant first; past its end they are zero."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)
        self.data, self.at, self.size = data, 0, 8 * len(data)

    def get(self, n: int) -> int:
        out = 0
        for _ in range(n):
            byte = self.data[self.at >> 3] if self.at < self.size else 0
            out = out << 1 | byte >> (7 - (self.at & 7)) & 1
            self.at += 1
        return out

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.get(1)
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("no such code")


def extended(bits: int, size: int) -> int:
    """The number whose appended bits these are."""
    return bits if size == 0 or bits >> (size - 1) else bits - (1 << size) + 1


@lru_cache(maxsize=64)
def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    out, code, at = {}, 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            out[n, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


@lru_cache(maxsize=512)
def _alone(width: int, height: int, across: int, h: int, v: int, most_h: int, most_v: int) -> tuple[np.ndarray, np.ndarray]:
    """The blocks of a component that a scan of it alone has, in order, after their components (all 0)."""
    wide = -(-(-(-width * h // most_h)) // 8)
    high = -(-(-(-height * v // most_v)) // 8)
    blocks = (np.arange(high)[:, None] * (across * h) + np.arange(wide)).ravel()
    return np.zeros(len(blocks), np.int64), blocks


@lru_cache(maxsize=512)
def _together(across: int, down: int, factors: tuple[tuple[int, int], ...]) -> tuple[np.ndarray, np.ndarray]:
    """Component and block of each block of a scan of several components, in order."""
    unit = np.arange(across * down)
    y, x = unit // across, unit % across
    which, blocks = [], []
    for k, (h, v) in enumerate(factors):
        for j in range(v):
            for i in range(h):
                which.append(np.full(len(unit), k))
                blocks.append((y * v + j) * across * h + x * h + i)
    return np.stack(which, 1).ravel(), np.stack(blocks, 1).ravel()


@lru_cache(maxsize=16)
def _by_field(width: int, table: tuple) -> np.ndarray:
    """The number that each field of a code and its appended bits stands for, where all such fields have one width."""
    out = np.zeros(1 << width, np.int64)
    for (n, code), size in table:
        for bits in range(1 << size):
            out[code << size | bits] = extended(bits, size)
    return out


@lru_cache(maxsize=16)
def _by_byte(size: int, al: int) -> np.ndarray:
    """The coefficient of each byte that holds a code and ``size`` appended bits."""
    return np.array([extended(b & ((1 << size) - 1), size) * (1 << al) for b in range(256)], np.int16)


class Image:
    """Coefficients of a progressive JPEG."""

    def __init__(self, data: bytes):
        self.payload = None
        self.quant: dict[int, np.ndarray] = {}
        self.tables: dict[tuple[int, int], dict] = {}
        self.restart = 0
        at = 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("no JPEG")
        while True:
            if data[at] != 0xFF:
                raise ValueError("no marker")
            marker = data[at + 1]
            if marker == 0xD9:
                break
            if marker == 0xFF:
                at += 1
                continue
            end = at + 2 + struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : end]
            at = end
            if marker == 0xDB:
                self._quants(body)
            elif marker == 0xC4:
                self._huffman(body)
            elif marker == 0xC2:
                self._frame(body)
            elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
                raise ValueError("not a progressive, Huffman-coded JPEG")
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xEC and body[:8] == b"payload\0":
                self.payload = struct.unpack(">Q", body[8:16])[0]
            elif marker == 0xDA:
                at = self._scan(body, data, at)

    def _quants(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, number = body[at] >> 4, body[at] & 15
            self.quant[number] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, at + 1).astype(np.float64)
            at += 1 + 64 * (1 + bool(wide))

    def _huffman(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            counts = body[at + 1 : at + 17]
            n = sum(counts)
            self.tables[body[at] >> 4, body[at] & 15] = _codes(counts, body[at + 17 : at + 17 + n])
            at += 17 + n

    def _frame(self, body: bytes) -> None:
        self.height, self.width, n = struct.unpack_from(">HHB", body, 1)
        self.ids = [body[6 + 3 * i] for i in range(n)]
        self.factors = [(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15) for i in range(n)]
        self.quant_of = [body[8 + 3 * i] for i in range(n)]
        self.h, self.v = max(h for h, _ in self.factors), max(v for _, v in self.factors)
        self.across, self.down = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        self.coefs = [np.zeros((self.down * v * self.across * h, BLOCK), np.int16) for h, v in self.factors]

    def _scan(self, body: bytes, data: bytes, at: int) -> int:
        comps = [self.ids.index(body[1 + 2 * i]) for i in range(body[0])]
        tables = [(body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
        ss, se, both = body[1 + 2 * body[0] :][:3]
        ah, al = both >> 4, both & 15
        parts = []
        while True:  # up to a marker that ends the scan; at restarts it continues
            end = at
            while True:
                end = data.index(b"\xff", end)
                if data[end + 1] == 0:
                    end += 2
                    continue
                break
            parts.append(data[at:end].replace(b"\xff\x00", b"\xff"))
            if not 0xD0 <= data[end + 1] <= 0xD7:
                break
            at = end + 2
        if len(comps) == 1:
            which, blocks = _alone(self.width, self.height, self.across, *self.factors[comps[0]], self.h, self.v)
            per = 1
        else:
            which, blocks = _together(self.across, self.down, tuple(self.factors[c] for c in comps))
            per = sum(h * v for h, v in (self.factors[c] for c in comps))
        step = self.restart * per or len(blocks)
        for k, part in enumerate(parts):
            w, b = which[k * step : (k + 1) * step], blocks[k * step : (k + 1) * step]
            if ss == 0:
                self._dc(part, comps, tables, w, b, ah, al)
            else:
                table = self.tables[1, tables[0][1]]
                (self._ac_refine if ah else self._ac_first)(part, self.coefs[comps[0]], table, b, ss, se, al)
        return end

    def _dc(self, part: bytes, comps: list[int], tables: list, which: np.ndarray, blocks: np.ndarray, ah: int, al: int) -> None:
        if ah:
            bit = np.unpackbits(np.frombuffer(part, np.uint8), count=len(blocks)).astype(np.int16) << al
            for k, c in enumerate(comps):
                own = np.flatnonzero(which == k) if len(comps) > 1 else slice(None)
                self.coefs[c][blocks[own], 0] |= bit[own]
            return
        own = [self.tables[0, d] for d, _ in tables]
        width = {n + s for t in own for (n, _), s in t.items()}
        if len(width) == 1 and max(width) <= 9 and all(t is own[0] for t in own):
            bits = max(width)
            start = np.arange(len(blocks)) * bits
            raw = np.frombuffer(part + b"\0", np.uint8).astype(np.int64)
            diff = _by_field(bits, tuple(own[0].items()))[((raw[start >> 3] << 8 | raw[(start >> 3) + 1]) >> (16 - bits - (start & 7))) & ((1 << bits) - 1)]
        else:
            bits = Bits(part)
            diff = np.array([extended(bits.get(s), s) for s in (bits.symbol(own[k]) for k in which.tolist())], np.int64)
        for k, c in enumerate(comps):
            own = np.flatnonzero(which == k)
            self.coefs[c][blocks[own], 0] = np.cumsum(diff[own]) << al

    def _ac_first(self, part: bytes, coefs: np.ndarray, table: dict, blocks: np.ndarray, ss: int, se: int, al: int) -> None:
        (first, symbol), *more = table.items()
        if not more and symbol >> 4 == 0 and first[0] + (symbol & 15) == 8:  # one coefficient a byte
            v = _by_byte(symbol & 15, al)[np.frombuffer(part, np.uint8, len(blocks) * (se - ss + 1)).reshape(len(blocks), -1)]
            if len(blocks) == len(coefs):
                coefs[:, ss : se + 1] = v
            else:
                coefs[blocks, ss : se + 1] = v
            return
        bits, run = Bits(part), 0
        for b in blocks.tolist():
            k = ss
            if run:
                run -= 1
                continue
            while k <= se:
                s = bits.symbol(table)
                zeros, size = s >> 4, s & 15
                if size:
                    k += zeros
                    coefs[b, k] = extended(bits.get(size), size) * (1 << al)
                    k += 1
                elif zeros == 15:
                    k += 16
                else:
                    run = (1 << zeros) - 1 + bits.get(zeros)
                    break

    def _ac_refine(self, part: bytes, coefs: np.ndarray, table: dict, blocks: np.ndarray, ss: int, se: int, al: int) -> None:
        one = np.int16(1 << al)
        (first, symbol), *more = table.items()
        band = se - ss + 1
        own = coefs if len(blocks) == len(coefs) else coefs[blocks]
        if not more and symbol == 0 and own[:, ss : se + 1].all():  # each block: its end, then a bit a coefficient
            bits = np.unpackbits(np.frombuffer(part, np.uint8), count=len(blocks) * (first[0] + band)).reshape(len(blocks), -1)[:, first[0] :]
            old = own[:, ss : se + 1]
            sign = old >> 15
            new = old + ((bits.astype(np.int16) << al ^ sign) - sign)
            if own is coefs:
                coefs[:, ss : se + 1] = new
            else:
                coefs[blocks, ss : se + 1] = new
            return
        bits, run = Bits(part), 0

        def correct(b: int, k: int) -> None:
            if bits.get(1) and not abs(int(coefs[b, k])) & int(one):
                coefs[b, k] += one if coefs[b, k] > 0 else -one

        for b in blocks.tolist():
            k = ss
            while not run and k <= se:
                s = bits.symbol(table)
                zeros, size = s >> 4, s & 15
                if not size and zeros < 15:
                    run = (1 << zeros) + bits.get(zeros)
                    break
                value = (one if bits.get(1) else -one) if size else 0
                while k <= se:
                    if coefs[b, k]:
                        correct(b, k)
                    elif zeros:
                        zeros -= 1
                    else:
                        break
                    k += 1
                if value and k <= se:
                    coefs[b, k] = value
                k += 1
            if run:
                for k in range(k, se + 1):
                    if coefs[b, k]:
                        correct(b, k)
                run -= 1

    def plane(self, c: int) -> np.ndarray:
        """Samples of a component at its own resolution, 0 to 255."""
        h, v = self.factors[c]
        q = self.quant[self.quant_of[c]]
        flat = self.coefs[c].astype(np.float64) @ (BASIS if (q == 1).all() else q[:, None] * BASIS)
        flat += 128.5
        samples = np.clip(flat, 0, 255.5, out=flat).astype(np.uint8)
        rows, cols = self.down * v, self.across * h
        return samples.reshape(rows, cols, 8, 8).swapaxes(1, 2).reshape(8 * rows, 8 * cols)

    def rgb(self) -> np.ndarray:
        """Height x width x 3 of 8 bits; chroma is repeated up to full resolution."""
        full = []
        for c, (h, v) in enumerate(self.factors):
            p = self.plane(c)
            full.append(p if (h, v) == (self.h, self.v) else p.repeat(self.v // v, 0).repeat(self.h // h, 1))
        full = [p[: self.height, : self.width] for p in full]
        if len(full) == 1:
            return np.repeat(full[0][:, :, None], 3, 2)
        y, cb, cr = full[0].astype(np.float32), full[1], full[2]
        out = np.empty((self.height, self.width, 3), np.uint8)
        for i, colour in enumerate((y + _RED[cr], y + _GREEN_B[cb] + _GREEN_R[cr], y + _BLUE[cb])):
            colour += np.float32(0.5)
            out[:, :, i] = np.clip(colour, 0, 255.5, out=colour)
        return out

    def stored(self) -> bytes:
        """The payload, if :func:`write_payload` made the file."""
        v = np.concatenate(self.coefs).ravel()[: self.payload]
        if (np.abs(v) < 128).any() or (np.abs(v) > 255).any():
            raise ValueError("a coefficient holds no byte")
        return np.where(v > 0, v, v + 255).astype(np.uint8).tobytes()


_SHIFTED = np.arange(256, dtype=np.float32) - 128
_RED, _BLUE = np.float32(1.402) * _SHIFTED, np.float32(1.772) * _SHIFTED
_GREEN_R, _GREEN_B = np.float32(-0.714136) * _SHIFTED, np.float32(-0.344136) * _SHIFTED


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK))


def feature(rgb: np.ndarray) -> str:
    """Size, mean of each channel and digest of a tensor."""
    h, w, _ = rgb.shape
    means = rgb.reshape(-1, 3).sum(0, dtype=np.int64) * 1000 // (h * w)
    return f"{w}x{h}:{','.join(map(str, means.tolist()))}:{hashlib.sha256(rgb.tobytes()).hexdigest()[:16]}"


# --- columns ---------------------------------------------------------------------------------------------------------


def store_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, media (the JPEG that holds the text's bytes, padded with zeros) and n_bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in chunks(batches, "k", "t"):
            raw = [(t or "").encode() for t in texts]
            yield pa.record_batch({"k": pa.array(keys), "media": pa.array([write_payload(padded(r)) for r in raw], pa.binary()), "n_bytes": pa.array(map(len, raw), pa.int64())})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, media binary, n_bytes long").withColumnRenamed("k", key)


def decode_media(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """Key, height, width and rgb (the tensor's bytes, row by row) of each image; null for null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, files in chunks(batches, "k", "m"):
            full = [None if f is None else Image(f).rgb() for f in files]
            shape = [(None, None) if x is None else x.shape[:2] for x in full]
            yield pa.record_batch({"k": pa.array(keys), "height": pa.array([s[0] for s in shape], pa.int32()), "width": pa.array([s[1] for s in shape], pa.int32()), "rgb": pa.array([None if x is None else x.tobytes() for x in full], pa.binary())})

    kind = media.schema[key].dataType.simpleString()
    return media.select(F.col(key).alias("k"), F.col(column).alias("m")).mapInArrow(run, f"k {kind}, height int, width int, rgb binary").withColumnRenamed("k", key)


def digest_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store each text, read the stored bytes back and describe both; no media leaves the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in chunks(batches, "k", "t"):
            rows = []
            for t in texts:
                raw = (t or "").encode()
                media = write_payload(padded(raw))
                image = Image(media)
                back = image.stored()
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature(image.rgb())))
            yield pa.record_batch([pa.array(keys), *(pa.array(c, pa.string() if isinstance(c[0], str) else pa.int64()) for c in map(list, zip(*rows)))], names=["k", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return out.withColumnRenamed("k", key)

"""Lossless WebP (VP8L): a full decoder, an encoder, and media columns.

The decoder handles simple and normal prefix codes, meta prefix codes, LZ77
back-references with the two-dimensional distance map, the colour cache, and
all four transforms (predictor, cross-colour, subtract-green, colour indexing),
in plain and extended files. ``decode_many`` advances the main images of many
files together (see ``webp_batch``); images with groups of codes go pixel by
pixel, and codes of one length without copies as a whole.

``store`` writes a payload as images of 64 samples a row and up to 64 rows, one
after the other, each with a palette, a colour cache, back-references and its
own prefix codes; ``load`` reads the bytes back. A sample is a pixel's green
channel. Predictors and cross-colour suit pictures, not text, so ``store``
leaves them out; ``encode`` writes any mixture of the format's tools.
``pixel_arrays`` decodes a column of image bytes to pixels.

Defined results: a null or empty text is one block of 64 zero bytes; a text of
any length is stored whole; equal texts give equal values; rows sharing an id
or repeated stay separate rows, and a null id stays null; null image bytes give
null images, and bytes that are no lossless WebP an error in their row; extra
columns are ignored, and kept by ``pixel_arrays``; an empty table gives an empty
table.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphquarry.llm import webp_batch as W
from graphquarry.llm.common import unused

# Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
DISTANCE_MAP = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
CACHE_HASH = 0x1E35A7BD
#: Bytes of payloads coded together, about.
PART_BYTES = 1_000_000
#: Bytes of media decoded together, about.
DECODED_BYTES = 4_000_000


class CorruptImage(ValueError):
    """The bytes are no lossless WebP image."""


# --- reading -----------------------------------------------------------------


class _Bits:
    """A stream, and the prefix codes that have been met so far by their lengths."""

    def __init__(self, data: bytes, codes: dict | None = None):
        self.data, self.at, self.end = data, 0, 8 * len(data)
        self.codes = {} if codes is None else codes

    def code(self, lengths: bytes) -> "_Code":
        got = self.codes.get(lengths)
        if got is None:
            if len(self.codes) > 2000:
                self.codes.clear()
            got = self.codes[lengths] = _Code(np.frombuffer(lengths, np.uint8).astype(np.int64))
        return got

    def read(self, n: int) -> int:
        at = self.at
        if at + n > self.end:
            raise CorruptImage("the stream ends early")
        self.at = at + n
        return (int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7)) & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        at = self.at
        return (int.from_bytes(self.data[at >> 3 : (at >> 3) + 3], "little") >> (at & 7)) & ((1 << n) - 1)


class _Code:
    """A prefix code by its lengths; ``fixed`` is the length that all symbols share."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.single = int(used[0]) if len(used) == 1 else None
        self.fixed = 0 if len(used) == 1 else int(lengths[used[0]]) if len(used) and (lengths[used] == lengths[used[0]]).all() else None
        self.symbols = used
        self.lengths = lengths
        self._table: list | None = None
        if len(used) == 0:
            raise CorruptImage("a prefix code has no symbol")
        if self.single is None and int((1 << (15 - lengths[used].astype(np.int64))).sum()) != 1 << 15:
            raise CorruptImage("a prefix code is not complete")

    def table(self) -> list:
        """By the next bits, as many as the longest code has: (symbol << 4) | length."""
        if self._table is None:
            self.longest = 0 if self.single is not None else int(self.lengths.max())
            self._table = W.tables_of(self.lengths.astype(np.uint8)[None, :])[0][0].tolist()
        return self._table

    def read(self, bits: _Bits) -> int:
        if self.single is not None:
            return self.single
        table = self.table()
        got = table[bits.peek(self.longest)]
        bits.at += got & 15
        if bits.at > bits.end:
            raise CorruptImage("the stream ends early")
        return got >> 4


def _read_code(bits: _Bits, alphabet: int) -> _Code:
    if bits.at + 4 <= bits.end and bits.peek(4) == 1:  # the simple code of symbol 0 alone
        bits.at += 4
        return bits.code(b"\1" + bytes(alphabet - 1))
    if bits.read(1):
        many, wide = bits.read(1) + 1, bits.read(1)
        symbols = [bits.read(8 if wide else 1)] + ([bits.read(8)] if many == 2 else [])
        if max(symbols) >= alphabet:
            raise CorruptImage("a symbol is out of range")
        simple = bytearray(alphabet)
        for s in symbols:
            simple[s] = 1
        return bits.code(bytes(simple))
    first = bytearray(19)
    n = 4 + bits.read(4)
    three = bits.read(3 * n)
    for i in range(n):
        first[LENGTH_ORDER[i]] = three >> 3 * i & 7
    code = bits.code(bytes(first))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    table, mask = code.table(), (1 << code.longest) - 1
    # the stream's next part as one number; a length takes 14 bits at most
    start = bits.at
    ahead = int.from_bytes(bits.data[start >> 3 : (start + 14 * alphabet + 7 >> 3) + 1], "little") >> (start & 7)
    spent, previous = 0, 8
    lengths = bytearray()
    while len(lengths) < alphabet and left > 0:
        left -= 1
        got = table[ahead >> spent & mask]
        spent += got & 15
        s = got >> 4
        if s < 16:
            lengths.append(s)
            previous = s or previous
        else:
            extra, least = ((2, 3), (3, 3), (7, 11))[s - 16]
            lengths += bytes([previous if s == 16 else 0]) * (least + (ahead >> spent & ((1 << extra) - 1)))
            spent += extra
    bits.at += spent
    if bits.at > bits.end:
        raise CorruptImage("the stream ends early")
    if len(lengths) > alphabet:
        raise CorruptImage("code lengths run over")
    return bits.code(bytes(lengths.ljust(alphabet, b"\0")))


def _prefixed(bits: _Bits, symbol: int) -> int:
    """The number that a length or distance symbol and its extra bits stand for."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _read_image(bits: _Bits, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise CorruptImage("the colour cache is too large")
    meta, meta_bits, groups = None, 0, 1
    if main and bits.read(1):
        meta_bits = bits.read(3) + 2
        step = 1 << meta_bits
        meta = (_read_image(bits, -(-width // step), -(-height // step), False) >> 8) & 0xFFFF
        groups = int(meta.max()) + 1
    size = 1 << cache_bits if cache_bits else 0
    codes = [[_read_code(bits, n) for n in (280 + size, 256, 256, 256, 40)] for _ in range(groups)]
    total = width * height
    g, r, b, a, _ = codes[0]
    if groups == 1 and not size and all(c.fixed is not None for c in (g, r, b, a)) and g.symbols[-1] < 256:
        return _read_fixed(bits, (g, r, b, a), total).reshape(height, width)
    out: list[int] = [0] * total
    cache = [0] * size
    shift = 32 - cache_bits
    at = kept = 0
    while at < total:
        own = codes[int(meta[(at // width) >> meta_bits, (at % width) >> meta_bits])] if meta is not None else codes[0]
        s = own[0].read(bits)
        if s < 256:
            red, blue, alpha = own[1].read(bits), own[2].read(bits), own[3].read(bits)
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 280:
            n = _prefixed(bits, s - 256)
            d = _prefixed(bits, own[4].read(bits))
            if d <= 120:
                dx, dy = DISTANCE_MAP[d - 1]
                d = max(1, dx + dy * width)
            else:
                d -= 120
            if d > at or at + n > total:
                raise CorruptImage("a back-reference leaves the image")
            for i in range(at, at + n):
                out[i] = out[i - d]
            at += n
        else:
            while kept < at:
                cache[((CACHE_HASH * out[kept]) & 0xFFFFFFFF) >> shift] = out[kept]
                kept += 1
            out[at] = cache[s - 280]
            at += 1
        if size:
            while kept < at:
                cache[((CACHE_HASH * out[kept]) & 0xFFFFFFFF) >> shift] = out[kept]
                kept += 1
    return np.array(out, np.uint32).reshape(height, width)


def _read_fixed(bits: _Bits, codes, total: int) -> np.ndarray:
    """Pixels of a stream of literals whose codes have one length each."""
    each = sum(c.fixed for c in codes)
    if bits.at + each * total > bits.end:
        raise CorruptImage("the stream ends early")
    raw = np.frombuffer(bits.data, np.uint8)[bits.at >> 3 : (bits.at + each * total + 7) >> 3]
    rows = np.unpackbits(raw, bitorder="little")[bits.at & 7 :][: each * total].reshape(total, each)
    bits.at += each * total
    out, lo = [], 0
    for c in codes:
        value = np.zeros(total, np.uint16)
        for j in range(lo, lo + c.fixed):
            value = (value << 1) | rows[:, j]
        lo += c.fixed
        out.append(c.symbols[value].astype(np.uint32))
    g, r, b, a = out
    return a << np.uint32(24) | r << np.uint32(16) | g << np.uint32(8) | b


def _split(x: np.ndarray) -> np.ndarray:
    """Pixels as int channels (..., 4) in the order blue, green, red, alpha."""
    return np.ascontiguousarray(x, "<u4").view(np.uint8).reshape(*x.shape, 4).astype(np.int64)


def _join(c: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray((c & 255).astype(np.uint8)).view("<u4").reshape(c.shape[:-1])


def _predict(mode: int, left: list[int], top: list[int], tl: list[int], tr: list[int]) -> list[int]:
    def avg(p, q):
        return [(x + y) // 2 for x, y in zip(p, q)]

    if mode in (0, 14, 15):
        return [0, 0, 0, 255]
    if mode <= 4:
        return (left, top, tr, tl)[mode - 1]
    if mode <= 9:
        return (avg(avg(left, tr), top), avg(left, tl), avg(left, top), avg(tl, top), avg(top, tr))[mode - 5]
    if mode == 10:
        return avg(avg(left, tl), avg(top, tr))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, tl))  # |p - left| with p = left + top - tl
        to_top = sum(abs(p - c) for p, c in zip(left, tl))
        return left if to_left < to_top else top
    if mode == 12:
        return [min(255, max(0, p + t - c)) for p, t, c in zip(left, top, tl)]
    return [min(255, max(0, m + int((m - c) / 2))) for m, c in zip(avg(left, top), tl)]


def _predictions(x: list[list[list[int]]], modes: np.ndarray, size_bits: int, width: int, row: int, col: int) -> list[int]:
    if row == 0:
        return [0, 0, 0, 255] if col == 0 else x[0][col - 1]
    if col == 0:
        return x[row - 1][0]
    tr = x[row - 1][col + 1] if col + 1 < width else x[row][0]
    return _predict(int(modes[row >> size_bits, col >> size_bits]), x[row][col - 1], x[row - 1][col], x[row - 1][col - 1], tr)


def _unpredict(pixels: np.ndarray, modes: np.ndarray, size_bits: int) -> np.ndarray:
    x = _split(pixels).tolist()
    height, width = pixels.shape
    for row in range(height):
        for col in range(width):
            p = _predictions(x, modes, size_bits, width, row, col)
            x[row][col] = [(u + v) & 255 for u, v in zip(x[row][col], p)]
    return _join(np.array(x))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8).view(np.int8).astype(np.int64)


def _cross(pixels: np.ndarray, elements: np.ndarray, size_bits: int, sign: int) -> np.ndarray:
    """Add (1) or take away (-1) what green and red say about red and blue."""
    rows, cols = np.indices(pixels.shape)
    e = _split(elements)[rows >> size_bits, cols >> size_bits]
    c = _split(pixels)
    green = _signed(c[..., 1])

    def delta(t, colour):
        return (_signed(t) * colour) >> 5

    red_before = c[..., 2].copy()
    c[..., 2] += sign * delta(e[..., 0], green)
    red = _signed((c[..., 2] if sign > 0 else red_before) & 255)
    c[..., 0] += sign * (delta(e[..., 1], green) + delta(e[..., 2], red))
    return _join(c)


def _packing(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _unpalette(pixels: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    shift = _packing(len(palette))
    index = (pixels >> np.uint32(8)) & np.uint32(255)
    if shift:
        each, per = 8 >> shift, 1 << shift
        index = np.stack([(index >> np.uint32(each * i)) & np.uint32((1 << each) - 1) for i in range(per)], axis=2).reshape(len(pixels), -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(palette)] = palette
    return full[index]


def _chunk(data: bytes) -> bytes:
    """The body of a RIFF file's VP8L chunk."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise CorruptImage("no WebP file")
    at, end = 12, min(len(data), 8 + int.from_bytes(data[4:8], "little"))
    while at + 8 <= end:
        n = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"VP8L":
            return data[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise CorruptImage("no lossless image")


def _opened(data: bytes) -> tuple[np.ndarray, list]:
    """The main image, and the transforms to undo."""
    bits = _Bits(_chunk(data))
    if bits.read(8) != 0x2F:
        raise CorruptImage("no VP8L signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise CorruptImage("unknown version")
    undo, coded = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (u[0] for u in undo):
            raise CorruptImage("a transform is repeated")
        if kind in (PREDICTOR, CROSS_COLOUR):
            n = bits.read(3) + 2
            undo.append((kind, _read_image(bits, (coded + (1 << n) - 1) >> n, (height + (1 << n) - 1) >> n, False), n))
        elif kind == PALETTE:
            size = bits.read(8) + 1
            deltas = _split(_read_image(bits, size, 1, False))[0]
            undo.append((kind, _join(np.cumsum(deltas, axis=0)), coded))
            coded = (coded + (1 << _packing(size)) - 1) >> _packing(size)
        else:
            undo.append((kind, None, None))
    return _read_image(bits, coded, height, True), undo


def _undone(x: np.ndarray, undo: list) -> np.ndarray:
    for kind, what, n in reversed(undo):
        if kind == PREDICTOR:
            x = _unpredict(x, (what >> 8) & 15, n)
        elif kind == CROSS_COLOUR:
            x = _cross(x, what, n, 1)
        elif kind == SUBTRACT_GREEN:
            c = _split(x)
            c[..., 0] += c[..., 1]
            c[..., 2] += c[..., 1]
            x = _join(c)
        else:
            x = _unpalette(x, what, n)
    return x


def decode(data: bytes) -> np.ndarray:
    """Pixels (height, width) as 0xAARRGGBB of one lossless file, pixel by pixel."""
    return _undone(*_opened(data))


_DX, _DY = (np.array(c, np.int64) for c in zip(*DISTANCE_MAP))


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """Pixels of many lossless files.

    Those of one group of codes and at most a palette advance together; any
    other, and any that seems broken, is decoded by itself, which also says
    what is wrong with it.
    """
    if not files:
        return []
    bodies = [_chunk(data) for data in files]
    streams = W.Streams(bodies)
    who = np.arange(len(files))
    alone = np.array([len(b) < 8 for b in bodies])

    def codes(some: np.ndarray, cache: np.ndarray) -> list[np.ndarray]:
        out = []
        for n in (280 + np.where(cache > 0, 1 << cache, 0), *(np.full(len(some), k) for k in (256, 256, 256, 40))):
            lengths, bad = W.read_codes(streams, some, n, LENGTH_ORDER)
            alone[some[bad]] = True
            out.append(lengths)
        return out

    alone |= streams.read(who, 8) != 0x2F
    width, height = streams.read(who, 14) + 1, streams.read(who, 14) + 1
    alone |= streams.read(who, 4) >> 1 != 0
    alone |= width * height > 1 << 22  # large ones don't gain by it
    coded, palettes = width.copy(), {}
    more = streams.read(who, 1) == 1
    indexed = who[more & ~alone]
    if len(indexed):
        alone[indexed] |= streams.read(indexed, 2) != PALETTE
        indexed = indexed[~alone[indexed]]
        size = streams.read(indexed, 8) + 1
        alone[indexed] |= streams.read(indexed, 1) != 0  # a cache
        keep = ~alone[indexed]
        indexed, size = indexed[keep], size[keep]
        if len(indexed):
            read = codes(indexed, np.zeros(len(indexed), np.int64))
            shades, bad = W.decode_images(streams, W.Images(indexed, read, np.zeros(len(indexed), np.int64), size, np.ones(len(indexed), np.int64)), _DX, _DY, CACHE_HASH)
            alone[indexed[bad]] = True
            for i, x in zip(indexed.tolist(), shades):
                palettes[i] = _join(np.cumsum(_split(x[0]), axis=0))
            packed = np.select([size <= 2, size <= 4, size <= 16], [3, 2, 1], 0)
            coded[indexed] = (width[indexed] + (1 << packed) - 1) >> packed
            left = indexed[~alone[indexed]]
            alone[left] |= streams.read(left, 1) != 0  # more transforms
    together = who[~alone]
    cache = np.zeros(len(files), np.int64)
    if len(together):
        cached = together[streams.read(together, 1) == 1]
        if len(cached):
            cache[cached] = streams.read(cached, 4)
            alone[cached] |= (cache[cached] < 1) | (cache[cached] > 11)
        together = who[~alone]
        alone[together] |= streams.read(together, 1) != 0  # groups of codes
        together = who[~alone]
    out: list = [None] * len(files)
    if len(together):
        read = codes(together, cache[together])
        longest = [int(c.max(initial=0)) for c in read]
        if sum(longest[:4]) > 57 or longest[0] + longest[4] > 29:  # what a pixel takes doesn't fit the window
            alone[together] = True
        good = ~alone[together]
        together, read = together[good], [c[good] for c in read]
    if len(together):
        pixels, bad = W.decode_images(streams, W.Images(together, read, cache[together], coded[together], height[together]), _DX, _DY, CACHE_HASH)
        for i, x, broken in zip(together.tolist(), pixels, bad.tolist()):
            if not broken:
                out[i] = _unpalette(x, palettes[i], int(width[i])) if i in palettes else x
    return [decode(data) if x is None else x for data, x in zip(files, out)]


# --- writing -----------------------------------------------------------------


class _Out:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def _code_lengths(counts: np.ndarray, limit: int = 15) -> np.ndarray:
    """Huffman code lengths, at most ``limit``; rarer symbols are levelled until they fit."""
    counts = counts.astype(np.int64)
    while True:
        heap = [(int(c), int(s), (int(s),)) for s, c in enumerate(counts) if c]
        lengths = np.zeros(len(counts), np.int64)
        heapq.heapify(heap)
        if len(heap) == 1:
            lengths[heap[0][1]] = 1
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            lengths[list(a[2] + b[2])] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if lengths.max(initial=0) <= limit:
            return lengths
        counts = np.where(counts > 0, (counts + 1) // 2 + 1, 0)


def _codes(lengths: np.ndarray) -> list[tuple[int, int]]:
    """(bits as they stand in the stream, how many) of each symbol."""
    out, code = [(0, 0)] * len(lengths), 0
    if np.count_nonzero(lengths) == 1:
        return out
    for n in range(1, 16):
        code <<= 1
        for s in np.flatnonzero(lengths == n):
            out[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
            code += 1
    return out


def _write_lengths(out: _Out, lengths: np.ndarray) -> None:
    """A prefix code's header, as the normal form (the simple one for a single byte)."""
    used = np.flatnonzero(lengths)
    if len(used) <= 1 and (len(used) == 0 or used[0] < 256):
        out.put(0b101, 3)  # simple, one symbol, eight bits
        out.put(int(used[0]) if len(used) else 0, 8)
        return
    edges = [0, *(np.flatnonzero(np.diff(lengths)) + 1).tolist(), len(lengths)]
    tokens: list[tuple[int, int, int]] = []
    for lo, hi in zip(edges, edges[1:]):
        v, n = int(lengths[lo]), hi - lo
        if v and n:
            tokens.append((v, 0, 0))
            n -= 1
        while n:
            if v and n >= 3:
                k = min(n, 6)
                tokens.append((16, k - 3, 2))
            elif not v and n >= 11:
                k = min(n, 138)
                tokens.append((18, k - 11, 7))
            elif not v and n >= 3:
                k = min(n, 10)
                tokens.append((17, k - 3, 3))
            else:
                k = 1
                tokens.append((v, 0, 0))
            n -= k
    while tokens and tokens[-1][0] in (0, 17, 18):
        tokens.pop()
    counts = np.zeros(19, np.int64)
    np.add.at(counts, [t[0] for t in tokens], 1)
    if np.count_nonzero(counts) == 1:
        counts[0 if counts[0] == 0 else 1] = 1
    first = _code_lengths(counts, 7)
    codes = _codes(first)
    out.put(0, 1)
    out.put(15, 4)
    for s in LENGTH_ORDER:
        out.put(int(first[s]), 3)
    out.put(1, 1)
    out.put(5, 3)
    out.put(len(tokens) - 2, 12)
    for s, extra, n in tokens:
        out.put(*codes[s])
        out.put(extra, n)


def _number(value: int) -> tuple[int, int, int]:
    """Symbol, extra bits and their number for a length or distance."""
    value -= 1
    if value < 4:
        return value, 0, 0
    extra = value.bit_length() - 2
    return 2 * (extra + 1) + ((value >> extra) & 1), value & ((1 << extra) - 1), extra


def _write_image(out: _Out, pixels: np.ndarray, main: bool, cache_bits: int = 0, copies: bool = False, meta_bits: int = 0) -> None:
    """An entropy-coded image with Huffman codes; optional cache, copies and meta codes."""
    height, width = pixels.shape
    flat = pixels.reshape(-1).tolist()
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    block = np.zeros(pixels.shape, np.int64)
    if main:
        out.put(1 if meta_bits else 0, 1)
        if meta_bits:  # two groups, alternating
            step = 1 << meta_bits
            r, c = np.indices((-(-height // step), -(-width // step)))
            groups = (r + c) % 2
            out.put(meta_bits - 2, 3)
            _write_image(out, (groups << 8).astype(np.uint32), False)
            rr, cc = np.indices(pixels.shape)
            block = groups[rr >> meta_bits, cc >> meta_bits]
    block = block.reshape(-1).tolist()
    near = {max(1, dx + dy * width): i + 1 for i, (dx, dy) in reversed(list(enumerate(DISTANCE_MAP)))}
    size = 1 << cache_bits if cache_bits else 0
    cache, seen, tokens, at = [None] * size, {}, [], 0
    while at < len(flat):
        n = 0
        if copies and at >= 1:
            start = seen.get(tuple(flat[at : at + 3]))
            if start is not None:
                while at + n < len(flat) and n < 4096 and flat[start + n] == flat[at + n]:
                    n += 1
        key = ((CACHE_HASH * flat[at]) & 0xFFFFFFFF) >> (32 - cache_bits) if size else 0
        if n >= 3:
            tokens.append((at, "copy", n, at - start))
        elif size and cache[key] == flat[at]:
            tokens.append((at, "cache", key, 0))
            n = 1
        else:
            tokens.append((at, "pixel", flat[at], 0))
            n = 1
        for i in range(at, at + n):
            seen[tuple(flat[i : i + 3])] = i
            if size:
                cache[((CACHE_HASH * flat[i]) & 0xFFFFFFFF) >> (32 - cache_bits)] = flat[i]
        at += n

    def symbols(kind, value, d):
        if kind == "pixel":
            return [(0, value >> 8 & 255, 0, 0), (1, value >> 16 & 255, 0, 0), (2, value & 255, 0, 0), (3, value >> 24, 0, 0)]
        if kind == "cache":
            return [(0, 280 + value, 0, 0)]
        s, e, n = _number(value)
        code = near.get(d, d + 120)
        t, f, m = _number(code)
        return [(0, 256 + s, e, n), (4, t, f, m)]

    n_groups = max(block) + 1
    counts = [[np.zeros(k, np.int64) for k in (280 + size, 256, 256, 256, 40)] for _ in range(n_groups)]
    listed = [(block[t[0]], symbols(*t[1:])) for t in tokens]
    for g, parts in listed:
        for which, s, _, _ in parts:
            counts[g][which][s] += 1
    codes = []
    for group in counts:
        lengths = [_code_lengths(c) for c in group]
        for i, x in enumerate(lengths):  # a single symbol that the simple form can't hold gets a partner
            if np.count_nonzero(x) == 1 and np.flatnonzero(x)[0] >= 256:
                x[0] = 1
            _write_lengths(out, x)
        codes.append([_codes(x) for x in lengths])
    for g, parts in listed:
        for which, s, e, n in parts:
            out.put(*codes[g][which][s])
            out.put(e, n)


def _riff(out_value: int, n_bits: int) -> bytes:
    return _wrap(out_value.to_bytes((n_bits + 7) // 8, "little"))


def _wrap(body: bytes) -> bytes:
    pad = b"\0" * (len(body) & 1)
    return b"RIFF" + (12 + len(body) + len(pad)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body + pad


def _head(width: int, height: int) -> _Out:
    out = _Out()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(1, 4)  # alpha is used, version 0
    return out


def encode(pixels: np.ndarray, transforms: tuple[int, ...] = (), cache_bits: int = 0, copies: bool = True, meta_bits: int = 0, size_bits: int = 3) -> bytes:
    """One file with any of the format's tools; transforms in the order applied."""
    x = np.ascontiguousarray(pixels, np.uint32)
    height, width = x.shape
    out = _head(width, height)
    for kind in transforms:
        out.put(1, 1)
        out.put(kind, 2)
        h, w = x.shape
        blocks = (-(-h // (1 << size_bits)), -(-w // (1 << size_bits)))
        if kind == PREDICTOR:
            out.put(size_bits - 2, 3)
            modes = (np.arange(blocks[0] * blocks[1]) % 14).reshape(blocks)
            _write_image(out, (modes << 8).astype(np.uint32), False)
            c = _split(x).tolist()
            x = _join(np.array([[[(u - v) & 255 for u, v in zip(c[i][j], _predictions(c, modes, size_bits, w, i, j))] for j in range(w)] for i in range(h)]))
        elif kind == CROSS_COLOUR:
            out.put(size_bits - 2, 3)
            n = np.arange(blocks[0] * blocks[1]).reshape(blocks)
            e = ((n * 37 % 256) | (n * 91 % 256) << 8 | (n * 53 % 256) << 16 | 255 << 24).astype(np.uint32)
            _write_image(out, e, False)
            x = _cross(x, e, size_bits, -1)
        elif kind == SUBTRACT_GREEN:
            c = _split(x)
            c[..., 0] -= c[..., 1]
            c[..., 2] -= c[..., 1]
            x = _join(c)
        else:
            palette, index = np.unique(x, return_inverse=True)
            if len(palette) > 256:
                raise ValueError("more than 256 colours")
            out.put(len(palette) - 1, 8)
            c = _split(palette)
            _write_image(out, _join(np.diff(c, axis=0, prepend=np.zeros((1, 4), np.int64)))[None, :], False)
            shift, index = _packing(len(palette)), index.reshape(x.shape)
            per, each = 1 << shift, 8 >> shift
            index = np.pad(index, ((0, 0), (0, -w % per))).reshape(h, -1, per)
            x = ((index << (np.arange(per) * each)).sum(2) << 8 | 255 << 24).astype(np.uint32)
    out.put(0, 1)
    _write_image(out, x, True, cache_bits, copies, meta_bits)
    return _riff(out.value, out.n)


def _palette_head() -> tuple[int, int]:
    """Head of a palette's image: no cache, green bytes of eight bits, nothing else."""
    out = _Out()
    out.put(0, 1)
    green = np.zeros(280, np.int64)
    green[:256] = 8
    _write_lengths(out, green)
    for _ in range(4):
        out.put(1, 4)
    return out.value, out.n


def store_many(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of 64 bytes) as images one after the other."""
    tile = W.TILE_ROWS * W.WIDTH
    near = {max(1, dx + dy * W.WIDTH): i + 1 for i, (dx, dy) in reversed(list(enumerate(DISTANCE_MAP)))}
    head = _palette_head()
    out: list[bytes] = []
    some: list[bytes] = []

    def flush():
        sizes = [min(tile, len(p) - lo) for p in some for lo in range(0, len(p), tile)]
        buffer, begin = W.encode_tiles(np.frombuffer(b"".join(some), np.uint8), np.array(sizes), LENGTH_ORDER, near, CACHE_HASH, head)
        first = np.cumsum([0, *(-(-len(p) // tile) for p in some)])
        data = buffer.tobytes()
        out.extend(data[begin[lo] : begin[hi]] for lo, hi in zip(first, first[1:]))
        some.clear()

    held = 0
    for p in payloads:
        if len(p) > PART_BYTES:  # a very long one by itself, in parts, as it doesn't depend on others
            if some:
                flush()
            whole = []
            step = PART_BYTES // tile * tile
            for lo in range(0, len(p), step):
                some.append(p[lo : lo + step])
                flush()
                whole.append(out.pop())
            out.append(b"".join(whole))
            held = 0
            continue
        some.append(p)
        held += len(p)
        if held >= PART_BYTES:
            flush()
            held = 0
    if some:
        flush()
    return out


def store(payload: bytes) -> bytes:
    return store_many([payload])[0]


def files_of(media: bytes) -> list[bytes]:
    """The files that stand one after the other."""
    out, at = [], 0
    while at < len(media):
        n = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append(media[at : at + n])
        at += n
    return out


def load_many(medias: list[bytes]) -> list[tuple[bytes, str]]:
    """Each payload, and features of its samples."""
    split = [files_of(m) for m in medias]
    out: list[tuple[bytes, str]] = []
    files: list[bytes] = []
    owners: list[int] = []
    parts: list[list[bytes]] = [[] for _ in medias]
    held = 0

    def flush():
        for i, x in zip(owners, decode_many(files)):
            parts[i].append((x >> np.uint32(8)).astype(np.uint8).tobytes())
        files.clear()
        owners.clear()

    for i, own in enumerate(split):
        for data in own:
            files.append(data)
            owners.append(i)
            held += len(data)
            if held >= DECODED_BYTES:
                flush()
                held = 0
    flush()
    for p in parts:
        whole = b"".join(p)
        out.append((whole, features_of(whole)))
    return out


def load(media: bytes) -> tuple[bytes, str]:
    return load_many([media])[0]


def features_of(payload: bytes) -> str:
    """Size, mean, spread and entropy of the samples, and which of 16 bands of rows are lighter."""
    raw = np.frombuffer(payload, np.uint8)
    counts = np.bincount(raw, minlength=256)
    n = len(raw)
    values = np.arange(256)
    mean = float(counts @ values) / n
    spread = float(np.sqrt(max(0.0, counts @ (values - mean) ** 2 / n)))
    p = counts[counts > 0] / n
    entropy = float(-(p * np.log2(p)).sum()) + 0.0
    light = raw.reshape(-1, W.WIDTH).sum(1)
    bands = np.add.reduceat(light, np.arange(16) * len(light) // 16) if len(light) >= 16 else np.resize(light, 16)
    ranked = np.sort(bands)
    code = int.from_bytes(np.packbits(2 * bands.astype(np.int64) > int(ranked[7]) + int(ranked[8])).tobytes(), "big")
    return f"{W.WIDTH}x{len(light)};mean={mean:.4f};std={spread:.4f};entropy={entropy:.4f};bands={code:04x}"


def _parts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of batches whose values (texts or bytes) take about twice DECODED_BYTES."""
    for b in batches:
        sizes = np.cumsum([len(x) if x is not None else 0 for x in (v.as_buffer() if v.is_valid else None for v in b.column(column))])
        lo = 0
        while lo < b.num_rows:
            before = sizes[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(sizes, before + 2 * DECODED_BYTES, side="right")))
            part = b.slice(lo, hi - lo)
            yield part, part.column(column).to_pylist()
            lo = hi


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id and media: the lossless image bytes of every whole text."""

    def run(batches):
        for part, texts in _parts(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(store_many([payload_of(t) for t in texts]), pa.binary())], names=["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, media binary")


def pixel_arrays(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``images`` and ``error`` for a column of lossless WebP bytes.

    A value holds one file, or several one after the other; each becomes
    (width, height, pixels), the pixels as bytes blue, green, red, alpha, row
    by row. Columns of those names get an underscore.
    """
    names = {c: c for c in df.columns}
    for new in ("images", "error"):
        for c in names:
            if names[c].lower() == new:
                names[c] = unused(f"{c}_", [*names.values(), "images", "error"])
    kept = df.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    at = df.columns.index(column)
    image = "array<struct<width:int,height:int,pixels:binary>>"
    kind = pa.list_(pa.struct([("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary())]))

    def read(media):
        if media is None:
            return None, None
        try:
            return [{"width": x.shape[1], "height": x.shape[0], "pixels": np.ascontiguousarray(x, "<u4").tobytes()} for x in decode_many(files_of(media))], None
        except CorruptImage as e:
            return None, str(e)

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):  # an image may be far larger than its file
                images, error = read(b.column(at)[i].as_py())
                yield pa.RecordBatch.from_arrays([*b.slice(i, 1).columns, pa.array([images], kind), pa.array([error], pa.string())], names=[*b.schema.names, "images", "error"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{fields}, images {image}, error string")


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def digests(docs: DataFrame) -> DataFrame:
    """Each text stored as media, read back, and digested; see the module."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for part, texts in _parts(batches, 1):
            payloads = [payload_of(t) for t in texts]
            medias = store_many(payloads)
            rows = []
            for doc_id, text, media, (back, feature) in zip(part.column(0).to_pylist(), texts, medias, load_many(medias)):
                n = len((text or "").encode("utf-8", "surrogatepass"))
                rows.append((doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")

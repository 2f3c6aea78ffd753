"""Many small lossless WebP images at once: a Huffman, copy, cache and palette coder in numpy.

``encode_tiles`` writes bytes as images of WIDTH pixels a row, one sample (the
green channel) a pixel, each with a palette of the bytes that it holds (if they
are more than 16, as fewer would be packed), copies of what the image held
before, a colour cache, and prefix codes of its own. Every step works on all
images together: matches come from one sort of four-byte windows, the greedy
parse advances all images by a token at a time, code lengths are Shannon's,
shortened until the code is complete, and bits are laid down by their offsets.

``read_codes`` reads the prefix codes of many streams a symbol at a time, and
``decode_images`` any images with one group of codes a pixel at a time: an image
either reads a symbol or goes on with a copy.
"""

from __future__ import annotations

import numpy as np

WIDTH = 64
#: Rows of one image at most; longer payloads become several.
TILE_ROWS = 64
CACHE_BITS = 2
LIMIT = 13
LITERALS, LENGTHS = 256, 24
GREENS = LITERALS + LENGTHS + (1 << CACHE_BITS)

_LOW3 = np.array([int(f"{i:0{LIMIT}b}"[::-1], 2) for i in range(1 << LIMIT)], np.uint32)


def reversal(n: int) -> np.ndarray:
    """Indices 0 to 2^n - 1 with their n bits turned round."""
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate([2 * out, 2 * out + 1])
    return out


def prefixed(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, extra bits and their number for lengths or distances (from 1)."""
    v = value.astype(np.int64) - 1
    top = np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 1  # of the highest bit
    extra = np.where(v < 4, 0, top - 1)
    symbol = np.where(v < 4, v, 2 * (extra + 1) + ((v >> extra) & 1))
    return symbol, np.where(v < 4, 0, v & ((1 << extra) - 1)), extra


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of complete prefix codes, one for each row of counts with two used symbols or more.

    A row's counts sum to at most 2^LIMIT, so no length goes over LIMIT.
    """
    total = counts.sum(1, keepdims=True)
    with np.errstate(divide="ignore"):
        lengths = np.where(counts > 0, np.maximum(1, np.ceil(np.log2(total / np.maximum(counts, 1)) - 1e-12)), 0).astype(np.int64)
    room = np.where(lengths > 0, 1 << (LIMIT - lengths), 0)
    slack = (1 << LIMIT) - room.sum(1)
    used = int((counts > 0).sum(1).max(initial=0))
    order = np.argsort(-counts, axis=1, kind="stable")[:, :used]
    ordered = np.take_along_axis(lengths, order, 1).T.copy()
    while (slack > 0).any():
        for row in ordered:  # the more frequent symbols first
            gain = np.where(row > 1, 1 << (LIMIT - np.maximum(row, 1)), 1 << 40)
            ok = gain <= slack
            row -= ok
            slack -= np.where(ok, gain, 0)
    np.put_along_axis(lengths, order, ordered.T, 1)
    return lengths


def code_bits(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes of each row, as they stand in the stream."""
    n = lengths.shape[1]
    rank = np.argsort(np.where(lengths > 0, lengths, 99) * n + np.arange(n), axis=1)
    room = np.where(lengths > 0, 1 << (LIMIT - lengths), 0)
    ordered = np.take_along_axis(room, rank, 1)
    first = np.cumsum(ordered, axis=1) - ordered
    out = np.empty_like(lengths)
    np.put_along_axis(out, rank, first, 1)
    return np.where(lengths > 0, _LOW3[np.minimum(out, (1 << LIMIT) - 1)], 0).astype(np.uint32)


def _matches(raw: np.ndarray, tile: np.ndarray, place: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance to the last place in the image with the same four bytes (0: none), and for how long all agrees."""
    n = len(raw)
    padded = raw.tobytes() + bytes(16)
    key = np.ndarray((n,), "<u4", padded, strides=(1,)).astype(np.uint64)
    key <<= np.uint64(12)
    key |= place.astype(np.uint64)
    key |= tile.astype(np.uint64) << np.uint64(44)
    key.sort()
    off = (key & np.uint64(4095)).astype(np.int32)
    key >>= np.uint64(12)
    same = np.flatnonzero(key[1:] == key[:-1]) + 1
    p = (end - np.diff(end, prepend=0))[(key[same] >> np.uint64(32)).view(np.int64)] + off[same]
    del key
    d = off[same] - off[same - 1]
    near = end[tile[p]] - p >= 4  # windows that reach into the next image are none
    distance, length = np.zeros(n, np.int32), np.ones(n, np.int32)
    distance[p[near]] = d[near]
    # neighbours of one distance are one match, so only the first of them is followed to its end
    p = np.flatnonzero(distance)
    if not len(p):
        return distance, length
    d = distance[p].astype(np.int64)
    leads = np.concatenate([[True], (d[1:] != d[:-1]) | (np.diff(p) != 1)])
    first, back = p[leads], d[leads]
    window = np.ndarray((n + 8,), "<u8", padded, strides=(1,))
    got, room = np.full(len(first), 4, np.int64), end[tile[first]] - first
    going = np.flatnonzero(room > 4)
    while len(going):
        q = first[going] + got[going]
        x = window[q] ^ window[q - back[going]]
        equal = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> np.uint8(3)).astype(np.int64)
        got[going] += equal
        going = going[(equal == 8) & (got[going] < room[going])]
    stop = first + np.minimum(got, room)
    length[p] = stop[np.cumsum(leads) - 1] - p
    return distance, length


class _Fields:
    """Values with numbers of bits, in rows of one image each."""

    def __init__(self, images: int):
        self.images, self.values, self.bits = images, [], []

    def put(self, value, bits) -> None:
        self.values.append(np.broadcast_to(np.asarray(value, np.uint32), (self.images,))[:, None])
        self.bits.append(np.broadcast_to(np.asarray(bits, np.int64), (self.images,))[:, None])

    def put_many(self, values: np.ndarray, bits: np.ndarray) -> None:
        self.values.append(values.astype(np.uint32))
        self.bits.append(np.broadcast_to(bits, values.shape).astype(np.int64))

    def constant(self, value: int, n: int, where=True) -> None:
        for lo in range(0, n, 24):
            k = min(24, n - lo)
            self.put(value >> lo & ((1 << k) - 1), np.where(where, k, 0))

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(self.values, 1), np.concatenate(self.bits, 1)


def _lay(out: np.ndarray, value: np.ndarray, bits: np.ndarray, at: np.ndarray) -> None:
    """Put values of up to 24 bits at bit offsets that nothing else uses."""
    some = np.flatnonzero(bits)
    value, at = value[some].astype(np.uint32) << (at[some] & 7).astype(np.uint32), at[some] >> 3
    for lane in range(4):
        byte = (value >> np.uint32(8 * lane)).astype(np.uint8)
        np.add.at(out, at + lane, byte)


# The code of code lengths, always the same: 0 to 13, 17 and 18 in four bits each.
_LENGTH_SYMBOLS = (*range(14), 17, 18)
_LENGTH_CODE = {s: int(f"{i:04b}"[::-1], 2) for i, s in enumerate(_LENGTH_SYMBOLS)}
_PLAIN = np.array([_LENGTH_CODE[i] for i in range(14)], np.uint32)


def length_header(order: tuple[int, ...]) -> tuple[int, int]:
    """Bits that open a normal code whose lengths are written with that code."""
    last = max(i for i, s in enumerate(order) if s in _LENGTH_SYMBOLS)
    value, n = (last + 1 - 4) << 1, 5
    for s in order[: last + 1]:
        value |= (4 if s in _LENGTH_SYMBOLS else 0) << n
        n += 3
    return value, n + 1  # no maximal symbol


def encode_tiles(raw: np.ndarray, sizes: np.ndarray, order: tuple[int, ...], near: dict[int, int], cache_hash: int, palette_head: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with all files, and where each begins and the last ends.

    ``sizes`` are the images' bytes, multiples of WIDTH. ``palette_head`` is the
    head of an image whose green code has all bytes in eight bits.
    """
    images, sizes = len(sizes), np.asarray(sizes, np.int64)
    end = np.cumsum(sizes)
    start = end - sizes
    tile = np.repeat(np.arange(images, dtype=np.int32), sizes)
    place = np.arange(len(raw), dtype=np.int32) - np.repeat(start.astype(np.int32), sizes)
    flat = (tile << 8) + raw
    used = np.bincount(flat, minlength=256 * images).reshape(images, 256) > 0
    colours = used.sum(1)
    indexed = colours > 16
    index = np.where(indexed[:, None], np.cumsum(used, 1) - 1, np.arange(256)).astype(np.uint8)
    value = index.reshape(-1)[flat]
    del flat
    distance, length = _matches(raw, tile, place, end)
    del place

    mark = np.zeros(len(raw), bool)
    at, stop = start.copy(), end.copy()
    while len(at):
        mark[at] = True
        at = at + length[at]
        left = at < stop
        if not left.all():
            at, stop = at[left], stop[left]
    at = np.flatnonzero(mark)
    own, v, n, d = tile[at], value[at].astype(np.int64), length[at], distance[at]
    copy = n > 1

    keys = ((cache_hash * (np.arange(256, dtype=np.uint64) << np.uint64(8)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - CACHE_BITS)).astype(np.uint8)
    hit, key = np.zeros(len(raw), bool), keys[value]
    for k in range(1 << CACHE_BITS):
        where = np.flatnonzero(key == k)
        what, whose = value[where], tile[where]
        hit[where[1:][(what[1:] == what[:-1]) & (whose[1:] == whose[:-1])]] = True
    cached = hit[at] & ~copy
    symbol, extra, extra_bits = prefixed(n)
    green = np.where(copy, LITERALS + symbol, np.where(cached, LITERALS + LENGTHS + keys[v].astype(np.int64), v))
    codes = np.arange(TILE_ROWS * WIDTH + 1) + 120
    for dist, code in near.items():
        if dist < len(codes):
            codes[dist] = code
    far, far_extra, far_bits = prefixed(codes[d[copy]])

    greens = np.bincount(own * GREENS + green, minlength=GREENS * images).reshape(images, GREENS)
    alone = np.flatnonzero((greens > 0).sum(1) == 1)
    greens[alone, np.where(greens[alone, 0] > 0, 1, 0)] = 1
    fars = np.bincount(own[copy] * 40 + far, minlength=40 * images).reshape(images, 40)
    copies = fars.sum(1) > 0
    alone = np.flatnonzero((fars > 0).sum(1) <= 1)
    fars[alone, np.where(fars[alone, 0] > 0, 1, 0)] += 1
    fars[~copies, :2] = 1
    green_len, far_len = code_lengths(greens), code_lengths(fars)
    green_code, far_code = code_bits(green_len), code_bits(far_len)

    f = _Fields(images)
    f.put(0x2F | (WIDTH - 1) << 8, 22)
    f.put(sizes // WIDTH - 1 | 1 << 14, 18)  # alpha is used, version 0
    f.put(1 | 3 << 1, np.where(indexed, 3, 0))
    f.put(colours - 1, np.where(indexed, 8, 0))
    f.constant(*palette_head, where=indexed)
    shades = np.sort(np.where(used, np.arange(256), 999), axis=1)
    shift = np.array([int(f"{i:08b}"[::-1], 2) for i in range(256)], np.uint32)
    widest = int(np.where(indexed, colours, 1).max())
    present = (np.arange(widest) < colours[:, None]) & indexed[:, None]
    f.put_many(np.where(present, shift[np.diff(shades[:, :widest], axis=1, prepend=0) & 255], 0), np.where(present, 8, 0))
    f.put(1 << 1 | CACHE_BITS << 2, 7)  # no more transforms, a cache, no groups of codes
    head = length_header(order)
    f.constant(*head)
    top = np.where(indexed, colours, 256 - np.argmax(used[:, ::-1], axis=1))  # of the bytes as they are written
    top = np.maximum(top, 2)  # a symbol without use may have been given to code 0 or 1
    literal = np.arange(int(top.max())) < top[:, None]
    f.put_many(np.where(literal, _PLAIN[green_len[:, : literal.shape[1]]], 0), np.where(literal, 4, 0))
    zeros = 256 - top
    for run in (np.where(zeros > 138, zeros // 2, zeros), np.where(zeros > 138, zeros - zeros // 2, 0)):
        short, long = (run >= 3) & (run < 11), run >= 11
        f.put(np.where(long, _LENGTH_CODE[18] | (run - 11) << 4, np.where(short, _LENGTH_CODE[17] | (run - 3) << 4, 0)), np.where(long, 11, np.where(short, 7, 4 * run)))
    f.put_many(_PLAIN[green_len[:, 256:]], np.array(4))
    f.put(0x111, 12)  # red, blue and alpha are 0
    f.put(1, np.where(copies, 0, 4))
    f.constant(*head, where=copies)
    f.put_many(_PLAIN[far_len[:, :26]], np.where(copies, 4, 0)[:, None])
    f.put(_LENGTH_CODE[18] | 3 << 4, np.where(copies, 11, 0))  # 14 zeros
    head_values, head_bits = f.done()

    values, bits = np.zeros(2 * len(at), np.uint32), np.zeros(2 * len(at), np.int64)
    values[0::2], bits[0::2] = green_code[own, green], green_len[own, green]
    values[0::2] |= np.where(copy, extra, 0).astype(np.uint32) << bits[0::2].astype(np.uint32)
    bits[0::2] += np.where(copy, extra_bits, 0)
    second = 2 * np.flatnonzero(copy) + 1
    values[second], bits[second] = far_code[own[copy], far], far_len[own[copy], far]
    values[second] |= far_extra.astype(np.uint32) << bits[second].astype(np.uint32)
    bits[second] += far_bits

    head_total = head_bits.sum(1)
    whole = np.concatenate([[0], np.cumsum(bits)])
    first = np.searchsorted(own, np.arange(images))  # every image has a token
    last = np.append(first[1:], len(at))
    body = (head_total + whole[2 * last] - whole[2 * first] + 7) // 8
    files = 20 + body + (body & 1)
    begin = np.concatenate([[0], np.cumsum(files)])
    out = np.zeros(begin[-1] + 8, np.uint8)
    riff = np.zeros((images, 20), np.uint8)
    riff[:, :4], riff[:, 8:16] = np.frombuffer(b"RIFF", np.uint8), np.frombuffer(b"WEBPVP8L", np.uint8)
    riff[:, 4:8] = (files - 8).astype("<u4").view(np.uint8).reshape(-1, 4)
    riff[:, 16:20] = body.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[begin[:-1, None] + np.arange(20)] = riff
    base = 8 * (begin[:-1] + 20)
    offsets = base[:, None] + np.cumsum(head_bits, 1) - head_bits
    _lay(out, head_values.reshape(-1), head_bits.reshape(-1), offsets.reshape(-1))
    offsets = np.repeat(base + head_total - whole[2 * first], 2 * (last - first)) + whole[:-1]
    _lay(out, values, bits, offsets)
    return out, begin


_EXTRA = np.array([max(0, (s - 2) >> 1) for s in range(40)], np.uint64)
_BASE = np.array([s + 1 if s < 4 else ((2 + (s & 1)) << ((s - 2) >> 1)) + 1 for s in range(40)], np.int64)


class Streams:
    """Many streams in one buffer, and where each is read next."""

    def __init__(self, parts: list[bytes], spare: int = 4096):
        # room for what broken streams may read past their end
        self.data = b"".join(parts) + bytes(spare)
        self.window = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))
        ends = np.cumsum([0, *map(len, parts)]).astype(np.uint64) * np.uint64(8)
        self.at, self.end = ends[:-1].copy(), ends[1:]

    def peek(self, who: np.ndarray) -> np.ndarray:
        """The next 57 bits at least."""
        pos = self.at[who]
        return self.window[np.minimum((pos >> 3).view(np.int64), len(self.window) - 1)] >> (pos & 7)

    def read(self, who: np.ndarray, n: int) -> np.ndarray:
        out = (self.peek(who) & np.uint64((1 << n) - 1)).view(np.int64)
        self.at[who] += np.uint64(n)
        return out


def tables_of(lengths: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """Tables by the next bits, (symbol << 4) | length; how many bits; which rows are no complete code."""
    many, n = lengths.shape
    used = lengths > 0
    alone = used.sum(1) == 1
    longest = 0 if alone.all() else int(lengths[~alone].max())
    room = np.where(used, 1 << np.maximum(0, longest - lengths.astype(np.int64)), 0)
    room[alone] = np.where(used[alone], 1 << longest, 0)
    bad = room.sum(1) != 1 << longest
    if bad.any():
        room[bad] = 0
        room[bad, 0] = 1 << longest
    rank = np.argsort(np.where(used, lengths, 99).astype(np.int64) * n + np.arange(n), axis=1)
    entry = (np.arange(n) << 4 | np.where(alone[:, None], 0, lengths)).astype(np.uint16)
    spread = np.repeat(np.take_along_axis(entry, rank, 1).reshape(-1), np.take_along_axis(room, rank, 1).reshape(-1))
    return spread.reshape(many, 1 << longest)[:, reversal(longest)], longest, bad


def read_codes(streams: Streams, who: np.ndarray, alphabet: np.ndarray, order: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the next code of some streams, and which of them are broken."""
    widest = int(alphabet.max())
    lengths = np.zeros((len(who), widest), np.uint8)
    bad = np.zeros(len(who), bool)
    bits = streams.peek(who)
    simple = np.flatnonzero(bits & np.uint64(1))
    if len(simple):
        b = bits[simple].view(np.int64)
        two, wide = b >> 1 & 1, b >> 2 & 1
        first = np.where(wide, b >> 3 & 255, b >> 3 & 1)
        n = 3 + np.where(wide, 8, 1)
        second = np.where(two, b >> n & 255, first)
        bad[simple] = np.maximum(first, second) >= alphabet[simple]
        lengths[simple, np.minimum(first, widest - 1)] = 1
        lengths[simple, np.minimum(second, widest - 1)] = 1
        streams.at[who[simple]] += (n + 8 * two).astype(np.uint64)
    own = np.flatnonzero((bits & np.uint64(1)) == 0)
    if not len(own):
        return lengths, bad
    w = who[own]
    n = 4 + (bits[own] >> np.uint64(1) & np.uint64(15)).view(np.int64)
    streams.at[w] += np.uint64(5)
    three = streams.peek(w)
    first = np.zeros((len(own), 19), np.uint8)
    for i, symbol in enumerate(order):
        first[:, symbol] = np.where(i < n, (three >> np.uint64(3 * i) & np.uint64(7)).view(np.int64), 0)
    streams.at[w] += (3 * n).astype(np.uint64)
    limit = streams.peek(w).view(np.int64)
    some = limit & 1
    extra = 2 + 2 * (limit >> 1 & 7)
    left = np.where(some, 2 + (limit >> 4 & ((1 << extra) - 1)), alphabet[own])
    streams.at[w] += np.where(some, 4 + extra, 1).astype(np.uint64)
    table, longest, broken = tables_of(first)
    bad[own] |= broken
    flat, mask, base = table.reshape(-1), np.uint64((1 << longest) - 1), np.arange(len(own)) << longest
    pos, previous, end = np.zeros(len(own), np.int64), np.full(len(own), 8, np.uint8), alphabet[own]
    going = np.flatnonzero(~bad[own])
    while len(going):
        b = streams.peek(w[going])
        got = flat[base[going] + (b & mask).view(np.int64)]
        n, symbol = (got & 15).astype(np.uint64), got >> 4
        if (symbol < 16).all():
            lengths[own[going], pos[going]] = symbol
            previous[going] = np.where(symbol > 0, symbol, previous[going])
            pos[going] += 1
            streams.at[w[going]] += n
        else:
            run = symbol >= 16
            kind = np.where(run, symbol - 16, 0)
            extra = np.array([2, 3, 7], np.uint64)[kind]
            count = np.where(run, np.array([3, 3, 11])[kind] + (b >> n & ((np.uint64(1) << extra) - np.uint64(1))).view(np.int64), 1)
            value = np.where(run, np.where(symbol == 16, previous[going], 0), symbol).astype(np.uint8)
            over = pos[going] + count > end[going]
            bad[own[going[over]]] = True
            count = np.where(over, end[going] - pos[going], count)
            row = np.repeat(own[going], count)
            ahead = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            lengths[row, np.repeat(pos[going], count) + ahead] = np.repeat(value, count)
            previous[going] = np.where(~run & (symbol > 0), symbol, previous[going])
            pos[going] += count
            streams.at[w[going]] += n + np.where(run, extra, np.uint64(0))
        left[going] -= 1
        going = going[(pos[going] < end[going]) & (left[going] > 0)]
    return lengths, bad


class Images:
    """Main parts of images: whose streams, five codes' lengths, cache and shape."""

    def __init__(self, who: np.ndarray, codes: list[np.ndarray], cache_bits: np.ndarray, width: np.ndarray, height: np.ndarray):
        self.who, self.codes, self.cache_bits, self.width, self.height = who, codes, cache_bits, width, height


def decode_images(streams: Streams, images: Images, dx: np.ndarray, dy: np.ndarray, cache_hash: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Pixels (height, width) of every image, and which are broken; the streams stand behind them then."""
    rank = np.argsort(-images.width * images.height, kind="stable")
    owner = images.who[rank]
    many = len(owner)
    width = images.width[rank]
    total = width * images.height[rank]
    steps = int(total[0])
    at, window, top = streams.at[owner], streams.window, len(streams.window) - 1
    bad = np.zeros(many, bool)
    tables, offsets, masks, plain = [], [], [], True
    rest = np.zeros(many, np.uint32)
    for c, up in zip(range(5), (8, 16, 0, 24, 0)):
        table, longest, broken = tables_of(images.codes[c][rank])
        bad |= broken
        tables.append(table.reshape(-1))
        offsets.append(np.arange(many) << longest)
        masks.append(np.uint64((1 << longest) - 1))
        if c in (1, 2, 3):
            plain &= longest == 0
            rest |= (table[:, 0] >> 4).astype(np.uint32) << np.uint32(up)
    cache_bits = images.cache_bits[rank]
    size = np.where(cache_bits > 0, 1 << cache_bits, 0)
    shift = ((32 - cache_bits) & 31).astype(np.uint32)
    slot = np.cumsum(size) - size
    cache = np.zeros(int(size.sum()) + 1, np.uint32)
    cachers = np.flatnonzero(size)
    all_cached, any_cached = len(cachers) == many, len(cachers) > 0
    hasher, one = np.uint32(cache_hash), np.uint64(1)
    greens, green_at, green_mask = tables[0], offsets[0], masks[0]

    def number(bits: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = _EXTRA[kind]
        return _BASE[kind] + (bits & ((one << e) - one)).view(np.int64), e

    out = np.zeros((steps, many), np.uint32)
    flat = out.reshape(-1)
    left, back = np.zeros(many, np.int64), np.zeros(many, np.int64)
    active = np.searchsorted(-total, -np.arange(steps), side="left").tolist()
    for s in range(steps):
        n = active[s]
        row = out[s, :n]
        copying = left[:n] > 0
        reading = np.flatnonzero(~copying)
        if len(reading):
            pos = at[reading]
            bits = window[np.minimum((pos >> 3).view(np.int64), top)] >> (pos & 7)
            got = greens[green_at[reading] + (bits & green_mask).view(np.int64)].astype(np.int32)
            length, symbol = got & 15, got >> 4
            other = np.flatnonzero(symbol >= 256)
            if plain:
                row[reading] = rest[reading] | (symbol << 8).view(np.uint32)  # what isn't a literal is set below
            else:
                pixel, shown = (symbol << 8).astype(np.uint32), bits >> length.astype(np.uint64)
                used = length.copy()
                for c, up in ((1, 16), (2, 0), (3, 24)):
                    more = tables[c][offsets[c][reading] + (shown & masks[c]).view(np.int64)]
                    pixel |= (more >> 4).astype(np.uint32) << np.uint32(up)
                    used += more & 15
                    shown = shown >> (more & 15).astype(np.uint64)
                row[reading] = pixel
                used[other] = length[other]
                length = used
            if len(other):
                kind, k = symbol[other], reading[other]
                cached = kind >= 280
                if cached.any():
                    who = k[cached]
                    row[who] = cache[slot[who] + kind[cached] - 280]
                    copies = np.flatnonzero(~cached)
                    other, kind, k = other[copies], kind[copies], k[copies]
                if len(other):
                    ahead = bits[other] >> length[other].astype(np.uint64)
                    span, e = number(ahead, kind - 256)
                    ahead >>= e
                    far = tables[4][offsets[4][k] + (ahead & masks[4]).view(np.int64)]
                    w = (far & 15).astype(np.uint64)
                    code, f = number(ahead >> w, far >> 4)
                    length[other] += (e + w + f).astype(np.int32)
                    close = np.minimum(code, 120) - 1
                    dist = np.where(code > 120, code - 120, np.maximum(1, dx[close] + dy[close] * width[k]))
                    wrong = (dist > s) | (s + span > total[k])
                    if wrong.any():  # its pixels no longer matter
                        bad[k[wrong]] = True
                        span, dist = np.where(wrong, np.minimum(span, total[k] - s), span), np.where(wrong, 0, dist)
                    left[k], back[k] = span, dist * many
                    copying[k] = True
            at[reading] = pos + length.astype(np.uint64)
        going = np.flatnonzero(copying)
        if len(going):
            row[going] = flat[s * many - back[going] + going]
            left[going] -= 1
        if all_cached:
            cache[slot[:n] + (row * hasher >> shift[:n])] = row
        elif any_cached:
            k = cachers[: np.searchsorted(cachers, n)]
            cache[slot[k] + (row[k] * hasher >> shift[k])] = row[k]
    bad |= at > streams.end[owner]
    streams.at[owner] = at
    columns = np.ascontiguousarray(out.T)
    result: list = [None] * many
    for i, k in enumerate(rank.tolist()):
        result[k] = columns[i, : total[i]].reshape(-1, width[i])
    back_in_order = np.empty(many, bool)
    back_in_order[rank] = bad
    return result, back_in_order

"""Lossless WebP, the public VP8L bitstream: an encoder and a decoder over numpy pixel arrays.

The decoder does all of the format: prefix codes, back-references, the colour cache, groups of codes by region, and
the predictor, cross-colour, subtract-green and palette transforms. Pixels are (height, width, 4) bytes in the order
alpha, red, green, blue. Where all codes of an image have one length each and nothing but literals, the whole image
is read by array operations; else symbol by symbol.
"""

from __future__ import annotations

import heapq
import struct
from collections import Counter

import numpy as np

# Fixed values of the format.
CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS, SUBTRACT, PALETTE = range(4)
LITERALS, LENGTHS, DISTANCES, CACHE_FACTOR = 256, 24, 40, 0x1E35A7BD
LARGEST = 16384
#: Near pixels by distance code: by distance, then column, right before left.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


def up(n: int, bits: int) -> int:
    return -(-n // (1 << bits))


class BitReader:
    def __init__(self, raw: bytes):
        self.raw, self.value, self.at = raw, int.from_bytes(raw[:4096], "little"), 0
        self.base, self.held = 0, min(len(raw), 4096) * 8

    def _fill(self) -> None:
        """Moves the window of 4096 bytes to the byte that the next bit is in."""
        byte = (self.base + self.at) // 8
        self.at = self.base + self.at - 8 * byte
        self.base, piece = 8 * byte, self.raw[byte : byte + 4096]
        self.value, self.held = int.from_bytes(piece, "little"), 8 * len(piece)

    def read(self, n: int) -> int:
        if self.at + n > self.held:
            self._fill()
        got = (self.value >> self.at) & ((1 << n) - 1)
        self.at += n
        return got

    @property
    def position(self) -> int:
        return self.base + self.at


class Code:
    """A canonical prefix code from the length of each symbol's code."""

    def __init__(self, lengths: list[int]):
        used = [(n, s) for s, n in enumerate(lengths) if n]
        self.flat = len({n for n, _ in used}) == 1 and used[0][0] or 0
        self.symbols = [s for _, s in sorted(used)]
        self.table: dict[tuple[int, int], int] = {}
        if len(used) == 1:  # no bits
            self.flat, self.only = 0, used[0][1]
            return
        self.only = None
        code = before = 0
        for n, s in sorted(used):
            code <<= n - before
            before = n
            self.table[n, code] = s
            code += 1
        if code != 1 << before:
            raise ValueError("the code lengths are no complete prefix code")

    def read(self, bits: BitReader) -> int:
        if self.only is not None:
            return self.only
        n = code = 0
        while True:
            code, n = code << 1 | bits.read(1), n + 1
            s = self.table.get((n, code))
            if s is not None:
                return s


def read_code(bits: BitReader, alphabet: int) -> Code:
    lengths = [0] * alphabet
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    n = 4 + bits.read(4)
    of_lengths = [0] * 19
    for s in CODE_ORDER[:n]:
        of_lengths[s] = bits.read(3)
    code = Code(of_lengths)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    at, before = 0, 8
    while at < alphabet and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            before, at = s or before, at + 1
        else:
            n = {16: lambda: 3 + bits.read(2), 17: lambda: 3 + bits.read(3), 18: lambda: 11 + bits.read(7)}[s]()
            lengths[at : at + n] = [before if s == 16 else 0] * n
            at += n
    if not any(lengths):
        lengths[0] = 1
    return Code(lengths)


def amount(bits: BitReader, prefix: int) -> int:
    """A length or distance from its prefix symbol."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def prefix_of(n: int) -> tuple[int, int, int]:
    """(symbol, extra bits, their value) of a length or distance."""
    n -= 1
    if n < 4:
        return n, 0, 0
    top = n.bit_length() - 1
    return 2 * top + (n >> (top - 1) & 1), top - 1, n & ((1 << (top - 1)) - 1)


def read_pixels(bits: BitReader, width: int, height: int, top: bool) -> np.ndarray:
    """An entropy-coded image, as 32-bit numbers."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    region_bits, regions, groups = 0, None, 1
    if top and bits.read(1):
        region_bits = bits.read(3) + 2
        regions = read_pixels(bits, up(width, region_bits), up(height, region_bits), False) >> 8 & 0xFFFF
        groups = int(regions.max()) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    codes = [[read_code(bits, n) for n in (LITERALS + LENGTHS + cache_size, LITERALS, LITERALS, LITERALS, DISTANCES)] for _ in range(groups)]
    total = width * height
    one = codes[0]
    if groups == 1 and all(c.flat or c.only is not None for c in one[:4]) and one[0].only != LITERALS and max(one[0].symbols) < LITERALS:
        return read_flat(bits, one, total).reshape(height, width)
    out = [0] * total
    cache, at, cached = [0] * cache_size, 0, 0
    while at < total:
        y, x = divmod(at, width)
        green, red, blue, alpha, far = codes[regions[y >> region_bits, x >> region_bits]] if regions is not None else one
        s = green.read(bits)
        if s < LITERALS:
            r, b = red.read(bits), blue.read(bits)
            out[at] = alpha.read(bits) << 24 | r << 16 | s << 8 | b
            at += 1
        elif s < LITERALS + LENGTHS:
            n, d = amount(bits, s - LITERALS), amount(bits, far.read(bits))
            if d > len(NEAR):
                d -= len(NEAR)
            else:
                dx, dy = NEAR[d - 1]
                d = max(1, dx + dy * width)
            for _ in range(n):
                out[at] = out[at - d]
                at += 1
        else:
            if not cache_size:
                raise ValueError("a colour cache symbol without a cache")
            while cached < at:
                cache[(CACHE_FACTOR * out[cached] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[cached]
                cached += 1
            out[at] = cache[s - LITERALS - LENGTHS]
            at += 1
    return np.array(out, np.uint32).reshape(height, width)


def read_flat(bits: BitReader, codes: list[Code], total: int) -> np.ndarray:
    sizes = [c.flat if c.only is None else 0 for c in codes[:4]]
    width, start = sum(sizes), bits.position
    end = start + width * total
    raw = np.frombuffer(bits.raw, np.uint8, count=-(-end // 8) - start // 8, offset=start // 8)
    field = np.unpackbits(raw, bitorder="little")[start % 8 : start % 8 + width * total].reshape(total, width)
    parts, at = [], 0
    for c, k in zip(codes, sizes):
        if not k:
            parts.append(np.uint32(c.only))
            continue
        index = np.packbits(field[:, at : at + k], axis=1)[:, 0] >> (8 - k)
        parts.append(np.array(c.symbols, np.uint32)[index])
        at += k
    green, red, blue, alpha = parts
    bits.at, bits.base = end - bits.base, bits.base
    bits._fill()
    return np.broadcast_to(alpha << np.uint32(24) | red << np.uint32(16) | green << np.uint32(8) | blue, (total,)).astype(np.uint32)


def channels(pixels: np.ndarray) -> np.ndarray:
    """(height, width, 4) bytes of 32-bit numbers: alpha, red, green, blue."""
    return pixels.astype(">u4").view(np.uint8).reshape(*pixels.shape, 4)


def numbers(pixels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(pixels).view(">u4")[..., 0].astype(np.uint32)


def half(a, b):
    return (a + b) >> 1


def predicted(mode: int, l, t, tr, tl):
    """The prediction from the neighbours, as integers in arrays."""
    if mode == 0 or mode > 13:
        return np.broadcast_to(np.array([255, 0, 0, 0]), np.shape(t))
    if mode <= 4:
        return (None, l, t, tr, tl)[mode]
    if mode == 11:
        to_left, to_top = np.abs(t - tl).sum(-1, keepdims=True), np.abs(l - tl).sum(-1, keepdims=True)
        return np.where(to_left < to_top, l, t)
    if mode == 12:
        return np.clip(l + t - tl, 0, 255)
    if mode == 13:
        a = half(l, t)
        return np.clip(a + np.trunc((a - tl) / 2).astype(int), 0, 255)
    return {5: lambda: half(half(l, tr), t), 6: lambda: half(l, tl), 7: lambda: half(l, t), 8: lambda: half(tl, t), 9: lambda: half(t, tr), 10: lambda: half(half(l, tl), half(t, tr))}[mode]()


#: Predictions that do not look left, so that a run of a row is one array operation.
ABOVE = {0, 2, 3, 4, 8, 9, 14, 15}


def predict(pixels: np.ndarray, modes: np.ndarray, bits: int, forward: bool) -> np.ndarray:
    """Takes predictions off the pixels (forward) or adds them back; modes by block."""
    height, width, _ = pixels.shape
    full = pixels.astype(int) if forward else np.zeros((height, width, 4), int)
    out = np.zeros((height, width, 4), int)
    given = pixels.astype(int)
    black, sign = np.array([255, 0, 0, 0]), -1 if forward else 1
    for y in range(height):
        row = full[y]
        if y == 0:
            if forward:
                out[0] = given[0] - np.vstack([black[None], given[0, :-1]])
            else:
                row[:] = np.cumsum(given[0] + np.vstack([black[None], np.zeros((width - 1, 4), int)]), axis=0) & 255
            continue
        above = full[y - 1]
        edge = (given[y, 0] + sign * above[0]) & 255
        out[y, 0] = edge
        if not forward:
            row[0] = edge
        right = np.vstack([above[1:], row[:1]])
        x = 1
        while x < width:
            to, mode = min(width, ((x >> bits) + 1) << bits), int(modes[y >> bits, x >> bits])
            here = slice(x, to)
            if forward or mode in ABOVE:
                p = predicted(mode, row[x - 1 : to - 1], above[here], right[here], above[x - 1 : to - 1])
                got = (given[y, here] + sign * p) & 255
                out[y, here] = got
                if not forward:
                    row[here] = got
            elif mode == 1:
                row[here] = (np.cumsum(given[y, here], axis=0) + row[x - 1]) & 255
            else:
                for k in range(x, to):
                    row[k] = (given[y, k] + predicted(mode, row[k - 1], above[k], right[k], above[k - 1])) & 255
            x = to
    return ((out if forward else full) & 255).astype(np.uint8)


def cross(pixels: np.ndarray, factors: np.ndarray, bits: int, forward: bool) -> np.ndarray:
    """Takes what green and red tell of red and blue off (forward) or adds it back; factors by block, as pixels."""
    height, width, _ = pixels.shape
    f = np.repeat(np.repeat(factors, 1 << bits, 0), 1 << bits, 1)[:height, :width].view(np.int8).astype(int)
    red_blue, green_blue, green_red = f[..., 1], f[..., 2], f[..., 3]
    signed = lambda c: c.astype(np.uint8).view(np.int8).astype(int)
    out, sign = pixels.astype(int), -1 if forward else 1
    green, red = signed(out[..., 2]), out[..., 1]
    new_red = (red + sign * ((green_red * green) >> 5)) & 255
    plain_red = red if forward else new_red
    out[..., 3] = (out[..., 3] + sign * ((green_blue * green) >> 5) + sign * ((red_blue * signed(plain_red)) >> 5)) & 255
    out[..., 1] = new_red
    return out.astype(np.uint8)


def decode(raw: bytes) -> np.ndarray:
    """The pixels of one WebP file."""
    if raw[:4] != b"RIFF" or raw[8:16] != b"WEBPVP8L" or raw[20] != 0x2F:
        raise ValueError("no lossless WebP")
    bits = BitReader(raw[21 : 20 + struct.unpack("<I", raw[16:20])[0]])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    inside, undo = width, []
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS):
            size = bits.read(3) + 2
            block = channels(read_pixels(bits, up(inside, size), up(height, size), False))
            undo.append((kind, size, block, inside))
        elif kind == SUBTRACT:
            undo.append((kind, 0, None, inside))
        else:
            n = bits.read(8) + 1
            colours = np.cumsum(channels(read_pixels(bits, n, 1, False))[0], axis=0, dtype=np.uint8)
            size = bundled(n)
            undo.append((kind, size, colours, inside))
            inside = up(inside, size)
    pixels = channels(read_pixels(bits, inside, height, True))
    for kind, size, extra, w in reversed(undo):
        pixels = undone(pixels, kind, size, extra, w)
    return pixels


def bundled(n: int) -> int:
    """The bits of the number of places in a table of n colours that share a pixel."""
    return 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0


def undone(pixels: np.ndarray, kind: int, size: int, extra: np.ndarray | None, width: int) -> np.ndarray:
    """The pixels before a transform; extra: the pixels of its blocks, or its colours."""
    if kind == PREDICTOR:
        return predict(pixels, extra[..., 2] & 15, size, False)
    if kind == CROSS:
        return cross(pixels, extra, size, False)
    if kind == SUBTRACT:
        pixels = pixels.copy()
        pixels[..., 1] += pixels[..., 2]
        pixels[..., 3] += pixels[..., 2]
        return pixels
    per, depth = 1 << size, 8 >> size
    index = np.stack([pixels[..., 2] >> (depth * k) & ((1 << depth) - 1) for k in range(per)], -1).reshape(len(pixels), -1)[:, :width]
    table = np.zeros((256, 4), np.uint8)  # indices past the table are transparent black
    table[: len(extra)] = extra
    return table[index]


class BitWriter:
    def __init__(self):
        self.value = self.n = 0
        self.done: list[np.ndarray] = []

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def fields(self, bits: np.ndarray) -> None:
        """An array of single bits, in the order of the stream."""
        own = np.unpackbits(np.frombuffer(self.value.to_bytes(-(-self.n // 8) or 1, "little"), np.uint8), bitorder="little")[: self.n]
        self.done += [own, bits]
        self.value = self.n = 0

    def bytes(self) -> bytes:
        self.fields(np.zeros(0, np.uint8))
        return np.packbits(np.concatenate(self.done), bitorder="little").tobytes()


def code_lengths(counts: list[int], most: int) -> list[int]:
    """Huffman's code lengths, none over most: small counts are raised until the tree is low enough."""
    used = [s for s, n in enumerate(counts) if n]
    least = 1
    while True:
        heap = [(max(counts[s], least), s, (s,)) for s in used]
        lengths = [0] * len(counts)
        if len(used) == 1:
            lengths[used[0]] = 1
            return lengths
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in (*a[2], *b[2]):
                lengths[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(lengths, default=0) <= most:
            return lengths
        least *= 2


def codewords(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (bits in the order of the stream, their number)."""
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    if len(used) == 1:
        return {used[0][1]: (0, 0)}
    out, code, before = {}, 0, 0
    for n, s in used:
        code <<= n - before
        before = n
        out[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
        code += 1
    return out


def write_code(out: BitWriter, lengths: list[int]) -> dict[int, tuple[int, int]]:
    used = [s for s, n in enumerate(lengths) if n]
    if not used or len(used) == 1 and used[0] < 256:
        s = used[0] if used else 0
        out.write(1, 1)
        out.write(0, 1)
        out.write(s > 1, 1)
        out.write(s, 8 if s > 1 else 1)
        return {s: (0, 0)}
    out.write(0, 1)
    runs, at = [], 0
    while at < len(lengths):
        n = 1
        while at + n < len(lengths) and lengths[at + n] == lengths[at] and n < 138:
            n += 1
        if lengths[at] == 0 and n >= 3:
            runs.append((18, n - 11, 7) if n >= 11 else (17, n - 3, 3))
        elif lengths[at] and n >= 4:
            n = min(n, 7)
            runs += [(lengths[at], 0, 0), (16, n - 4, 2)]
        else:
            n = 1
            runs.append((lengths[at], 0, 0))
        at += n
    counts = Counter(s for s, _, _ in runs)
    of_lengths = code_lengths([counts[s] for s in range(19)], 7)
    last = max(k for k, s in enumerate(CODE_ORDER) if of_lengths[s])
    n = max(4, last + 1)
    out.write(n - 4, 4)
    for s in CODE_ORDER[:n]:
        out.write(of_lengths[s], 3)
    out.write(0, 1)
    words = codewords(of_lengths)
    for s, extra, k in runs:
        out.write(*words[s])
        out.write(extra, k)
    return codewords(lengths)


def write_pixels(out: BitWriter, pixels: np.ndarray, top: bool, cache_bits: int = 0, references: bool = True, region_bits: int = 0) -> None:
    """Entropy-codes an image: back-references to what the last same three pixels led to, the colour cache, one group of codes or one for every region row."""
    height, width = pixels.shape
    flat = pixels.ravel().tolist()
    out.write(cache_bits > 0, 1)
    if cache_bits:
        out.write(cache_bits, 4)
    regions, groups = None, 1
    if top:
        out.write(region_bits > 0, 1)
        if region_bits:
            out.write(region_bits - 2, 3)
            shape = up(height, region_bits), up(width, region_bits)
            regions = np.repeat(np.arange(shape[0], dtype=np.uint32)[:, None], shape[1], 1)
            groups = shape[0]
            write_pixels(out, regions << 8, False, 0, False)
    symbols, seen, cache, at = [], {}, {}, 0
    near = {max(1, x + y * width): k + 1 for k, (x, y) in reversed([*enumerate(NEAR)])}
    while at < len(flat):
        n, from_ = 0, seen.get(tuple(flat[at : at + 3])) if references else None
        if from_ is not None:
            while at + n < len(flat) and n < 4096 and flat[from_ + n] == flat[at + n]:
                n += 1
        group = at // width >> region_bits if regions is not None else 0
        if n >= 3:
            d = at - from_
            symbols.append((group, *prefix_of(n), *prefix_of(near.get(d, d + len(NEAR)))))
        else:
            n, p = 1, flat[at]
            slot = (CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
            symbols.append((group, p, slot if cache_bits and cache.get(slot) == p else None))
        for k in range(at, at + n):
            if references:
                seen[tuple(flat[k : k + 3])] = k
            if cache_bits:
                cache[(CACHE_FACTOR * flat[k] & 0xFFFFFFFF) >> (32 - cache_bits)] = flat[k]
        at += n
    sizes = (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), LITERALS, LITERALS, LITERALS, DISTANCES)
    counts = [[[0] * n for n in sizes] for _ in range(groups)]
    for s in symbols:
        c = counts[s[0]]
        if len(s) > 3:
            c[0][LITERALS + s[1]] += 1
            c[4][s[4]] += 1
        elif s[2] is not None:
            c[0][LITERALS + LENGTHS + s[2]] += 1
        else:
            for k, shift in enumerate((8, 16, 0, 24)):
                c[k][s[1] >> shift & 255] += 1
    words = []
    for c in counts:
        words.append([write_code(out, code_lengths(x, 15)) for x in c])
    for s in symbols:
        w = words[s[0]]
        if len(s) > 3:
            out.write(*w[0][LITERALS + s[1]])
            out.write(s[3], s[2])
            out.write(*w[4][s[4]])
            out.write(s[6], s[5])
        elif s[2] is not None:
            out.write(*w[0][LITERALS + LENGTHS + s[2]])
        else:
            for k, shift in enumerate((8, 16, 0, 24)):
                out.write(*w[k][s[1] >> shift & 255])


def begun(width: int, height: int) -> BitWriter:
    out = BitWriter()
    out.write(width - 1, 14)
    out.write(height - 1, 14)
    out.write(1, 1)
    out.write(0, 3)
    return out


def file_of(out: BitWriter) -> bytes:
    body = b"\x2f" + out.bytes()
    odd = b"\0" * (len(body) % 2)
    return b"RIFF" + struct.pack("<I", 12 + len(body) + len(odd)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + odd


def encode(pixels: np.ndarray, predictor: int | None = None, cross_factors: tuple[int, int, int] | None = None, subtract: bool = False, palette: bool = False, block_bits: int = 3, cache_bits: int = 0, references: bool = True, region_bits: int = 0) -> bytes:
    """One WebP file with the transforms and codes asked for; predictor: a mode, or -1 for all in turn."""
    height, width, _ = pixels.shape
    out = begun(width, height)
    blocks = up(height, block_bits), up(width, block_bits)
    if palette:
        colours = np.unique(numbers(pixels))
        if len(colours) > 256:
            raise ValueError("a palette holds at most 256 colours")
        index = np.searchsorted(colours, numbers(pixels)).astype(np.uint8)
        deltas = channels(colours[None])[0]
        deltas = np.vstack([deltas[:1], np.diff(deltas, axis=0)]).astype(np.uint8)
        out.write(1 | PALETTE << 1, 3)
        out.write(len(colours) - 1, 8)
        write_pixels(out, numbers(deltas[None]), False)
        size = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
        per, depth = 1 << size, 8 >> size
        index = np.pad(index, ((0, 0), (0, -width % per))).reshape(height, -1, per)
        green = sum(index[..., k].astype(np.uint32) << depth * k for k in range(per))
        pixels = channels(np.uint32(0xFF000000) | green << 8)
        blocks = blocks[0], up(pixels.shape[1], block_bits)
    if subtract:
        out.write(1 | SUBTRACT << 1, 3)
        pixels = pixels.copy()
        pixels[..., 1] -= pixels[..., 2]
        pixels[..., 3] -= pixels[..., 2]
    if predictor is not None:
        modes = np.full(blocks, predictor) if predictor >= 0 else np.arange(blocks[0] * blocks[1]).reshape(blocks) % 14
        out.write(1 | PREDICTOR << 1, 3)
        out.write(block_bits - 2, 3)
        write_pixels(out, (np.uint32(0xFF000000) | modes.astype(np.uint32) << 8), False)
        pixels = predict(pixels, modes, block_bits, True)
    if cross_factors is not None:
        factors = np.zeros((*blocks, 4), np.uint8)
        factors[:] = (255, *(f & 255 for f in cross_factors))
        out.write(1 | CROSS << 1, 3)
        out.write(block_bits - 2, 3)
        write_pixels(out, numbers(factors), False)
        pixels = cross(pixels, factors, block_bits, True)
    out.write(0, 1)
    write_pixels(out, numbers(pixels), True, cache_bits, references, region_bits)
    return file_of(out)


def flat_head(sizes: tuple[int, int, int], alpha: int) -> BitWriter:
    """The end of a header with codes of one length for the three colours: all of 2**size first symbols; one alpha."""
    out = BitWriter()
    out.write(0, 3)  # no transform, no cache, no regions
    for k, alphabet in zip(sizes, (LITERALS + LENGTHS, LITERALS, LITERALS)):
        write_code(out, [k] * (1 << k) + [0] * (alphabet - (1 << k)))
    lengths = [0] * LITERALS
    lengths[alpha] = 1
    write_code(out, lengths)
    write_code(out, [])
    return out


HEADS: dict[tuple, tuple[int, int]] = {}


def encode_fast(colours: np.ndarray) -> bytes:
    """One WebP file of (height, width, 3) red, green, blue, by array operations alone: literals, each colour by a code of one length, as short as its largest sample allows."""
    height, width, _ = colours.shape
    flat = colours.reshape(-1, 3)
    sizes = tuple(max(1, int(flat[:, c].max()).bit_length()) for c in (1, 0, 2))
    if sizes not in HEADS:
        head = flat_head(sizes, 255)
        HEADS[sizes] = head.value, head.n
    out = begun(width, height)
    out.write(*HEADS[sizes])
    out.fields(np.hstack([np.unpackbits(flat[:, c, None], axis=1)[:, 8 - k :] for c, k in zip((1, 0, 2), sizes)]).ravel())
    return file_of(out)

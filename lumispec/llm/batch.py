"""Many lossless WebP files at once: the encoder and decoder of webp.py's format with array operations over all files.

Files are encoded with Huffman codes of their own and back-references, a colour cache where it is met often, and the
transforms of the format. Subtract-green is chosen by the entropy of the colours; predictor (a mode a block), with
cross-colour after it, palette, and regions with codes of their own are encoded, too, where the entropy speaks for them,
and the smallest file is kept. The decoder reads any file with up to GROUPS groups of codes that are at most LIMIT bits
long, all files in step, a symbol at a time; webp.decode() reads the others.
"""

from __future__ import annotations

import struct

import numpy as np

from . import webp
from .tokens import spread

#: The longest code, in bits; the bits of the colour cache; pixels that a reference copies at least and at most.
LIMIT, CACHE_BITS, LEAST, MOST = 11, 7, 6, 4096
SLOTS = 1 << LIMIT
#: Pixels of the files that are decoded together, with all counted as large as the largest.
TOGETHER = 8_000_000
#: A file's alphabets: green with lengths and cache, red, blue, distances.
GREEN = webp.LITERALS + webp.LENGTHS
REVERSED = np.array([int(f"{k:0{LIMIT}b}"[::-1], 2) for k in range(SLOTS)], np.int64)
#: The code of code lengths that the encoder uses: sixteen symbols of four bits.
LENGTH_SYMBOLS = [*range(13), 16, 17, 18]
LENGTH_BITS = {s: int(f"{k:04b}"[::-1], 2) for k, s in enumerate(LENGTH_SYMBOLS)}


def run_fields(most: int) -> tuple[np.ndarray, np.ndarray]:
    """(bits, their number) that write a run of so many zero lengths."""
    values, sizes = [], []
    for n in range(most + 1):
        value = size = 0

        def put(v: int, k: int) -> None:
            nonlocal value, size
            value |= v << size
            size += k

        while n >= 3:
            k = min(n, 138) if n >= 11 else n
            put(LENGTH_BITS[18 if k >= 11 else 17], 4)
            put(*((k - 11, 7) if k >= 11 else (k - 3, 3)))
            n -= k
        for _ in range(n):
            put(LENGTH_BITS[0], 4)
        values.append(value)
        sizes.append(size)
    return np.array(values, np.uint64), np.array(sizes, np.int64)


RUNS = run_fields(GREEN + (1 << CACHE_BITS))
FIELD = np.zeros(LIMIT + 1, np.uint64)
FIELD[1:] = [LENGTH_BITS[k] for k in range(1, LIMIT + 1)]
PREFIX = np.array([webp.prefix_of(n) for n in range(1, 1 << 15)], np.int64)  # (symbol, extra bits, their value)


def huffman(counts: np.ndarray) -> np.ndarray:
    """Lengths of Huffman's codes, a row a code of two symbols or more: the two rarest are merged, in all rows at a time."""
    m, n = len(counts), (counts > 0).sum(axis=1)
    most, rows = int(n.max(initial=0)), np.arange(len(counts))
    order = np.argsort(np.where(counts > 0, counts, np.inf), axis=1, kind="stable")[:, :most]
    leaves = np.full((m, most + 1), np.inf)
    leaves[:, :most] = np.take_along_axis(np.where(counts > 0, counts, np.inf), order, axis=1)
    nodes = np.full((m, most + 1), np.inf)
    above = np.zeros((2, m, most + 1), np.int64)  # of leaves and of nodes: the node that they were merged into
    at = np.zeros((2, m), np.int64)
    for t in range(most - 1):
        r = rows if t < int(n.min()) - 1 else np.flatnonzero(t < n - 1)
        total = 0
        for _ in range(2):
            i, j = at[0, r], at[1, r]
            leaf, node = leaves[r, i], nodes[r, j]
            kind = (node < leaf).astype(np.int64)
            total = total + np.minimum(leaf, node)
            above[kind, r, np.where(kind, j, i)] = t
            at[kind, r] += 1
        nodes[r, t] = total
    depth = np.zeros((m, most), np.int64)
    for t in range(most - 3, -1, -1):
        r = rows if t < int(n.min()) - 2 else np.flatnonzero(t < n - 2)
        depth[r, t] = depth[r, above[1, r, t]] + 1
    out = np.zeros(counts.shape, np.int64)
    found = np.take_along_axis(depth, above[0, :, :most], axis=1) + 1
    np.put_along_axis(out, order, np.where(np.arange(most) < n[:, None], found, 0), axis=1)
    return out


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of Huffman's codes, a row a code, none over LIMIT: small counts are raised until the tree is low enough; no bits for a symbol alone."""
    out = np.zeros(counts.shape, np.int64)
    left = np.flatnonzero((counts > 0).sum(axis=1) > 1)
    held = counts.astype(float)
    least = np.ceil(held.sum(axis=1) / (1 << LIMIT + 1))
    while len(left):
        out[left] = huffman(np.where(counts[left] > 0, np.maximum(held[left], least[left, None]), 0))
        left = left[out[left].max(axis=1) > LIMIT]
        least[left] *= 2
    return out


def slots(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """(symbols in the order of their codes, first slot of each), a row a code; unused symbols come last, at the end."""
    key = np.where(lengths > 0, lengths, limit + 1) * 4096 + np.arange(lengths.shape[1])
    order = np.argsort(key, axis=1)
    by = np.take_along_axis(lengths, order, axis=1)
    size = np.where(by > 0, 1 << (limit - by), 0)
    return order, np.cumsum(size, axis=1) - size


def codewords(lengths: np.ndarray) -> np.ndarray:
    """The bits of each symbol's code, in the order of the stream."""
    order, first = slots(lengths)
    out = np.zeros_like(lengths)
    np.put_along_axis(out, order, REVERSED[np.minimum(first, SLOTS - 1)], axis=1)
    return out


class Fields:
    """Bit fields of many files, in sections; each section is given for all files, in their order."""

    def __init__(self, n: int):
        self.n, self.sections = n, []

    def add(self, owner: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> None:
        self.sections.append((owner, values.astype(np.uint64), sizes.astype(np.int64)))

    def same(self, value: int, size: int, owner: np.ndarray | None = None) -> None:
        owner = np.arange(self.n) if owner is None else owner
        self.add(owner, np.full(len(owner), value), np.full(len(owner), size))

    def files(self) -> list[bytes]:
        ends, at = np.zeros(self.n, np.int64), []
        for owner, _, sizes in self.sections:
            total = np.bincount(owner, sizes, self.n).astype(np.int64)
            before = np.cumsum(sizes) - sizes
            first = np.append(0, np.cumsum(total))[:-1]
            at.append(before - first[owner] + ends[owner])
            ends += total
        words = (ends + 31) // 32 + 1
        base = np.cumsum(words) - words
        where, what = [], []
        for (owner, values, sizes), place in zip(self.sections, at):
            # A field of up to 64 bits touches three words at most: two halves, each shifted within 64 bits.
            for half in (0, 1):
                some = np.flatnonzero(sizes > 32 * half)
                v = values[some] >> np.uint64(32 * half) & np.uint64(0xFFFFFFFF)
                p = place[some] + 32 * half
                v = v << (p & 31).astype(np.uint64)
                w = base[owner[some]] + (p >> 5)
                where += [w, w + 1]
                what += [v & np.uint64(0xFFFFFFFF), v >> np.uint64(32)]
        # Fields share no bits, so sums are unions, and exact.
        buffer = np.bincount(np.concatenate(where), np.concatenate(what), int(words.sum())).astype("<u4").tobytes()
        return [buffer[4 * b : 4 * b + (e + 7) // 8] for b, e in zip(base.tolist(), ends.tolist())]


def references(pixels: np.ndarray, first: int) -> list[tuple[int, int, int]]:
    """(place, length, distance) of copies: from where the last same LEAST pixels led to. first: added to places."""
    n = len(pixels)
    if n <= LEAST:
        return []
    x = pixels.astype(np.uint64)
    h = np.zeros(n - LEAST + 1, np.uint64)
    for k in range(LEAST):
        h = (h ^ x[k : n - LEAST + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    order = np.argsort(h, kind="stable")
    again = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    if not len(again):
        return []
    last = np.full(len(h), -1)
    last[order[again + 1]] = order[again]
    out, at = [], 0
    places = np.flatnonzero(last >= 0)
    while True:
        k = np.searchsorted(places, at)
        if k == len(places):
            return out
        i = int(places[k])
        j = int(last[i])
        length, step = 0, 64
        while length < min(MOST, n - i):
            most = min(step, MOST - length, n - i - length)
            differ = np.flatnonzero(pixels[i + length : i + length + most] != pixels[j + length : j + length + most])
            length += int(differ[0]) if len(differ) else most
            if len(differ):
                break
            step *= 4
        if length >= LEAST:
            out.append((first + i, length, i - j))
            at = i + length
        else:
            at = i + 1


def put_images(fields: Fields, owners: np.ndarray, images: list[np.ndarray], regions: list[np.ndarray | None] | None = None) -> None:
    """Entropy-codes a (height, width) image of 32-bit numbers for each of the files; regions: of the files' own images, the group of codes of each block, or None."""
    n = len(images)
    if not n:
        return
    widths, sizes = np.array([i.shape[1] for i in images]), np.array([i.size for i in images])
    argb = np.concatenate([i.ravel() for i in images])
    owner = np.repeat(np.arange(n), sizes)
    begin = np.cumsum(sizes) - sizes
    groups, part = np.ones(n, np.int64), np.zeros(len(argb), np.int64)
    split = np.array([k for k, r in enumerate(regions or []) if r is not None], np.int64)
    for k in split.tolist():
        groups[k] = regions[k].max() + 1
        part[begin[k] : begin[k] + sizes[k]] = by_pixel_of(regions[k], REGION_BITS, images[k]).ravel()
    first_code = np.cumsum(groups) - groups
    code, code_owner, n_codes = first_code[owner] + part, np.repeat(np.arange(n), groups), int(groups.sum())
    green, red, blue, alpha = ((argb >> np.uint32(k) & np.uint32(255)).astype(np.int64) for k in (8, 16, 0, 24))
    copies = [c for s, k in zip(begin.tolist(), sizes.tolist()) for c in references(argb[s : s + k], s)]
    at, length, distance = np.array(copies, np.int64).reshape(-1, 3).T
    literal = np.ones(len(argb), bool)
    literal[spread(at, length)] = False
    # A cache slot holds the last colour of its number, of copied pixels, too.
    slot = (argb * np.uint32(webp.CACHE_FACTOR) >> np.uint32(32 - CACHE_BITS)).astype(np.int64)
    order = np.argsort(owner << CACHE_BITS | slot, kind="stable")
    same = (owner[order[1:]] == owner[order[:-1]]) & (slot[order[1:]] == slot[order[:-1]]) & (argb[order[1:]] == argb[order[:-1]])
    hit = np.zeros(len(argb), bool)
    hit[order[1:][same]] = True
    hit &= literal
    cached = np.bincount(owner, hit, n) >= np.maximum(64, sizes / 8)
    hit &= cached[owner]
    literal &= ~hit
    # Every token is a green symbol; literals have red, blue and alpha, copies extra bits and a distance.
    token = literal | hit
    token[at] = True
    where = np.flatnonzero(token)
    place_of = np.cumsum(token) - 1
    t_code = code[where]
    symbol = np.where(hit[where], GREEN + slot[where], green[where])
    far = distance + len(webp.NEAR)
    for w in np.unique(widths[owner[at]]).tolist():
        near = {max(1, x + y * w): k + 1 for k, (x, y) in reversed([*enumerate(webp.NEAR)])}
        some = np.flatnonzero(widths[owner[at]] == w)
        far[some] = [near.get(d, d + len(webp.NEAR)) for d in distance[some].tolist()]
    l_code, d_code = PREFIX[length - 1], PREFIX[far - 1]
    symbol[place_of[at]] = webp.LITERALS + l_code[:, 0]
    alphabet = GREEN + (1 << CACHE_BITS)
    l_code_owner = code[literal]
    first = alpha[begin]
    varied = bool((alpha != first[owner]).any())
    counts = [np.bincount(t_code * alphabet + symbol, minlength=n_codes * alphabet).reshape(n_codes, -1)]
    counts += [np.bincount(l_code_owner * 256 + c[literal], minlength=n_codes * 256).reshape(n_codes, -1) for c in ((red, blue, alpha) if varied else (red, blue))]
    if not varied:
        counts.append(np.zeros((n_codes, 256), np.int64))
        counts[3][np.arange(n_codes), first[code_owner]] = 1
    counts.append(np.bincount(code[at] * webp.DISTANCES + d_code[:, 0], minlength=n_codes * webp.DISTANCES).reshape(n_codes, -1))
    lengths = [code_lengths(c) for c in counts]
    words = [codewords(l) for l in lengths]
    fields.add(owners, np.where(cached, 1 | CACHE_BITS << 1, 0), np.where(cached, 5, 1))
    if regions is not None:
        fields.same(0, 1, np.delete(owners, split))
        fields.same(1 | REGION_BITS - 2 << 1, 4, owners[split])
        put_images(fields, owners[split], [np.uint32(0xFF000000) | regions[k].astype(np.uint32) << np.uint32(8) for k in split])
    only_symbol = [np.where((l > 0).any(axis=1), -1, c.argmax(axis=1)) for c, l in zip(counts, lengths)]
    shown = np.where(cached, alphabet, GREEN)[code_owner]
    for g, k in ((g, k) for g in range(int(groups.max())) for k in range(5)):
        some = first_code[groups > g] + g
        l, only, of = lengths[k][some], only_symbol[k][some], owners[code_owner[some]]
        simple = np.flatnonzero(only >= 0)
        wide = only[simple] > 1
        fields.add(of[simple], np.where(wide, 0b101, 0b001) | only[simple] << 3, np.where(wide, 11, 4))
        full = of[only < 0]
        fields.add(full, np.full(len(full), 12 << 1), np.full(len(full), 5))
        fields.add(full, np.full(len(full), sum(4 << 3 * j for j in range(16))), np.full(len(full), 48))
        fields.add(full, np.zeros(len(full)), np.ones(len(full)))
        row, s = np.nonzero(l)
        new = np.append(True, row[1:] != row[:-1])[: len(row)]
        gap = np.where(new, s, s - np.append(0, s[:-1])[: len(s)] - 1)
        ends = np.flatnonzero(np.append(new[1:], True)) if len(row) else np.zeros(0, int)
        tops = shown[some] if k == 0 else np.full(len(some), l.shape[1])
        tail = tops[row[ends]] - s[ends] - 1
        # A field for each length, after the zeros before it, and one for the zeros at the end.
        values = RUNS[0][gap] | FIELD[l[row, s]] << RUNS[1][gap].astype(np.uint64)
        spots = np.arange(len(row)) + np.cumsum(new) - 1
        all_owner, all_value, all_size = (np.zeros(len(row) + len(ends), t) for t in (np.int64, np.uint64, np.int64))
        all_owner[spots], all_value[spots], all_size[spots] = of[row], values, RUNS[1][gap] + 4
        spots = ends + np.arange(len(ends)) + 1
        all_owner[spots], all_value[spots], all_size[spots] = of[row[ends]], RUNS[0][tail], RUNS[1][tail]
        fields.add(all_owner, all_value, all_size)
    # Tokens: up to 44 bits of a literal, or a copy's length and distance with their extra bits.
    bits, size = words[0][t_code, symbol], lengths[0][t_code, symbol]
    is_literal = literal[where]
    for c, k in ((red, 1), (blue, 2), *([(alpha, 3)] if varied else [])):
        w, l = words[k][t_code, c[where]], lengths[k][t_code, c[where]]
        bits = bits | np.where(is_literal, w << size, 0)
        size = size + np.where(is_literal, l, 0)
    if len(at):
        p, o = place_of[at], code[at]
        for amount, k in ((l_code, None), (d_code, 4)):
            if k is not None:
                bits[p] |= words[k][o, amount[:, 0]] << size[p]
                size[p] += lengths[k][o, amount[:, 0]]
            bits[p] |= amount[:, 2] << size[p]
            size[p] += amount[:, 1]
    fields.add(owners[owner[where]], bits, size)


#: What a file stores: its width and height, its transforms in order as (kind, bits of the blocks or colours - 1, their image), its image, its regions.
Item = tuple[int, int, list[tuple[int, int, np.ndarray | None]], np.ndarray, np.ndarray | None]
#: Regions are of blocks of 4 by 4; groups of codes that the decoder takes in step.
REGION_BITS, GROUPS = 2, 16


def coded(items: list[Item]) -> list[bytes]:
    n = len(items)
    fields = Fields(n)
    fields.add(np.arange(n), np.array([(w - 1) | (h - 1) << 14 | 1 << 28 for w, h, *_ in items]), np.full(n, 32))
    for step in range(max(len(i[2]) for i in items)):
        having = [(k, *i[2][step]) for k, i in enumerate(items) if step < len(i[2])]
        owners, kinds, extra = (np.array([h[j] for h in having]) for j in range(3))
        wide = np.array([0 if k == webp.SUBTRACT else 8 if k == webp.PALETTE else 3 for k in kinds.tolist()])
        value = np.where(kinds == webp.PALETTE, extra, np.where(kinds == webp.SUBTRACT, 0, extra - 2))
        fields.add(owners, 1 | kinds << 1 | value << 3, 3 + wide)
        some = [h for h in having if h[3] is not None]
        put_images(fields, np.array([h[0] for h in some], np.int64), [h[3] for h in some])
    fields.same(0, 1)
    put_images(fields, np.arange(n), [i[3] for i in items], [i[4] for i in items])
    out = []
    for body in fields.files():
        body = b"\x2f" + body
        odd = b"\0" * (len(body) % 2)
        out.append(b"RIFF" + struct.pack("<I", 12 + len(body) + len(odd)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + odd)
    return out


XLOGX = np.arange(1 << 13) * np.log2(np.maximum(np.arange(1 << 13), 1))
#: Blocks of 16 by 16 have modes and factors of their own; images looked at together; factors tried for cross-colour, in 32nds.
BLOCK_BITS, LOOK = 4, 128
FACTORS = (0, 8, 16, 24, 32, 48, -8, -16, -32)


def estimate(plane: np.ndarray) -> np.ndarray:
    """Bits that each of (n, ..) samples take by their entropy, with six for each symbol's code."""
    n = len(plane)
    flat = plane.reshape(n, -1)
    size = flat.shape[1]
    counts = np.bincount((flat + np.arange(0, n * 256, 256)[:, None]).ravel(), minlength=n * 256).reshape(n, 256)
    terms = XLOGX[counts] if size < len(XLOGX) else counts * np.log2(np.maximum(counts, 1))
    return size * np.log2(size) - terms.sum(axis=1) + 6 * (counts > 0).sum(axis=1)


def cost(rest: np.ndarray) -> np.ndarray:
    """About 16 bits' worth of the logarithm of each difference, for choices by block: 14 for 1, 36 for 4, 62 for 16, 92 for 128."""
    m = np.minimum(rest, -rest)
    return 10 * np.minimum(m, 2) + 3 * np.minimum(m, 8) + np.minimum(m, 32) + (m >> 3)


def by_block(costs: np.ndarray) -> np.ndarray:
    """Sums over the blocks of (n, height, width)."""
    step = 1 << BLOCK_BITS
    n, height, width = costs.shape
    if height <= step and width % step == 0:
        rows = costs[:, 0].copy()
        for y in range(1, height):
            rows += costs[:, y]
        return rows.reshape(n, 1, -1, step).sum(axis=3, dtype=np.int64)
    costs = np.add.reduceat(costs, np.arange(0, height, step), axis=1, dtype=np.int64)
    return np.add.reduceat(costs, np.arange(0, width, step), axis=2)


def by_pixel(blocks: np.ndarray, height: int, width: int) -> np.ndarray:
    return np.repeat(np.repeat(blocks, 1 << BLOCK_BITS, 1), 1 << BLOCK_BITS, 2)[:, :height, :width]


def guesses(l: np.ndarray, t: np.ndarray, tr: np.ndarray, tl: np.ndarray):
    """The fourteen predictions from the neighbours, in bytes; colours come first."""
    half = lambda a, b: (a & b) + ((a ^ b) >> 1)
    yield from (np.zeros_like(l), l, t, tr, tl)
    yield half(half(l, tr), t)
    yield half(l, tl)
    yield half(l, t)
    yield half(tl, t)
    yield half(t, tr)
    yield half(half(l, tl), half(t, tr))
    wide_l, wide_t, wide_tl = (c.astype(np.int16) for c in (l, t, tl))
    to_left, to_top = (a[0] + a[1] + a[2] for a in (np.abs(c - wide_tl) for c in (wide_t, wide_l)))
    yield np.where(to_left < to_top, l, t)
    yield np.clip(wide_l + wide_t - wide_tl, 0, 255).astype(np.uint8)
    a = half(l, t).astype(np.int16)
    d = a - wide_tl
    yield np.clip(a + (d + (d < 0) >> 1), 0, 255).astype(np.uint8)


def predict(planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(what the best mode of each block leaves, the modes) of (3, n, height, width) images."""
    l, t, tr, tl = (np.zeros_like(planes) for _ in range(4))
    l[..., 1:] = planes[..., :-1]
    t[..., 1:, :] = planes[..., :-1, :]
    tr[..., 1:, :-1], tr[..., 1:, -1] = planes[..., :-1, 1:], planes[..., 1:, 0]
    tl[..., 1:, 1:] = planes[..., :-1, :-1]
    first, edge = planes[..., 0, :] - l[..., 0, :], planes[..., 1:, 0] - t[..., 1:, 0]
    best = modes = out = None
    for mode, p in enumerate(guesses(l, t, tr, tl)):
        rest = planes - p
        rest[..., 0, :], rest[..., 1:, 0] = first, edge
        c = cost(rest)
        costs = by_block(np.add(c[0], c[1], dtype=np.uint16) + c[2])
        if best is None:
            best, modes, out = costs, np.zeros(costs.shape, np.uint32), rest
            continue
        better = costs < best
        if better.any():
            best = np.where(better, costs, best)
            modes[better] = mode
            np.copyto(out, rest, where=by_pixel(better, *planes.shape[2:]))
    return out, modes


def cross(planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(what the best factors of each block leave, the factors as (n, .., 4) pixels) of (3, n, height, width) images."""
    red, green, blue = (c.view(np.int8).astype(np.int16) for c in planes)
    factors = np.array(FACTORS)

    def best(value: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        costs = np.stack([by_block(cost((value - (f * by >> 5)).astype(np.uint8)).astype(np.uint16)) for f in FACTORS])
        costs[1:] += 16 * 8  # a factor's own bits
        f = factors[costs.argmin(axis=0)]
        return f, value - (by_pixel(f, *planes.shape[2:]) * by >> 5)

    green_red, new_red = best(red, green)
    green_blue, new_blue = best(blue, green)
    red_blue, new_blue = best(new_blue, red)
    return np.stack([new_red, green, new_blue]).astype(np.uint8), np.stack([np.full(green_red.shape, 255), red_blue, green_blue, green_red], -1).astype(np.uint8)


def pixels_of(planes: np.ndarray, alpha: int) -> np.ndarray:
    r, g, b = planes.astype(np.uint32)
    return np.uint32(alpha << 24) | r << np.uint32(16) | g << np.uint32(8) | b


def by_palette(pixels: np.ndarray) -> tuple[Item, int]:
    """(the image of (height, width) colours, 256 of them at most, as places in their table; its bits by entropy)."""
    height, width = pixels.shape
    colours, index = np.unique(pixels, return_inverse=True)
    n = len(colours)
    deltas = webp.channels(colours[None])[0]
    deltas = np.vstack([deltas[:1], np.diff(deltas, axis=0)]).astype(np.uint8)
    size = webp.bundled(n)
    index = np.pad(index.reshape(height, width), ((0, 0), (0, -width % (1 << size)))).reshape(height, -1, 1 << size)
    green = sum(index[..., k].astype(np.uint32) << np.uint32((8 >> size) * k) for k in range(1 << size))
    item = width, height, [(webp.PALETTE, n - 1, webp.numbers(deltas[None]))], np.uint32(0xFF000000) | green << np.uint32(8), None
    return item, estimate(green[None])[0] + estimate(deltas.T).sum()


def looked_at(planes: np.ndarray) -> tuple[list[Item], list[list[Item]]]:
    """(plain or subtract-green items, others that the entropy has as smaller) of (3, n, height, width) images."""
    _, n, height, width = planes.shape
    less = planes - planes[1]
    less[1] = planes[1]
    bits, less_bits = (estimate(p[0]) + estimate(p[2]) for p in (planes, less))
    subtract = less_bits < bits
    base = np.where(subtract[:, None, None], less, planes)
    bits = np.minimum(bits, less_bits) + estimate(planes[1])
    before = [[(webp.SUBTRACT, 0, None)] if s else [] for s in subtract]
    items = [(width, height, b, i, None) for b, i in zip(before, pixels_of(base, 255))]
    others: list[list[Item]] = [[] for _ in items]
    rest, modes = predict(base)
    blocks = modes[0].size
    rest_bits = sum(map(estimate, rest))
    some = np.flatnonzero(rest_bits + 3 * blocks + 60 < bits)
    if len(some):
        rest, modes = rest[:, some], modes[some]
        crossed, factors = cross(rest)
        gain = sum(map(estimate, crossed)) + 6 * blocks + 60 < rest_bits[some]
        left = np.where(gain[:, None, None], crossed, rest)
        for k, m, f, g, i in zip(some.tolist(), modes, factors, gain, pixels_of(left, 0)):
            steps = [*before[k], (webp.PREDICTOR, BLOCK_BITS, np.uint32(0xFF000000) | m << np.uint32(8))]
            if g:
                steps.append((webp.CROSS, BLOCK_BITS, webp.numbers(f)))
            others[k].append((width, height, steps, i, None))
    # Two groups of codes, for the upper and the lower blocks.
    shape = webp.up(height, REGION_BITS), webp.up(width, REGION_BITS)
    if shape[0] > 1:
        upper = shape[0] // 2
        y = upper << REGION_BITS
        halves = sum(estimate(p) for c in base for p in (c[:, :y], c[:, y:]))
        regions = np.repeat((np.arange(shape[0]) >= upper).astype(np.int64)[:, None], shape[1], 1)
        for k in np.flatnonzero(halves + 500 < bits).tolist():
            others[k].append((*items[k][:4], regions))
    colours = pixels_of(planes, 255)
    ordered = np.sort(colours.reshape(n, -1), axis=1)
    new = np.append(np.ones((n, 1), bool), ordered[:, 1:] != ordered[:, :-1], axis=1)
    number, starts = new.sum(axis=1), np.flatnonzero(new)
    run = np.diff(np.append(starts, new.size))
    # What the colours take as symbols of one code; those of few colours share bytes.
    together = height * width * np.log2(height * width) - np.bincount(starts // (height * width), run * np.log2(run), n)
    for k in np.flatnonzero((number <= 16) | (number <= 256) & (together + 14 * number < bits)).tolist():
        item, own = by_palette(colours[k])
        if own < bits[k]:
            others[k].append(item)
    return items, others


def encode(strips: list[np.ndarray]) -> list[bytes]:
    """A file for each strip of (height, width, 3) red, green, blue: the smallest of those with the transforms that its entropy speaks for."""
    items: list = [None] * len(strips)
    others: list = [None] * len(strips)
    by_shape: dict[tuple, list[int]] = {}
    for k, s in enumerate(strips):
        by_shape.setdefault(s.shape, []).append(k)
    for group in by_shape.values():
        for a in range(0, len(group), LOOK):
            own = group[a : a + LOOK]
            for k, item, other in zip(own, *looked_at(np.ascontiguousarray(np.stack([strips[k] for k in own]).transpose(3, 0, 1, 2)))):
                items[k], others[k] = item, other
    files = coded(items)
    more = [(k, item) for k, other in enumerate(others) for item in other]
    if more:
        for (k, _), file in zip(more, coded([item for _, item in more])):
            files[k] = min(files[k], file, key=len)
    return files


class Readers:
    """The bits of many streams, each read at its own place."""

    def __init__(self, bodies: list[bytes]):
        sizes = np.array([len(b) for b in bodies])
        self.raw = b"".join(b + b"\0" * 16 for b in bodies)
        # The 64 bits from each byte on; aligned, as look-ups are slow where they are not.
        self.words = np.ndarray((len(self.raw) - 8,), "<u8", self.raw, strides=(1,)).copy()
        self.at = 8 * (np.cumsum(sizes + 16) - sizes - 16)
        self.end = self.at + 8 * sizes

    def of(self, rows: np.ndarray) -> Readers:
        """Some of the streams, from where they are."""
        out = object.__new__(Readers)
        out.raw, out.words, out.at, out.end = self.raw, self.words, self.at[rows], self.end[rows]
        return out

    def peek(self, rows) -> np.ndarray:
        """At least 57 bits of each."""
        at = self.at[rows]
        return (self.words[at >> 3] >> (at & 7).astype(np.uint64)).astype(np.int64)

    def read(self, rows: np.ndarray, n) -> np.ndarray:
        got = self.peek(rows) & ((1 << np.asarray(n, np.int64)) - 1)
        self.at[rows] += n
        return got


def table_of(lengths: np.ndarray, only: np.ndarray, limit: int) -> np.ndarray:
    """symbol << 4 | bits by the next bits in the stream, a row a code; only: the symbol of a code without bits, else -1."""
    order, _ = slots(lengths, limit)
    by = np.take_along_axis(lengths, order, axis=1)
    size = np.where(by > 0, 1 << (limit - by), 0)
    if (size.sum(axis=1)[only < 0] != 1 << limit).any():
        raise ValueError("the code lengths are no complete prefix code")
    size[only >= 0, 0] = 1 << limit
    entry = np.where((only >= 0)[:, None], only[:, None] << 4, order << 4 | by)
    ordered = np.repeat(entry.ravel(), size.ravel()).astype(np.int32).reshape(len(lengths), -1)
    return ordered[:, REVERSED[: 1 << limit] >> (LIMIT - limit)]


def read_codes(bits: Readers, rows: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, only) of the next code of each stream."""
    n, most = len(rows), int(alphabet.max())
    lengths, only = np.zeros((n, most), np.int64), np.full(n, -1)
    simple = bits.read(rows, 1) == 1
    here = np.flatnonzero(simple)
    if len(here):
        two = bits.read(rows[here], 1)
        wide = bits.read(rows[here], 1)
        first = bits.read(rows[here], np.where(wide, 8, 1))
        second = np.where(two > 0, bits.read(rows[here], np.where(two, 8, 0)), first)
        pair = second != first
        only[here[~pair]] = first[~pair]
        lengths[here[pair], first[pair]] = lengths[here[pair], second[pair]] = 1
    here = np.flatnonzero(~simple)
    if not len(here):
        return lengths, only
    number = 4 + bits.read(rows[here], 4)
    of = np.zeros((len(here), 19), np.int64)
    for k, s in enumerate(webp.CODE_ORDER):
        some = np.flatnonzero(number > k)
        of[some, s] = bits.read(rows[here[some]], 3)
    lone = np.where((of > 0).sum(axis=1) == 1, of.argmax(axis=1), -1)
    table = table_of(np.where((lone >= 0)[:, None], 0, of), lone, 7)
    limited = bits.read(rows[here], 1)
    some = np.flatnonzero(limited)
    left = alphabet[here].copy()
    if len(some):
        k = 2 + 2 * bits.read(rows[here[some]], 3)
        left[some] = 2 + bits.read(rows[here[some]], k)
    at, before = np.zeros(len(here), np.int64), np.full(len(here), 8)
    live = np.arange(len(here))
    repeat = {16: (2, 3), 17: (3, 3), 18: (7, 11)}
    while len(live):
        e = table[live, bits.peek(rows[here[live]]) & 127]
        bits.at[rows[here[live]]] += e & 15
        s = e >> 4
        plain = s < 16
        a = live[plain]
        lengths[here[a], at[a]] = s[plain]
        before[a] = np.where(s[plain] > 0, s[plain], before[a])
        at[a] += 1
        for code, (k, base) in repeat.items():
            a = live[s == code]
            if len(a):
                times = base + bits.read(rows[here[a]], k)
                if code == 16:
                    times = np.minimum(times, alphabet[here[a]] - at[a])
                    lengths[np.repeat(here[a], times), spread(at[a], times)] = np.repeat(before[a], times)
                at[a] += times
        left[live] -= 1
        live = live[(left[live] > 0) & (at[live] < alphabet[here[live]])]
    used = (lengths[here] > 0).sum(axis=1)
    one = here[used <= 1]
    only[one] = lengths[one].argmax(axis=1)
    lengths[one] = 0
    return lengths, only


def decode(files: list[bytes]) -> list[np.ndarray]:
    """The (height, width, 4) pixels of each file."""
    out: list = [None] * len(files)
    size = np.array([(1 + (h & 0x3FFF)) * (1 + (h >> 14 & 0x3FFF)) for h in (struct.unpack_from("<I", f, 21)[0] for f in files)])
    order = np.argsort(-size, kind="stable")
    start = 0
    while start < len(order):
        to = start + max(1, min(len(order) - start, TOGETHER // int(size[order[start]])))
        group = order[start:to]
        try:
            done = in_step([files[k] for k in group])
        except IndexError as e:  # past the last stream
            raise ValueError("a file ends before its pixels") from e
        for k, p in zip(group.tolist(), done):
            out[k] = webp.decode(files[k]) if p is None else p
        start = to
    return out


def in_step(files: list[bytes]) -> list[np.ndarray | None]:
    """Decodes files; None for those that need webp.decode()."""
    n = len(files)
    for f in files:
        if f[:4] != b"RIFF" or f[8:16] != b"WEBPVP8L" or f[20] != 0x2F:
            raise ValueError("no lossless WebP")
    bits = Readers([f[21 : 20 + struct.unpack_from("<I", f, 16)[0]] for f in files])
    head = bits.read(np.arange(n), 32)
    width, height = 1 + (head & 0x3FFF), 1 + (head >> 14 & 0x3FFF)
    if (head >> 29).any():
        raise ValueError("an unknown version")
    steps: list[list[tuple]] = [[] for _ in files]
    good, live, left = np.ones(n, bool), np.arange(n), 5
    while len(live := live[bits.read(live, 1) == 1]) and (left := left - 1):
        kind, extra = bits.read(live, 2), np.zeros(len(live), np.int64)
        table, imaged = kind == webp.PALETTE, kind != webp.SUBTRACT
        extra[imaged] = bits.read(live[imaged], np.where(table[imaged], 8, 3)) + np.where(table[imaged], 1, 2)
        across = np.where(table, extra, -(-width[live] >> extra))
        down = np.where(table, 1, -(-height[live] >> extra))
        own = bits.of(live[imaged])
        found = iter(read_images(own, across[imaged], down[imaged]))
        bits.at[live[imaged]] = own.at
        for k, what, size in zip(live.tolist(), kind.tolist(), extra.tolist()):
            image = next(found) if what != webp.SUBTRACT else None
            if image is None:
                good[k] &= what == webp.SUBTRACT
                steps[k].append((what, 0, None, width[k]))
            elif what != webp.PALETTE:
                steps[k].append((what, size, webp.channels(image), width[k]))
            else:
                colours = np.cumsum(webp.channels(image)[0], axis=0, dtype=np.uint8)
                steps[k].append((what, webp.bundled(size), colours, width[k]))
                width[k] = webp.up(int(width[k]), webp.bundled(size))
        live = live[good[live]]
    good[live] = False
    rows = np.flatnonzero(good)
    out: list = [None] * n
    for k, image in zip(rows.tolist(), read_images(bits.of(rows), width[rows], height[rows], True)):
        out[k] = None if image is None else webp.channels(image)
    some = [k for k in range(n) if out[k] is not None]
    while some := [k for k in some if steps[k]]:
        predicted: dict[int, list[int]] = {}
        for k in some:
            if steps[k][-1][0] == webp.PREDICTOR:
                predicted.setdefault(out[k].shape[1], []).append(k)
            else:
                out[k] = webp.undone(out[k], *steps[k][-1])
        for group in predicted.values():
            modes = [by_pixel_of(steps[k][-1][2][..., 2] & 15, steps[k][-1][1], out[k]) for k in group]
            for k, image in zip(group, unpredicted([out[k] for k in group], modes)):
                out[k] = image
        for k in some:
            steps[k].pop()
    return out


def by_pixel_of(blocks: np.ndarray, bits: int, image: np.ndarray) -> np.ndarray:
    return np.repeat(np.repeat(blocks, 1 << bits, 0), 1 << bits, 1)[: image.shape[0], : image.shape[1]]


def unpredicted(images: list[np.ndarray], modes: list[np.ndarray]) -> list[np.ndarray]:
    """Adds predictions back to images of one width, a pixel of all of them at a time; modes by pixel."""
    order = sorted(range(len(images)), key=lambda k: -len(images[k]))
    heights = np.array([len(images[k]) for k in order])
    width = images[0].shape[1]
    given = np.zeros((heights[0], width, len(order), 4), np.int16)
    mode = np.zeros((heights[0], width, len(order)), np.int16)
    for j, k in enumerate(order):
        given[: heights[j], :, j], mode[: heights[j], :, j] = images[k], modes[k]
    given[0, 0] += np.array([255, 0, 0, 0], np.int16)
    full = np.zeros(given.shape, np.int16)
    full[0] = np.cumsum(given[0], axis=0, dtype=np.int64) & 255
    for y in range(1, int(heights[0])):
        m = int(np.searchsorted(-heights, -y, "left"))  # those with a row y
        row, above, own, kinds = full[y, :, :m], full[y - 1, :, :m], given[y, :, :m], mode[y, :, :m]
        row[0] = own[0] + above[0] & 255
        change = np.append(True, (kinds[2:] != kinds[1:-1]).any(axis=1))
        for x in range(1, width):
            if change[x - 1]:
                groups = [(int(k), np.flatnonzero(kinds[x] == k)) for k in np.unique(kinds[x])]
                if len(groups) == 1:
                    groups = [(groups[0][0], slice(None))]
            right = above[x + 1] if x + 1 < width else row[0]
            for k, r in groups:
                row[x, r] = own[x, r] + webp.predicted(k, row[x - 1, r], above[x, r], right[r], above[x - 1, r]) & 255
    out: list = [None] * len(images)
    for j, k in enumerate(order):
        out[k] = full[: heights[j], :, j].astype(np.uint8)
    return out


def read_images(bits: Readers, width: np.ndarray, height: np.ndarray, top: bool = False) -> list[np.ndarray | None]:
    """The (height, width) 32-bit numbers that come next in each stream; None for those with over GROUPS groups of codes, or codes over LIMIT. top: the files' own images."""
    n = len(width)
    out: list = [None] * n
    if not n:
        return out
    rows = np.arange(n)
    cache_bits = np.zeros(n, np.int64)
    cached = np.flatnonzero(bits.read(rows, 1) == 1)
    cache_bits[cached] = bits.read(cached, 4)
    regions, groups, good = {}, np.ones(n, np.int64), np.ones(n, bool)
    if top:
        split = np.flatnonzero(bits.read(rows, 1) == 1)
        block = bits.read(split, 3) + 2
        own = bits.of(split)
        for k, b, image in zip(split.tolist(), block.tolist(), read_images(own, -(-width[split] >> block), -(-height[split] >> block))):
            if image is None:
                good[k] = False
                continue
            parts = (image >> np.uint32(8) & np.uint32(0xFFFF)).astype(np.int64)
            groups[k] = parts.max() + 1
            regions[k] = np.repeat(np.repeat(parts, 1 << b, 0), 1 << b, 1)[: height[k], : width[k]].ravel()
        bits.at[split] = own.at
        good &= groups <= GROUPS
    rows = np.argsort(-width * height, kind="stable")  # the largest first
    rows = rows[good[rows]]
    slots_of = np.where(cache_bits > 0, 1 << cache_bits, 0)
    alphabets = GREEN + int(slots_of.max()), 256, 256, 256, webp.DISTANCES
    first = np.cumsum(groups[rows]) - groups[rows]
    total_codes = int(groups[rows].sum())
    found = [(np.zeros((total_codes, a), np.int64), np.zeros(total_codes, np.int64)) for a in alphabets]
    for g in range(int(groups[rows].max(initial=0))):
        having = np.flatnonzero(groups[rows] > g)
        for k, (lengths, only) in enumerate(found):
            a = GREEN + slots_of[rows[having]] if k == 0 else np.full(len(having), alphabets[k])
            got, alone = read_codes(bits, rows[having], a)
            lengths[first[having] + g, : got.shape[1]], only[first[having] + g] = got, alone
    short = np.max([lengths.max(axis=1, initial=0) for lengths, _ in found], axis=0) <= LIMIT
    good = np.logical_and.reduceat(short, first) if len(rows) else np.zeros(0, bool)
    some = np.repeat(good, groups[rows])
    rows = rows[good]
    if not len(rows):
        return out
    tables = [table_of(lengths[some], only[some], LIMIT).ravel() for lengths, only in found]
    first = np.cumsum(groups[rows]) - groups[rows]
    outer, bits = bits, bits.of(rows)
    width, height = width[rows], height[rows]
    cache_bits, total, m = cache_bits[rows], width * height, len(rows)
    pixels = np.zeros((int(total.max()), m), np.uint32)
    cache = np.zeros((m, int(slots_of[rows].max()) or 1), np.uint32)
    with_cache = np.flatnonzero(cache_bits)
    shift = (32 - cache_bits).astype(np.uint32)
    # The codes that hold at each place, where they change.
    several = np.flatnonzero(groups[rows] > 1)
    codes, parts = first, np.zeros((len(pixels), len(several)), np.int64)
    for j, k in enumerate(several.tolist()):
        parts[: total[k], j] = regions[int(rows[k])]
    pending, distance = np.zeros(m, np.int64), np.ones(m, np.int64)
    near_x, near_y = np.array(webp.NEAR).T
    active = len(total) - np.searchsorted(total[::-1], np.arange(len(pixels)), "right")  # the largest are first

    def amounts(rows: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        extra = np.maximum(prefix - 2, 0) >> 1
        return np.where(prefix < 4, prefix, ((2 + (prefix & 1)) << extra) + bits.read(rows, np.where(prefix < 4, 0, extra))) + 1

    at, last = bits.at, np.uint64(SLOTS - 1)
    # Codes without bits need no look-up.
    fixed = [np.uint32(t[::SLOTS] >> 4) if not (t[::SLOTS] & 15).any() and (t.reshape(-1, SLOTS) == t[::SLOTS, None]).all() else None for t in tables]
    copying = False
    for t, k in enumerate(active.tolist()):
        if len(several):
            codes = first.copy()
            codes[several] += parts[t]
        line = pixels[t, :k]
        here, own = at[:k], codes[:k] * SLOTS
        w = bits.words[here >> 3] >> (here & 7).astype(np.uint64)
        e = tables[0].take((w & last).astype(np.int64) + own)
        s, moved = e >> 4, e & 15
        value = np.left_shift(s, 8, dtype=np.uint32, casting="unsafe")
        green_bits = moved
        for table, same, left in ((tables[1], fixed[1], 16), (tables[2], fixed[2], 0), (tables[3], fixed[3], 24)):
            if same is not None:
                value |= same[codes[:k]] << np.uint32(left)
                continue
            e = table.take((w >> moved.astype(np.uint64) & last).astype(np.int64) + own)
            moved = moved + (e & 15)
            value |= np.left_shift(e >> 4, left, dtype=np.uint32, casting="unsafe")
        rest = s >= webp.LITERALS
        if copying:
            waiting = pending[:k] > 0
            rest &= ~waiting
            moved = np.where(waiting, 0, moved)
        line[:] = value
        r = np.flatnonzero(rest)
        if len(r):
            moved[r] = green_bits[r]
        here += moved
        if len(r):
            held = s[r] >= GREEN
            if held.any():
                h = r[held]
                if (cache_bits[h] == 0).any():
                    raise ValueError("a colour cache symbol without a cache")
                line[h] = cache[h, s[h] - GREEN]
                r = r[~held]
            if len(r):
                pending[r] = amounts(r, s[r] - webp.LITERALS)
                e = tables[4].take((bits.peek(r) & (SLOTS - 1)) + own[r])
                at[r] += e & 15
                d = amounts(r, e >> 4)
                close = np.minimum(d, len(webp.NEAR)) - 1
                distance[r] = np.where(d > len(webp.NEAR), d - len(webp.NEAR), np.maximum(1, near_x[close] + near_y[close] * width[r]))
                if (distance[r] > t).any():
                    raise ValueError("a reference to before the image")
                copying = True
        if copying:
            r = np.flatnonzero(pending[:k] > 0)
            line[r] = pixels[t - distance[r], r]
            pending[r] -= 1
            copying = bool(len(r))
        if len(with_cache):
            r = with_cache[: np.searchsorted(with_cache, k)]
            cache[r, line[r] * np.uint32(webp.CACHE_FACTOR) >> shift[r]] = line[r]
    if (bits.at > bits.end).any():
        raise ValueError("a file ends before its pixels")
    outer.at[rows] = bits.at
    pixels = np.ascontiguousarray(pixels.T)
    for j, r in enumerate(rows.tolist()):
        out[r] = pixels[j, : total[j]].reshape(height[j], width[j])
    return out

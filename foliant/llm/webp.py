"""Lossless WebP (VP8L): a decoder for prefix codes, back-references, colour cache and all four transforms, and an encoder.

Pixels are arrays (height, width) of uint32 ARGB. An image whose stream is one group of codes without a cache, of which only the first
says more than one thing (as gray() writes it), is decoded by array operations between its back-references; any other, pixel by pixel.

gray() chooses for each image what makes it smallest: a palette with several pixels in a byte, a predictor, back-references. A colour
cache and cross-colour can't shrink gray images (one code says all there is), so only encode() writes them."""

from __future__ import annotations

import heapq

import numpy as np

# Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
SIDE = 16384


class BadStream(ValueError):
    """The stream isn't a whole lossless WebP image."""


#: All numbers of 16 bits with their bits in reverse.
_turned = np.zeros(1 << 16, np.int64)
for _k in range(16):
    _turned |= (np.arange(1 << 16) >> _k & 1) << (15 - _k)
TURNED = memoryview(_turned)


def reverse(code: int, n: int) -> int:
    return TURNED[code] >> (16 - n)


def canonical(lengths: dict[int, int]) -> dict[int, int]:
    """Bit-reversed canonical code of each symbol with a length."""
    out, code, before = {}, 0, 0
    for n, s in sorted((n, s) for s, n in lengths.items() if n):
        code <<= n - before
        before = n
        out[s] = reverse(code, n)
        code += 1
    return out


class Bits:
    """Reads from the lowest bit of each byte up."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.end = data, at, len(data) * 8

    def read(self, n: int) -> int:
        a = self.at
        self.at = a + n
        if self.at > self.end:
            raise BadStream("it ends early")
        return int.from_bytes(self.data[a >> 3 : (a + n + 7) >> 3], "little") >> (a & 7) & ((1 << n) - 1)


class Code:
    """A prefix code as a table indexed by the next `width` bits."""

    def __init__(self, lengths: dict[int, int]):
        lengths = {s: n for s, n in lengths.items() if n}
        if not lengths:
            lengths = {0: 0}
        elif len(lengths) == 1:
            lengths = {next(iter(lengths)): 0}
        elif sum(1 << (15 - n) for n in lengths.values()) != 1 << 15:
            raise BadStream("a prefix code isn't complete")
        self.lengths = lengths
        self.width = max(lengths.values())
        self.symbol = np.zeros(1 << self.width, np.int32)
        self.size = np.zeros(1 << self.width, np.uint8)
        for s, c in (canonical(lengths) if self.width else {next(iter(lengths)): 0}).items():
            self.symbol[c :: 1 << lengths[s]] = s
            self.size[c :: 1 << lengths[s]] = lengths[s]
        self.symbols, self.sizes = memoryview(self.symbol), memoryview(self.size)

    def read(self, bits: Bits) -> int:
        if not self.width:
            return int(self.symbol[0])
        a = bits.at
        i = int.from_bytes(bits.data[a >> 3 : (a + self.width + 7) >> 3], "little") >> (a & 7) & ((1 << self.width) - 1)
        s, n = self.symbols[i], self.sizes[i]
        bits.at = a + n
        if bits.at > bits.end:
            raise BadStream("it ends early")
        return s


def read_code(bits: Bits, alphabet: int) -> Code:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        first = bits.read(8 if wide else 1)
        return Code({first: 1, bits.read(8): 1} if two else {first: 1})
    n = 4 + bits.read(4)
    meta = Code({LENGTH_ORDER[i]: bits.read(3) for i in range(n)})
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    lengths: dict[int, int] = {}
    s, before = 0, 8
    while s < alphabet and left:
        left -= 1
        x = meta.read(bits)
        if x < 16:
            lengths[s] = x
            before = x or before
            s += 1
        elif x == 16:
            for _ in range(3 + bits.read(2)):
                lengths[s] = before
                s += 1
        else:
            s += 3 + bits.read(3) if x == 17 else 11 + bits.read(7)
    if s > alphabet:
        raise BadStream("too many code lengths")
    return Code(lengths)


def wide_value(prefix: int, bits: Bits) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def copied(out: np.ndarray, i: int, n: int, d: int) -> None:
    """n values from i on, copied from d before; they may overlap."""
    if d >= n:
        out[i : i + n] = out[i - d : i - d + n]
    else:
        out[i : i + n] = np.resize(out[i - d : i], n)


def near_or_far(d: int, width: int) -> int:
    """Distance in pixels of a distance code."""
    if d > len(NEAR):
        return d - len(NEAR)
    x, y = NEAR[d - 1]
    return max(1, x + y * width)


def read_one_code(bits: Bits, green: Code, far: Code, total: int, width: int) -> np.ndarray:
    """Green values of an image whose other codes say nothing. What would be read at every bit is looked up at once; then the chain of
    code lengths is followed, four at a time, from one back-reference to the next (where it stands still)."""
    low = bits.at >> 3
    data = np.frombuffer(bits.data, np.uint8)[low:]
    w = np.append(data, (0, 0, 0)).astype(np.uint32)
    w = w[:-3] | w[1:-2] << np.uint32(8) | w[2:-1] << np.uint32(16)
    look = ((w[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32((1 << green.width) - 1)).reshape(-1)
    end = len(look)
    step = np.where(green.symbol < LITERALS, green.size, 0)
    one = np.append(np.minimum(np.arange(end, dtype=np.int32) + step[look], end), end).astype(np.int32)  # where the next symbol begins
    two = one[one]
    four, single = memoryview(two[two]), memoryview(one)
    heads, counts, copies = [], [], []
    done, p = 0, bits.at & 7
    while True:
        n, left = 0, total - done
        while n < left:
            q = four[p]
            heads.append(p)
            if q == p:
                break
            n += 4
            p = q
        if n < left or q == single[p]:  # it stands still: how many of the last four were literals
            k, q = 0, heads[-2] if n and heads[-1] == p else heads[-1]
            while q != p and k < 4:
                q, k = single[q], k + 1
            n = n - 4 + k if n else 0
        n = min(n, left)
        counts.append((len(heads), n))
        done += n
        if done == total:
            break
        if p >= end:
            raise BadStream("it ends early")
        bits.at = (low << 3) + p
        s = green.read(bits)
        n = wide_value(s - LITERALS, bits)
        d = near_or_far(wide_value(far.read(bits), bits), width)
        if s < LITERALS or d > done or done + n > total:
            raise BadStream("a reference leaves the image")
        copies.append((n, d))
        done += n
        p = bits.at - (low << 3)
        if done == total:
            counts.append((len(heads), 0))
            break
    h = np.array(heads, np.int32)
    h2 = two[h]
    at = np.stack([h, one[h], h2, one[h2]], 1).reshape(-1) if len(h) else h
    out, i, first = np.empty(total, np.uint8), 0, 0
    values = np.append(green.symbol[look[np.minimum(at, end - 1)]], 0).astype(np.uint8)
    for k, (last, n) in enumerate(counts):
        out[i : i + n] = values[4 * first : 4 * first + n]
        if n:
            bits.at = (low << 3) + int(one[at[4 * first + n - 1]]) if k == len(counts) - 1 else bits.at
        i, first = i + n, last
        if k < len(copies):
            copied(out, i, *copies[k])
            i += copies[k][0]
    if bits.at > bits.end:
        raise BadStream("it ends early")
    return out


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """One entropy-coded image, as width * height ARGB values."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    cache = [0] * (1 << cache_bits) if cache_bits else []
    group_of, groups, tile, across = None, 1, 0, 0
    if main and bits.read(1):
        tile = bits.read(3) + 2
        across = (width + (1 << tile) - 1) >> tile
        down = (height + (1 << tile) - 1) >> tile
        group_of = (read_pixels(bits, across, down, False) >> 8 & 0xFFFF).tolist()
        groups = max(group_of) + 1
    sizes = (LITERALS + LENGTHS + len(cache), 256, 256, 256, DISTANCES)
    codes = [[read_code(bits, n) for n in sizes] for _ in range(groups)]
    total = width * height
    if groups == 1 and not cache and all(c.width == 0 for c in codes[0][1:4]) and codes[0][0].width:
        r, b, a = (int(c.symbol[0]) for c in codes[0][1:4])
        return np.uint32(a << 24 | r << 16 | b) | read_one_code(bits, codes[0][0], codes[0][4], total, width).astype(np.uint32) << np.uint32(8)
    out: list[int] = []
    code, put = codes[0], out.append
    shift = 32 - cache_bits

    def keep(p: int) -> None:
        put(p)
        if cache:
            cache[(p * CACHE_FACTOR & 0xFFFFFFFF) >> shift] = p

    while len(out) < total:
        i = len(out)
        if group_of:
            code = codes[group_of[(i // width >> tile) * across + (i % width >> tile)]]
        s = code[0].read(bits)
        if s < LITERALS:
            r, b, a = code[1].read(bits), code[2].read(bits), code[3].read(bits)
            keep(a << 24 | r << 16 | s << 8 | b)
        elif s < LITERALS + LENGTHS:
            n = wide_value(s - LITERALS, bits)
            d = near_or_far(wide_value(code[4].read(bits), bits), width)
            if d > i or i + n > total:
                raise BadStream("a reference leaves the image")
            for _ in range(n):
                keep(out[-d])
        else:
            put(cache[s - LITERALS - LENGTHS])
    return np.array(out, np.uint32)


def planes(p: np.ndarray) -> list[np.ndarray]:
    """Alpha, red, green, blue as signed numbers."""
    return [(p >> np.uint32(s) & np.uint32(255)).astype(np.int32) for s in (24, 16, 8, 0)]


def whole(a: np.ndarray, r: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a & 255) << 24 | (r & 255) << 16 | (g & 255) << 8 | b & 255).astype(np.uint32) if a.dtype == np.int64 else whole(*(x.astype(np.int64) for x in (a, r, g, b)))


def guess(mode: int, left: list, top: list, corner: list, right: list) -> list:
    """Prediction of the four channels from the neighbours."""
    mean = lambda x, y: [(p + q) >> 1 for p, q in zip(x, y, strict=True)]
    if mode == 11:
        d = sum(abs(t - c) - abs(q - c) for t, q, c in zip(top, left, corner, strict=True))
        return left if d < 0 else top
    if mode == 12:
        return [min(255, max(0, q + t - c)) for q, t, c in zip(left, top, corner, strict=True)]
    if mode == 13:
        return [min(255, max(0, m + int((m - c) / 2))) for m, c in zip(mean(left, top), corner, strict=True)]
    return [
        lambda: [255, 0, 0, 0], lambda: left, lambda: top, lambda: right, lambda: corner, lambda: mean(mean(left, right), top), lambda: mean(left, corner), lambda: mean(left, top), lambda: mean(corner, top),
        lambda: mean(top, right), lambda: mean(mean(left, corner), mean(top, right)),
    ][mode if mode < 11 else 0]()


def predicted(p: np.ndarray, modes: np.ndarray, tile: int, invert: bool) -> np.ndarray:
    """Adds (invert) or takes off the prediction of every pixel. modes: mode of each tile (rows, columns)."""
    h, w = p.shape
    if len(np.unique(modes)) == 1 and int(modes[0, 0]) in (1, 2):
        return by_neighbour(p, int(modes[0, 0]), invert)
    flat = [list(x) for x in zip(*(c.reshape(-1).tolist() for c in planes(p)), strict=True)]
    out = []
    known = out if invert else flat
    for i, px in enumerate(flat):
        y, x = divmod(i, w)
        if i == 0:
            g = [255, 0, 0, 0]
        elif y == 0:
            g = known[i - 1]
        elif x == 0:
            g = known[i - w]
        else:
            g = guess(int(modes[y >> tile, x >> tile]), known[i - 1], known[i - w], known[i - w - 1], known[i - w + 1])
        out.append([(q + k if invert else q - k) & 255 for q, k in zip(px, g, strict=True)])
    return whole(*np.array(out, np.int64).T).reshape(h, w)


def by_neighbour(p: np.ndarray, mode: int, invert: bool) -> np.ndarray:
    """predicted() where every tile predicts the left (1) or the upper (2) neighbour: differences, or running sums. The first row is
    predicted from the left and the first column from above in any case."""
    out = []
    for k, c in enumerate(planes(p)):
        edge = np.zeros_like(c[:1])
        edge[0, 0] = 255 if k == 0 else 0
        if invert:
            c = c.copy()
            c[0, 0] += edge[0, 0]
            if mode == 1:
                c[:, 0] = np.cumsum(c[:, 0])
                c = np.cumsum(c, 1)
            else:
                c[0] = np.cumsum(c[0])
                c = np.cumsum(c, 0)
        else:
            g = np.empty_like(c)
            g[0, 0], g[0, 1:], g[1:, 0] = edge[0, 0], c[0, :-1], c[:-1, 0]
            g[1:, 1:] = c[1:, :-1] if mode == 1 else c[:-1, 1:]
            c = c - g
        out.append(c.astype(np.int64))
    return whole(*out)


def cross(p: np.ndarray, multipliers: np.ndarray, tile: int, invert: bool) -> np.ndarray:
    """Cross-colour: red and blue less (or plus) their shares of green and red. multipliers: ARGB value of each tile."""
    h, w = p.shape
    m = np.repeat(np.repeat(multipliers, 1 << tile, 0), 1 << tile, 1)[:h, :w]
    signed = lambda v: (v & 255 ^ 128) - 128
    to_red, to_blue, red_to_blue = (signed(m.astype(np.int64) >> s) for s in (0, 8, 16))
    a, r, g, b = (x.astype(np.int64) for x in planes(p))
    if invert:
        r = r + (to_red * signed(g) >> 5)
        b = b + (to_blue * signed(g) >> 5) + (red_to_blue * signed(r) >> 5)
    else:
        b = b - (to_blue * signed(g) >> 5) - (red_to_blue * signed(r) >> 5)
        r = r - (to_red * signed(g) >> 5)
    return whole(a, r, g, b)


def greens(p: np.ndarray, invert: bool) -> np.ndarray:
    """Adds green to red and blue, or takes it off."""
    g = p >> np.uint32(8) & np.uint32(255)
    rb = p & np.uint32(0x00FF00FF)
    both = g << np.uint32(16) | g
    rb = (rb + both if invert else (rb | np.uint32(0x01000100)) - both) & np.uint32(0x00FF00FF)
    return p & np.uint32(0xFF00FF00) | rb


def cells(n: int) -> int:
    """Binary logarithm of the pixels that share one byte, for a palette of n colours."""
    return 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0


def decode(data: bytes) -> np.ndarray:
    """Pixels of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or len(data) < 25 or data[20] != 0x2F:
        raise BadStream("not a lossless WebP file")
    size = int.from_bytes(data[16:20], "little")
    bits = Bits(data[20 : 20 + size], 8)
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise BadStream("unknown version")
    undo, w = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind < 2:
            tile = bits.read(3) + 2
            tw, th = (w + (1 << tile) - 1) >> tile, (height + (1 << tile) - 1) >> tile
            t = read_pixels(bits, tw, th, False).reshape(th, tw)
            undo.append((lambda p, t=t, n=tile: predicted(p, t >> 8 & 15, n, True)) if kind == 0 else (lambda p, t=t, n=tile: cross(p, t, n, True)))
        elif kind == 2:
            undo.append(lambda p: greens(p, True))
        else:
            n = bits.read(8) + 1
            d = read_pixels(bits, n, 1, False)
            table = whole(*(np.cumsum(x.astype(np.int64)) for x in planes(d)))
            pack = cells(n)
            full = w
            w = (w + (1 << pack) - 1) >> pack

            def colours(p: np.ndarray, table: np.ndarray = table, pack: int = pack, full: int = full) -> np.ndarray:
                g = p >> 8 & 255
                each = 8 >> pack
                i = (g[:, :, None] >> (np.arange(1 << pack, dtype=np.uint32) * each) & ((1 << each) - 1)).reshape(len(p), -1)[:, :full]
                return np.append(table, np.zeros(256, np.uint32))[i]

            undo.append(colours)
    p = read_pixels(bits, w, height, True).reshape(height, w)
    for f in reversed(undo):
        p = f(p)
    return p


# Writing


class Writer:
    """Collects bits, lowest first."""

    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def put(self, v: int, n: int) -> None:
        self.value |= v << self.n
        self.n += n

    def bits(self) -> np.ndarray:
        return np.unpackbits(np.frombuffer(self.value.to_bytes((self.n + 7) // 8, "little"), np.uint8), bitorder="little")[: self.n]


def code_lengths(counts: dict[int, int], most: int = 15) -> dict[int, int]:
    """Lengths of a prefix code (Huffman), none over `most`: counts are flattened until that holds. One symbol gets length 1."""
    while True:
        used = sorted((c, s) for s, c in counts.items() if c)
        n = len(used)
        if n < 2:
            return {s: 1 for _, s in used}
        heap, above = [(c, i) for i, (c, _) in enumerate(used)], [0] * (2 * n - 1)
        for new in range(n, 2 * n - 1):
            a = heapq.heappop(heap)
            b = heap[0]
            above[a[1]] = above[b[1]] = new
            heapq.heapreplace(heap, (a[0] + b[0], new))
        depth = [0] * (2 * n - 1)
        for i in range(2 * n - 3, -1, -1):
            depth[i] = depth[above[i]] + 1
        if max(depth) <= most:
            return {s: depth[i] for i, (_, s) in enumerate(used)}
        counts = {s: c // 2 + 1 for c, s in used}


def write_code(w: Writer, lengths: dict[int, int], alphabet: int) -> None:
    """A prefix code: one or two small symbols simply, others by run-length coded lengths."""
    used = sorted(lengths)
    if len(used) <= 2 and max(used, default=0) < 256:
        used = used or [0]
        w.put(1, 1)
        w.put(len(used) - 1, 1)
        w.put(1, 1)
        for s in used:
            w.put(s, 8)
        return
    tokens: list[tuple[int, int, int]] = []  # symbol, extra bits, their number
    s, before, end = 0, 8, used[-1] + 1
    while s < end:
        n = lengths.get(s, 0)
        e = s + 1
        while e < end and lengths.get(e, 0) == n:
            e += 1
        run, s = e - s, e
        if n == 0:
            while run >= 3:
                k = min(run, 138)
                tokens.append((17, k - 3, 3) if k <= 10 else (18, k - 11, 7))
                run -= k
        else:
            if n != before:
                tokens.append((n, 0, 0))
                run -= 1
                before = n
            while run >= 3:
                k = min(run, 6)
                tokens.append((16, k - 3, 2))
                run -= k
        tokens += [(n, 0, 0)] * run
    counts: dict[int, int] = {}
    for t, _, _ in tokens:
        counts[t] = counts.get(t, 0) + 1
    meta = code_lengths(counts, 7)
    n = max(4, 1 + max(i for i, x in enumerate(LENGTH_ORDER) if meta.get(x)))
    w.put(0, 1)
    w.put(n - 4, 4)
    for x in LENGTH_ORDER[:n]:
        w.put(meta.get(x, 0), 3)
    codes = canonical(meta) if len(meta) > 1 else {next(iter(meta)): 0}
    if end < alphabet and len(tokens) >= 2:  # the rest have length 0
        wide = next(k for k in range(2, 18, 2) if len(tokens) - 2 < 1 << k)
        w.put(1, 1)
        w.put((wide - 2) // 2, 3)
        w.put(len(tokens) - 2, wide)
    else:
        w.put(0, 1)
    for t, x, k in tokens:
        w.put(codes[t], meta[t] if len(meta) > 1 else 0)
        w.put(x, k)


def riff(bits: np.ndarray) -> bytes:
    body = b"\x2f" + np.packbits(bits, bitorder="little").tobytes()
    pad = b"\0" * (len(body) & 1)
    return b"RIFF" + (12 + len(body) + len(pad)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body + pad


#: Shortest back-reference of gray(), and bytes that must be equal for one to be looked at.
SHORTEST, WINDOW = 12, 8
LONGEST = 4096
_near: dict[int, dict[int, int]] = {}


def distance_code(d: int, width: int) -> int:
    """The distance code of so many pixels: that of a near place where there is one."""
    if width not in _near:
        _near[width] = {max(1, x + y * width): i + 1 for i, (x, y) in reversed(list(enumerate(NEAR)))}
    return _near[width].get(d, d + len(NEAR))


def references(flat: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, distance) of stretches that repeat what stands before, from left to right, without overlap. Windows of equal hash
    are brought side by side by one sort; places that follow each other at one distance are one stretch."""
    n = len(flat) - WINDOW + 1
    if n < 2:
        return []
    a = flat.astype(np.uint64)
    b = a[:-1] | a[1:] << np.uint64(8)
    c = b[:-2] | b[2:] << np.uint64(16)
    h = (c[:-4] | c[4:] << np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24) << np.uint64(24)
    h |= np.arange(n, dtype=np.uint64)  # images have fewer than 2 ** 24 pixels
    h.sort()
    at = (h & np.uint64(0xFFFFFF)).astype(np.int64)
    same = h[1:] >> np.uint64(24) == h[:-1] >> np.uint64(24)
    back = np.zeros(n, np.int64)
    back[at[1:][same]] = (at[1:] - at[:-1])[same]
    cut = np.flatnonzero(np.append(True, back[1:] != back[:-1]))
    size = np.diff(np.append(cut, n)) + WINDOW - 1
    use = (back[cut] > 0) & (size >= SHORTEST)
    raw, end, out = flat.tobytes(), 0, []
    for i, m, d in zip(cut[use].tolist(), size[use].tolist(), back[cut[use]].tolist(), strict=True):
        i, stop = max(i, end), i + m
        if stop - i < SHORTEST or raw[i:stop] != raw[i - d : stop - d]:
            continue
        while i < stop:
            m = min(LONGEST, stop - i)
            if m >= 3:
                out.append((i, m, d))
                end = i + m
            i += m
    return out


def cost(flat: np.ndarray) -> float:
    """Bits that a prefix code of these values takes, about."""
    n = np.bincount(flat, minlength=256)
    n = n[n > 0]
    return float((n * (np.log2(len(flat)) - np.log2(n))).sum())


def write_gray(out: Writer, samples: np.ndarray, alpha: int) -> np.ndarray:
    """Bits of an image of one channel (green; red and blue are 0): one prefix code of samples and back-references."""
    flat, w = samples.reshape(-1), samples.shape[1]
    copies = references(flat)
    start, length, distance = (np.array(x, np.int64) for x in zip(*copies, strict=True)) if copies else (np.zeros(0, np.int64),) * 3
    literal = np.ones(len(flat) + 1, np.int64)
    edge = np.zeros(len(flat) + 1, np.int64)
    edge[start] += 1
    np.subtract.at(edge, start + length, 1)
    literal = (np.cumsum(edge) == 0)[:-1]
    hist = np.bincount(flat[literal], minlength=256)
    counts = {int(s): int(hist[s]) for s in np.flatnonzero(hist)}
    sizes = [prefix_of(m) for m in length.tolist()]
    ways = [prefix_of(distance_code(d, w)) for d in distance.tolist()]
    far: dict[int, int] = {}
    for a, b in zip(sizes, ways, strict=True):
        counts[LITERALS + a[0]] = counts.get(LITERALS + a[0], 0) + 1
        far[b[0]] = far.get(b[0], 0) + 1
    lengths, far_lengths = code_lengths(counts), code_lengths(far)
    if len(lengths) == 1 and max(lengths) >= 256:  # has no simple form
        lengths = {0: 1, max(lengths): 1}
    for v in (0, 0, 0):  # no more transforms, no cache, no groups
        out.put(v, 1)
    write_code(out, lengths, LITERALS + LENGTHS)
    for s in (0, 0, alpha):
        write_code(out, {s: 1}, 256)
    write_code(out, far_lengths, DISTANCES)
    size, code = np.zeros(LITERALS + LENGTHS, np.int64), np.zeros(LITERALS + LENGTHS, np.uint32)
    for s, c in (canonical(lengths) if len(lengths) > 1 else {}).items():
        size[s], code[s] = lengths[s], c
    far_codes = canonical(far_lengths) if len(far_lengths) > 1 else dict.fromkeys(far_lengths, 0)
    plain = flat[literal]
    n, c = size[plain], code[plain]
    if copies:
        parts = []  # code and extra bits of the length, then of the distance
        for a, b in zip(sizes, ways, strict=True):
            k = LITERALS + a[0]
            parts += [(int(code[k]), int(size[k])), a[1:], (far_codes[b[0]], far_lengths[b[0]] if len(far_lengths) > 1 else 0), b[1:]]
        place = np.repeat(np.cumsum(literal)[start], 4)  # after so many literals
        n, c = np.insert(n, place, [x[1] for x in parts]), np.insert(c, place, np.array([x[0] for x in parts], np.uint32))
    end = np.cumsum(n)
    begin = end - n
    bits = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    if copies:
        some = n > 0
        begin, c, n = begin[some], c[some], n[some]
    for k in range(int(n.max()) if len(n) else 0):
        if k >= 1:
            more = n > k
            begin, c, n = begin[more], c[more], n[more]
        bits[begin + k] = c >> np.uint32(k) & np.uint32(1)
    return np.concatenate([out.bits(), bits])


def gray(samples: np.ndarray) -> bytes:
    """A file of 8-bit gray samples (height, width). Up to 16 different ones become a palette with several pixels in a byte; else a
    predictor of the left or upper neighbour is taken where it is cheaper, and green is taken off red and blue, so that one code remains."""
    h, w = samples.shape
    out = Writer()
    for v, n in ((w - 1, 14), (h - 1, 14), (0, 4)):
        out.put(v, n)
    values = np.flatnonzero(np.bincount(samples.reshape(-1), minlength=256))
    if len(values) <= 16:
        pack = cells(len(values))
        out.put(1, 1)
        out.put(3, 2)
        out.put(len(values) - 1, 8)
        table = values.astype(np.uint32) * np.uint32(0x010101) | np.uint32(0xFF000000)
        write_pixels(out, whole(*(np.diff(x.astype(np.int64), prepend=0) for x in planes(table))).reshape(1, -1), False)
        index = np.zeros((h, ((w + (1 << pack) - 1) >> pack) << pack), np.uint8)
        index[:, :w] = np.searchsorted(values, samples)
        parts = index.reshape(h, -1, 1 << pack) << (np.arange(1 << pack, dtype=np.uint8) * np.uint8(8 >> pack))
        return riff(write_gray(out, np.bitwise_or.reduce(parts, 2), 255))
    alpha = 255
    if h > 1:
        left, above = samples.copy(), samples.copy()
        left[:, 1:] -= samples[:, :-1]
        left[1:, 0] -= samples[:-1, 0]
        above[1:] -= samples[:-1]
        above[0, 1:] -= samples[0, :-1]
        price, mode = min((cost(x.reshape(-1)), i) for i, x in enumerate((samples, left, above)))
        if mode and price + 64 < cost(samples.reshape(-1)):
            for v, n in ((1, 1), (0, 2), (7, 3)):  # tiles of 512 pixels a side
                out.put(v, n)
            modes = np.full(((h + 511) >> 9, (w + 511) >> 9), mode << 8 | 0xFF000000, np.uint32)
            write_pixels(out, modes, False)
            samples, alpha = (left, above)[mode - 1], 0
    out.put(1, 1)
    out.put(2, 2)
    return riff(write_gray(out, samples, alpha))


def ungray(data: bytes) -> np.ndarray:
    """Samples of a gray image: its green channel."""
    return (decode(data) >> np.uint32(8) & np.uint32(255)).astype(np.uint8)


def prefix_of(v: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits and their number, for a length or distance v >= 1."""
    if v <= 4:
        return v - 1, 0, 0
    v -= 1
    extra = v.bit_length() - 2
    return 2 * extra + 2 + (v >> extra & 1), v & ((1 << extra) - 1), extra


def write_pixels(out: Writer, p: np.ndarray, main: bool, cache_bits: int = 0, groups: int = 1) -> None:
    """An entropy-coded image with back-references and, if asked for, a colour cache, and tiles of 4 pixels a side in several groups of
    codes by turns."""
    w = p.shape[1]
    flat = p.reshape(-1).tolist()
    near = {max(1, x + y * w): i + 1 for i, (x, y) in reversed(list(enumerate(NEAR)))}
    cache: dict[int, int] = {}
    tokens: list[list[tuple[int, int, int, int]]] = []  # (code, symbol, extra, bits)
    group: list[int] = []
    across = (w + 3) >> 2
    groups = min(groups, across * ((p.shape[0] + 3) >> 2))
    seen: dict[tuple, int] = {}

    def keep(i: int) -> None:
        if cache_bits:
            cache[(flat[i] * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits)] = flat[i]
        if i >= 2:
            seen[flat[i - 2], flat[i - 1], flat[i]] = i - 2

    i = 0
    while i < len(flat):
        j = seen.get(tuple(flat[i : i + 3]))
        n = 0
        if j is not None:
            while i + n < len(flat) and n < 4096 and flat[j + n] == flat[i + n]:
                n += 1
        v = flat[i]
        group.append(((i // w >> 2) * across + (i % w >> 2)) % groups)
        slot = (v * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        if n >= 3:
            a, b = prefix_of(n), prefix_of(near.get(i - j, i - j + len(NEAR)))
            tokens.append([(0, LITERALS + a[0], *a[1:]), (4, *b)])
            for k in range(n):
                keep(i + k)
            i += n
            continue
        if cache_bits and cache.get(slot) == v:
            tokens.append([(0, LITERALS + LENGTHS + slot, 0, 0)])
        else:
            tokens.append([(0, v >> 8 & 255, 0, 0), (1, v >> 16 & 255, 0, 0), (2, v & 255, 0, 0), (3, v >> 24, 0, 0)])
        keep(i)
        i += 1
    out.put(1, 1) if cache_bits else out.put(0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(int(groups > 1), 1)
        if groups > 1:
            out.put(0, 3)
            tiles = np.arange(across * ((p.shape[0] + 3) >> 2), dtype=np.uint32) % np.uint32(groups)
            write_pixels(out, (tiles << np.uint32(8) | np.uint32(0xFF000000)).reshape(-1, across), False)
    codes = []
    for g in range(groups):
        mine = [t for t, k in zip(tokens, group, strict=True) if k == g]
        for k, alphabet in enumerate((LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)):
            counts: dict[int, int] = {}
            for t in mine:
                for x in t:
                    if x[0] == k:
                        counts[x[1]] = counts.get(x[1], 0) + 1
            lengths = code_lengths(counts) if counts else {}
            if len(lengths) == 1 and max(lengths) >= 256:  # has no simple form; give it a neighbour
                lengths = {0: 1, max(lengths): 1}
            write_code(out, lengths, alphabet)
            codes.append((lengths, canonical(lengths) if len(lengths) > 1 else dict.fromkeys(lengths, 0)))
    for t, g in zip(tokens, group, strict=True):
        for k, s, x, n in t:
            lengths, code = codes[5 * g + k]
            out.put(code[s], lengths[s] if len(lengths) > 1 else 0)
            out.put(x, n)


def encode(p: np.ndarray, predictor: int | None = None, multipliers: int | None = None, green: bool = False, palette: bool = False, cache_bits: int = 0, tile: int = 2, groups: int = 1) -> bytes:
    """A file of ARGB pixels with the transforms asked for: a palette (at most 256 colours), one predictor mode, one set of cross-colour
    multipliers, green off red and blue."""
    h, w = p.shape
    out = Writer()
    for v, n in ((w - 1, 14), (h - 1, 14), (1, 1), (0, 3)):
        out.put(v, n)
    if palette:
        table, index = np.unique(p.reshape(-1), return_inverse=True)
        n, pack = len(table), cells(len(table))
        out.put(1, 1)
        out.put(3, 2)
        out.put(n - 1, 8)
        write_pixels(out, whole(*(np.diff(x.astype(np.int64), prepend=0) for x in planes(table))).reshape(1, -1), False)
        full = np.zeros((h, ((w + (1 << pack) - 1) >> pack) << pack), np.uint32)
        full[:, :w] = index.reshape(h, w)
        parts = full.reshape(h, -1, 1 << pack) << (np.arange(1 << pack, dtype=np.uint32) * (8 >> pack))
        p = np.bitwise_or.reduce(parts, 2).astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000)
        h, w = p.shape
    th, tw = (h + (1 << tile) - 1) >> tile, (w + (1 << tile) - 1) >> tile
    if predictor is not None:
        for v, n in ((1, 1), (0, 2), (tile - 2, 3)):
            out.put(v, n)
        modes = np.full((th, tw), predictor, np.uint32)
        write_pixels(out, modes << np.uint32(8) | np.uint32(0xFF000000), False)
        p = predicted(p, modes, tile, False)
    if multipliers is not None:
        for v, n in ((1, 1), (1, 2), (tile - 2, 3)):
            out.put(v, n)
        m = np.full((th, tw), multipliers, np.uint32)
        write_pixels(out, m, False)
        p = cross(p, m, tile, False)
    if green:
        out.put(1, 1)
        out.put(2, 2)
        p = greens(p, False)
    out.put(0, 1)
    write_pixels(out, p, True, cache_bits, groups)
    return riff(out.bits())

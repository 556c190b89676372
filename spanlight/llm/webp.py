"""Lossless WebP (the VP8L bit stream in a RIFF file): a decoder of all of its tools, and an encoder for 8-bit samples.

Decoder: prefix codes (simple and normal, meta codes by block), back-references with the two-dimensional distance codes, the
colour cache; the predictor, cross-colour, subtract-green and colour-indexing transforms are inverted in reverse order.
Encoder: samples are indices into a palette of the values that occur, bundled where it has 16 colours or fewer, and
written with one prefix code of at most ``LIMIT`` bits.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

LIMIT = 12
WIDTH, MOST_ROWS = 192, 16384
#: Bits of a stream that are looked at together, and how often their steps are joined pairwise.
PIECE, DOUBLINGS = 1 << 18, 4
# Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LENGTHS, DISTANCES = 24, 40
CACHE_FACTOR = 0x1E35A7BD
#: Offsets (x, y) of short distance codes: by distance, then from the farthest row, right before left.
NEAR = sorted([(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0], key=lambda p: (p[0] ** 2 + p[1] ** 2, -p[1], -p[0]))


class Bits:
    """Reads bits from the lowest of each byte on; beyond the end they are 0."""

    def __init__(self, data: bytes):
        self.n = len(data)
        padded = np.frombuffer(data + bytes(8), np.uint8)
        self.array = np.ascontiguousarray(np.ndarray(self.n + 5, "<u4", padded, strides=(1,)))
        self.words = memoryview(self.array)
        self.at = 0

    def read(self, n: int) -> int:
        if n > 16:
            return self.read(16) | self.read(n - 16) << 16
        at = self.at
        if at >> 3 > self.n:
            raise ValueError("the stream ends too early")
        self.at = at + n
        return self.words[at >> 3] >> (at & 7) & (1 << n) - 1


def _reversed_bits(n: int) -> np.ndarray:
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate([out * 2, out * 2 + 1])
    return out


#: Of 15 bits, by value.
REVERSED = _reversed_bits(15).tolist()


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order in which their bits are read, by symbol."""
    used = np.flatnonzero(lengths).tolist()
    codes, code, before, found = np.zeros(len(lengths), np.int64), 0, 0, []
    order = sorted(zip(lengths[used].tolist(), used))
    for n, _ in order:
        code <<= n - before
        before = n
        found.append(REVERSED[code] >> 15 - n)
        code += 1
    codes[[s for _, s in order]] = found
    return codes


class Code:
    """A prefix code as a table by the next ``bits`` bits, or its only symbol, which takes none."""

    def __init__(self, lengths: np.ndarray | None = None, only: int | None = None):
        self.only, self.bits, self.last, self.pairs = only, 0, only, None
        if only is not None:
            return
        used = np.flatnonzero(lengths).tolist()
        if len(used) < 2:
            self.only = self.last = used[0] if used else 0
            return
        self.last, self.bits = used[-1], int(lengths.max())
        widths = lengths[used].tolist()
        if sum(1 << self.bits - n for n in widths) != 1 << self.bits:
            raise ValueError("not a complete prefix code")
        self.symbol, self.length = np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits, np.int64)
        for s, n, code in zip(used, widths, canonical(lengths)[used].tolist()):
            self.symbol[code :: 1 << n] = s
            self.length[code :: 1 << n] = n

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        if self.pairs is None:
            self.pairs = self.symbol.tolist(), self.length.tolist()
        at = bits.at
        if at >> 3 > bits.n:
            raise ValueError("the stream ends too early")
        x = bits.words[at >> 3] >> (at & 7) & (1 << self.bits) - 1
        bits.at = at + self.pairs[1][x]
        return self.pairs[0][x]

    def read_many(self, bits: Bits, n: int) -> np.ndarray:
        """The next n symbols. For all bits of a piece of the stream at once: where a code that starts there would end, and, by joining these steps
        pairwise, where ``1 << DOUBLINGS`` codes would; only the chain of the long steps is sequential."""
        if self.only is not None:
            return np.full(n, self.only, np.int32)
        lengths, out = self.length.astype(np.int32), []
        while n > 0:
            span = min(8 * bits.n - bits.at, n * self.bits, PIECE)
            if span <= 0:
                raise ValueError("the stream ends too early")
            first = bits.at >> 3
            window = (bits.array[first : (bits.at + span + 7 >> 3), None] >> np.arange(8, dtype=np.uint32) & np.uint32((1 << self.bits) - 1)).ravel()[bits.at & 7 :][:span]
            step = np.append(np.minimum(np.arange(span, dtype=np.int32) + lengths[window], span), np.int32(span))
            leap = step
            for _ in range(DOUBLINGS):
                leap = leap[leap]
            at, starts, far = 0, [], memoryview(leap)
            while at < span:
                starts.append(at)
                at = far[at]
            places = [np.array(starts, np.int32)]
            for _ in range((1 << DOUBLINGS) - 1):
                places.append(step[places[-1]])
            place = np.stack(places, 1).ravel()
            place = place[: min(n, int(np.searchsorted(place, span)))]
            out.append(self.symbol[window[place]])
            n -= len(place)
            bits.at += int(place[-1]) + int(lengths[window[place[-1]]])
        if bits.at > 8 * bits.n:
            raise ValueError("the stream ends too early")
        return np.concatenate(out) if out else np.zeros(0, np.int32)


def read_code(bits: Bits, size: int) -> Code:
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        if not two:
            return Code(only=first)
        lengths = np.zeros(max(size, 256), np.int64)
        lengths[[first, bits.read(8)]] = 1
        return Code(lengths)
    of_lengths = np.zeros(19, np.int64)
    for k in LENGTH_ORDER[: 4 + bits.read(4)]:
        of_lengths[k] = bits.read(3)
    code = Code(of_lengths)
    most = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    lengths, before = [], 8
    while len(lengths) < size and most:
        most -= 1
        s = code.read(bits)
        if s < 16:
            lengths.append(s)
            before = s or before
        elif s == 16:
            lengths += [before] * (3 + bits.read(2))
        else:
            lengths += [0] * (3 + bits.read(3) if s == 17 else 11 + bits.read(7))
    if len(lengths) > size:
        raise ValueError("too many code lengths")
    return Code(np.array(lengths + [0] * (size - len(lengths)), np.int64))


def extended(bits: Bits, prefix: int) -> int:
    """The length or distance of a prefix symbol and its extra bits."""
    if prefix < 4:
        return prefix + 1
    extra = prefix - 2 >> 1
    return (2 + (prefix & 1) << extra) + bits.read(extra) + 1


def read_pixels(bits: Bits, width: int, height: int, outer: bool) -> np.ndarray:
    """An entropy-coded image as ARGB values, row by row."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    block, groups_of, n_groups = 0, None, 1
    if outer and bits.read(1):
        block = bits.read(3) + 2
        across = (width + (1 << block) - 1) >> block
        groups_of = (read_pixels(bits, across, (height + (1 << block) - 1) >> block, False) >> 8 & 0xFFFF).astype(np.int64)
        n_groups = int(groups_of.max()) + 1
    sizes = (256 + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    groups = [[read_code(bits, n) for n in sizes] for _ in range(n_groups)]
    n = width * height
    green, red, blue, alpha, _ = groups[0]
    if n_groups == 1 and not cache_bits and red.only is not None and blue.only is not None and alpha.only is not None and green.last < 256:
        rest = np.uint32(alpha.only << 24 | red.only << 16 | blue.only)
        return green.read_many(bits, n).astype(np.uint32) << np.uint32(8) | rest
    out, cache, filled, i = [0] * n, [0] * (1 << cache_bits), 0, 0
    while i < n:
        if groups_of is not None:
            green, red, blue, alpha, distance = groups[groups_of[(i // width >> block) * across + (i % width >> block)]]
        else:
            distance = groups[0][4]
        s = green.read(bits)
        if s < 256:
            r = red.read(bits)
            b = blue.read(bits)
            out[i] = alpha.read(bits) << 24 | r << 16 | s << 8 | b
            i += 1
        elif s < 256 + LENGTHS:
            length = extended(bits, s - 256)
            d = extended(bits, distance.read(bits))
            if d > len(NEAR):
                d -= len(NEAR)
            else:
                x, y = NEAR[d - 1]
                d = max(1, x + y * width)
            if d > i or i + length > n:
                raise ValueError("a back-reference leaves the image")
            for j in range(i, i + length):
                out[j] = out[j - d]
            i += length
        else:
            while filled < i:
                cache[CACHE_FACTOR * out[filled] % (1 << 32) >> 32 - cache_bits] = out[filled]
                filled += 1
            out[i] = cache[s - 256 - LENGTHS]
            i += 1
    return np.array(out, np.uint32)


def channels(argb: np.ndarray, height: int, width: int) -> np.ndarray:
    """(height, width, 4) of A, R, G, B."""
    return argb.astype(">u4").view(np.uint8).reshape(height, width, 4).astype(np.int64)


def _average(a, b):
    return a + b >> 1


def predicted(mode: int, left, top, top_left, top_right):
    if mode == 0:
        return np.array([255, 0, 0, 0])
    if mode < 5:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return _average(_average(left, top_right), top)
    if mode < 10:
        return _average(*((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6])
    if mode == 10:
        return _average(_average(left, top_left), _average(top, top_right))
    if mode == 11:
        return left if np.abs(top - top_left).sum() < np.abs(left - top_left).sum() else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    middle = _average(left, top)
    step = middle - top_left
    return np.clip(middle + np.where(step < 0, -(-step >> 1), step >> 1), 0, 255)


def undo_predictor(image: np.ndarray, modes: np.ndarray, block: int) -> np.ndarray:
    height, width, _ = image.shape
    for y in range(height):
        for x in range(width):
            if not y:
                guess = image[0, x - 1] if x else np.array([255, 0, 0, 0])
            elif not x:
                guess = image[y - 1, 0]
            else:
                right = image[y - 1, x + 1] if x + 1 < width else image[y, 0]
                guess = predicted(min(int(modes[y >> block, x >> block]), 14) % 14, image[y, x - 1], image[y - 1, x], image[y - 1, x - 1], right)
            image[y, x] = image[y, x] + guess & 255
    return image


def undo_cross_colour(image: np.ndarray, element: np.ndarray, block: int) -> np.ndarray:
    height, width, _ = image.shape
    e = element[np.arange(height)[:, None] >> block, np.arange(width)[None, :] >> block]
    signed = lambda v: (v + 128 & 255) - 128
    part = lambda t, c: signed(t) * signed(c) >> 5
    red = image[..., 1] + part(e[..., 3], image[..., 2]) & 255
    blue = image[..., 3] + part(e[..., 2], image[..., 2]) & 255
    image[..., 1], image[..., 3] = red, blue + part(e[..., 1], red) & 255
    return image


def bundle_bits(colours: int) -> int:
    """log2 of the pixels that share one value."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def coloured(index: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    """The palette's colours of indices, which are unpacked if several share a value; an index beyond the palette is transparent black."""
    shift = bundle_bits(len(palette))
    if shift:
        each = 8 >> shift
        index = (index.astype(np.int64)[..., None] >> each * np.arange(1 << shift) & (1 << each) - 1).reshape(len(index), -1)[:, :width]
    return np.vstack([palette, np.zeros((256, 4), np.int64)]).astype(np.uint8)[index]


def decode(file: bytes) -> np.ndarray:
    """A WebP file of one lossless image -> (height, width, 4) of R, G, B, A samples."""
    if file[:4] != b"RIFF" or file[8:12] != b"WEBP":
        raise ValueError("no WebP file")
    at = 12
    while file[at : at + 4] != b"VP8L":
        if at + 8 > len(file):
            raise ValueError("no lossless image")
        at += 8 + (struct.unpack_from("<I", file, at + 4)[0] + 1 & ~1)
    size = struct.unpack_from("<I", file, at + 4)[0]
    data = file[at + 8 : at + 8 + size]
    if len(data) < size or data[:1] != b"\x2f":
        raise ValueError("the image is cut short or has no signature")
    bits = Bits(data)
    bits.at = 8
    width, height, with_alpha = bits.read(14) + 1, bits.read(14) + 1, bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    transforms, across = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (t[0] for t in transforms):
            raise ValueError("a transform comes twice")
        if kind < 2:
            block = bits.read(3) + 2
            h, w = (height + (1 << block) - 1) >> block, (across + (1 << block) - 1) >> block
            transforms.append((kind, channels(read_pixels(bits, w, h, False), h, w), block))
        elif kind == 2:
            transforms.append((kind, None, 0))
        else:
            n = bits.read(8) + 1
            palette = np.cumsum(channels(read_pixels(bits, n, 1, False), 1, n)[0], axis=0) & 255
            transforms.append((kind, palette, across))
            across = (across + (1 << bundle_bits(n)) - 1) >> bundle_bits(n)
    argb = read_pixels(bits, across, height, True)
    if transforms and transforms[-1][0] == 3:
        _, palette, wide = transforms.pop()
        image, across = coloured((argb >> np.uint32(8) & np.uint32(255)).reshape(height, across), palette, wide), wide
    else:
        image = channels(argb, height, across)
    for kind, what, extra in reversed(transforms):
        if kind == 0:
            image = undo_predictor(image.astype(np.int64), what[..., 2], extra)
        elif kind == 1:
            image = undo_cross_colour(image.astype(np.int64), what, extra)
        elif kind == 2:
            image = image.astype(np.int64)
            image[..., 1] = image[..., 1] + image[..., 2] & 255
            image[..., 3] = image[..., 3] + image[..., 2] & 255
        else:
            image = coloured(image[..., 2], what, extra)
    out = image[..., [1, 2, 3, 0]].astype(np.uint8)
    if not with_alpha:
        out[..., 3] = 255
    return out


class Writer:
    """Gathers bits from the lowest on."""

    def __init__(self):
        self.value, self.n = 0, 0

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of a Huffman code of the symbols that occur; counts are halved until no code is longer than the limit."""
    used = np.flatnonzero(counts).tolist()
    lengths = np.zeros(len(counts), np.int64)
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    weights = counts[used].tolist()
    while True:
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        up, n = [0] * (2 * len(used)), len(used)
        while len(heap) > 1:
            a, i = heapq.heappop(heap)
            b, j = heap[0]
            up[i] = up[j] = n
            heapq.heapreplace(heap, (a + b, n))
            n += 1
        depth = [0] * n
        for i in range(n - 2, -1, -1):
            depth[i] = depth[up[i]] + 1
        if max(depth) <= limit:
            lengths[used] = depth[: len(used)]
            return lengths
        weights = [w + 1 >> 1 for w in weights]


def write_code(out: Writer, lengths: np.ndarray) -> np.ndarray:
    """Writes a code's lengths; returns the codes (of no bits where one symbol is all)."""
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 2 and (not used or used[-1] < 256):
        first = used[0] if used else 0
        wide = first > 1
        out.write(1, 1)
        out.write(max(len(used), 1) - 1, 1)
        out.write(wide, 1)
        out.write(first, 8 if wide else 1)
        if len(used) == 2:
            out.write(used[1], 8)
            lengths[used] = 1
        else:
            lengths[used] = 0
        return canonical(lengths)
    tokens, i, values = [], 0, lengths[: used[-1] + 1].tolist()
    while i < len(values):
        run = 1
        while i + run < len(values) and values[i + run] == values[i] and run < 138:
            run += 1
        if values[i] == 0 and run >= 3:
            tokens.append((18, run - 11, 7) if run > 10 else (17, run - 3, 3))
        else:
            run = 1
            tokens.append((values[i], 0, 0))
        i += run
    of_tokens = code_lengths(np.bincount([t for t, _, _ in tokens], minlength=19), 7)
    if np.count_nonzero(of_tokens) == 1:
        of_tokens[0 if not of_tokens[0] else 1] = 1
    codes = canonical(of_tokens)
    order = [int(of_tokens[k]) for k in LENGTH_ORDER]
    while len(order) > 4 and not order[-1]:
        order.pop()
    out.write(0, 1)
    out.write(len(order) - 4, 4)
    for n in order:
        out.write(n, 3)
    width = max(2, (len(tokens) - 2).bit_length() + 1 & ~1)
    out.write(1, 1)
    out.write(width - 2 >> 1, 3)
    out.write(len(tokens) - 2, width)
    codes, of_tokens = codes.tolist(), of_tokens.tolist()
    for t, extra, n in tokens:
        out.write(codes[t], of_tokens[t])
        out.write(extra, n)
    return canonical(lengths)


def write_nothing(out: Writer, *symbols: int) -> None:
    """Codes of one symbol each, for channels that don't vary."""
    for s in symbols:
        out.write(1 | (s > 1) << 2 | s << 3, 11 if s > 1 else 4)


def packed(out: Writer, codes: np.ndarray, lengths: np.ndarray, symbols: np.ndarray) -> bytes:
    """What the writer holds, followed by the codes of the symbols."""
    n = lengths[symbols]
    places = out.n + np.cumsum(n) - n
    words = places >> 5
    shifted = codes.astype(np.uint64)[symbols] << (places & 31).astype(np.uint64)
    end = out.n + int(n.sum())
    stream = np.zeros((end >> 5) + 3, np.uint64)
    head = np.frombuffer(out.value.to_bytes((out.n + 31 >> 5) * 4 + 4, "little"), "<u4")
    stream[: len(head)] += head[: len(stream)]
    if len(symbols):
        starts = np.flatnonzero(np.diff(words, prepend=-1))
        stream[words[starts]] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), starts)
        stream[words[starts] + 1] += np.add.reduceat(shifted >> np.uint64(32), starts)
    return stream.astype("<u4").tobytes()[: end + 7 >> 3]


def encode(samples: np.ndarray, width: int = WIDTH) -> bytes:
    """8-bit samples, a multiple of width, as the green channel of an image of that width."""
    values = np.flatnonzero(np.bincount(samples, minlength=256))
    index = np.zeros(256, np.int64)
    index[values] = np.arange(len(values))
    symbols, shift = index[samples], bundle_bits(len(values))
    if shift:
        each = 8 >> shift
        symbols = (symbols.reshape(-1, 1 << shift) << each * np.arange(1 << shift)).sum(1)
    out = Writer()
    out.write(0x2F, 8)
    out.write(width - 1, 14)
    out.write(len(samples) // width - 1, 14)
    out.write(0, 4)
    out.write(1, 1)
    out.write(3, 2)
    out.write(len(values) - 1, 8)
    steps = np.diff(values, prepend=0)
    out.write(0, 1)
    lengths = code_lengths(np.bincount(steps, minlength=256 + LENGTHS), 8)
    codes = write_code(out, lengths)
    write_nothing(out, 0, 0)
    if len(values) > 1:
        out.write(0b11 | 255 << 4, 12)
        write_nothing(out, 0)
    else:
        write_nothing(out, 255, 0)
    codes, widths = codes.tolist(), lengths.tolist()
    for i, s in enumerate(steps.tolist()):
        out.write(codes[s], widths[s])
        if len(values) > 1:
            out.write(not i, 1)
    out.write(0, 3)
    lengths = code_lengths(np.bincount(symbols, minlength=256 + LENGTHS))
    codes = write_code(out, lengths)
    write_nothing(out, 0, 0, 255, 0)
    data = packed(out, codes, lengths, symbols)
    body = b"VP8L" + struct.pack("<I", len(data)) + data + bytes(len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body


def encode_all(samples: np.ndarray, width: int = WIDTH) -> bytes:
    """Samples of any number of rows: as many files, one after the other, as the height of an image asks for."""
    most = width * MOST_ROWS
    return b"".join(encode(samples[i : i + most], width) for i in range(0, len(samples), most))


def decode_all(files: bytes) -> list[np.ndarray]:
    images, at = [], 0
    while at < len(files):
        if at + 8 > len(files):
            raise ValueError("the file is cut short")
        end = at + 8 + struct.unpack_from("<I", files, at + 4)[0]
        images.append(decode(files[at:end]))
        at = end
    return images

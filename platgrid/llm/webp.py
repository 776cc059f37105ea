"""Media columns: lossless WebP (VP8L) to pixel arrays.

Decoded are prefix codes, also by meta image, back-references and the colour cache; then the predictor,
cross-colour, subtract-green and palette transforms are undone in reverse order.

Defined results: every row gives a row.  status is `ok`, or says why there are no pixels: `null`, `empty`, `container` (no
RIFF WEBP file with a VP8L chunk), `header`, `truncated` (the data end early), `corrupt` (codes or references that cannot be) or
`size` (more pixels than most_pixels, MOST_PIXELS by default).  Pixels are row by row, each a signed 32-bit ARGB.  Repeated rows are
decoded each; extra columns pass through in front, also those called width, height, pixels or status, which are replaced.
Empty tables give empty results.
"""

from __future__ import annotations

import heapq
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Near distances: upper four bits are rows up, 8 less the lower four are columns to the left.
NEAR = bytes.fromhex(
    "18071719280627291 61a262a38053739151b363a252b4804474 9141c353b464a242c58454b343c035759131d565a232d444c555b333d6802676 9121e666a222e545c434d656b323e78017779535d111f646c424e767a212f757b313f636d525e00747c414f1020626e30737d515f40727e616f50717f6070".replace(" ", "")
)
_CACHE_MUL = 0x1E35A7BD


class Broken(Exception):
    """Data that are no image; the message is the status."""


class _Bits:
    """Bits of bytes, lowest first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.acc, self.have = data, 0, 0, 0

    def fill(self) -> None:
        piece = self.data[self.at : self.at + 16]
        if not piece:
            raise Broken("truncated")
        self.acc |= int.from_bytes(piece, "little") << self.have
        self.have += 8 * len(piece)
        self.at += 16

    def read(self, n: int) -> int:
        while self.have < n:
            self.fill()
        out = self.acc & ((1 << n) - 1)
        self.acc >>= n
        self.have -= n
        return out

    def symbol(self, code: tuple[list[int], int]) -> int:
        table, bits = code
        if self.have < bits:
            try:
                self.fill()
            except Broken:
                pass  # a shorter code may still end within the data
        x = table[self.acc & ((1 << bits) - 1)]
        n = x & 15
        if n > self.have:
            raise Broken("truncated")
        self.acc >>= n
        self.have -= n
        return x >> 4


def code_table(lengths: list[int]) -> tuple[list[int], int]:
    """(table, bits): symbol << 4 | length for every `bits` next bits; a single symbol takes no bits."""
    used = [(n, s) for s, n in enumerate(lengths) if n]
    if not used:
        raise Broken("corrupt")
    if len(used) == 1:
        return [used[0][1] << 4], 0
    used.sort()
    bits = used[-1][0]
    if sum(1 << (bits - n) for n, _ in used) != 1 << bits:
        raise Broken("corrupt")
    table = [0] * (1 << bits)
    code, last = 0, used[0][0]
    for n, s in used:
        code <<= n - last
        last = n
        back = int(format(code, f"0{n}b")[::-1], 2)
        table[back :: 1 << n] = [s << 4 | n] * (1 << (bits - n))
        code += 1
    return table, bits


def _read_code(b: _Bits, size: int) -> tuple[list[int], int]:
    if b.read(1):
        two = b.read(1)
        symbols = [b.read(8 if b.read(1) else 1)]
        if two:
            symbols.append(b.read(8))
        lengths = [0] * size
        for s in symbols:
            if s >= size:
                raise Broken("corrupt")
            lengths[s] = 1
        return code_table(lengths)
    first = [0] * 19
    for i in range(4 + b.read(4)):
        first[_LENGTH_ORDER[i]] = b.read(3)
    left = 2 + b.read(2 + 2 * b.read(3)) if b.read(1) else size
    if left > size:
        raise Broken("corrupt")
    code = code_table(first)
    lengths: list[int] = []
    before = 8
    while len(lengths) < size and left:
        left -= 1
        n = b.symbol(code)
        if n < 16:
            lengths.append(n)
            before = n or before
        elif n == 16:
            lengths += [before] * (3 + b.read(2))
        else:
            lengths += [0] * (3 + b.read(3) if n == 17 else 11 + b.read(7))
    if len(lengths) > size:
        raise Broken("corrupt")
    return code_table(lengths + [0] * (size - len(lengths)))


def _value(b: _Bits, code: int) -> int:
    if code < 4:
        return code + 1
    more = (code - 2) >> 1
    return ((2 + (code & 1)) << more) + b.read(more) + 1


def _image(b: _Bits, width: int, height: int, main: bool) -> array:
    """Pixels of an entropy-coded image; main: it may have several groups of codes."""
    cache_bits = b.read(4) if b.read(1) else 0
    if cache_bits > 11:
        raise Broken("corrupt")
    groups, shift, meta, across = 1, 0, None, 0
    if main and b.read(1):
        shift = b.read(3) + 2
        across = -(-width >> shift)
        meta = [(p >> 8) & 0xFFFF for p in _image(b, across, -(-height >> shift), False)]
        groups = max(meta) + 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[_read_code(b, n) for n in sizes] for _ in range(groups)]
    out = array("I")  # four bytes a pixel, however few bits stand for it
    cache = [0] * (1 << cache_bits) if cache_bits else None
    cached, down, total = 0, 32 - cache_bits, width * height
    green, red, blue, alpha, far = codes[0]
    symbol = b.symbol
    while len(out) < total:
        at = len(out)
        if meta is not None:
            y, x = divmod(at, width)
            green, red, blue, alpha, far = codes[meta[(y >> shift) * across + (x >> shift)]]
        s = symbol(green)
        if s < 256:
            out.append(symbol(red) << 16 | s << 8 | symbol(blue) | symbol(alpha) << 24)
        elif s < 280:
            n = _value(b, s - 256)
            d = _value(b, symbol(far))
            if d > 120:
                d -= 120
            else:
                near = NEAR[d - 1]
                d = max(1, (near >> 4) * width + 8 - (near & 15))
            if d > at or at + n > total:
                raise Broken("corrupt")
            if d >= n:
                out += out[at - d : at - d + n]
            else:
                piece = out[at - d :]
                out += (piece * (n // d + 1))[:n]
        else:
            # the cache holds all pixels before this one
            for p in out[cached:]:
                cache[(p * _CACHE_MUL & 0xFFFFFFFF) >> down] = p
            cached = at
            out.append(cache[s - 280])
    return out


def _average(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _parts(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _clamp(x: int) -> int:
    return 0 if x < 0 else 255 if x > 255 else x


def _join(parts: list[int]) -> int:
    return parts[0] << 24 | parts[1] << 16 | parts[2] << 8 | parts[3]


def predict(mode: int, left: int, top: int, corner: int, right: int) -> int:
    """The predicted pixel; corner is above left, right is above right."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return _average(_average(left, right), top)
    if mode == 6:
        return _average(left, corner)
    if mode == 7:
        return _average(left, top)
    if mode == 8:
        return _average(corner, top)
    if mode == 9:
        return _average(top, right)
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    if mode == 11:
        a, b, c = _parts(left), _parts(top), _parts(corner)
        to_left, to_top = sum(abs(y - z) for y, z in zip(b, c)), sum(abs(x - z) for x, z in zip(a, c))
        return left if to_left < to_top else top
    if mode == 12:
        return _join([_clamp(x + y - z) for x, y, z in zip(_parts(left), _parts(top), _parts(corner))])
    if mode == 13:
        return _join([_clamp(m + int((m - z) / 2)) for m, z in zip(_parts(_average(left, top)), _parts(corner))])
    return 0xFF000000


def _undo_predictor(p: list[int], width: int, height: int, shift: int, modes: list[int]) -> list[int]:
    across = -(-width >> shift)
    out = [0] * len(p)
    at = 0
    for y in range(height):
        row = (y >> shift) * across
        for x in range(width):
            if y == 0:
                guess = out[at - 1] if x else 0xFF000000
            elif x == 0:
                guess = out[at - width]
            else:
                up = at - width
                # above right of the last column is the first pixel of this row
                guess = predict(modes[row + (x >> shift)] >> 8 & 15, out[at - 1], out[up], out[up - 1], out[up + 1])
            r = p[at]
            out[at] = ((r & 0xFF00FF00) + (guess & 0xFF00FF00)) & 0xFF00FF00 | ((r & 0xFF00FF) + (guess & 0xFF00FF)) & 0xFF00FF
            at += 1
    return out


def _spread(p: np.ndarray, width: int, height: int, shift: int) -> np.ndarray:
    """The element of a sub-resolution image for every pixel."""
    across = -(-width >> shift)
    return p[(np.arange(height) >> shift)[:, None] * across + (np.arange(width) >> shift)].ravel()


def _signed8(x: np.ndarray) -> np.ndarray:
    return ((x & 255) ^ 128) - 128


def cross_colour(p: np.ndarray, e: np.ndarray, sign: int) -> np.ndarray:
    """Adds (sign 1: undoes) or subtracts what green tells of red, and green and red of blue."""
    green, red, blue = _signed8(p >> 8), p >> 16 & 255, p & 255
    new_red = red + sign * (_signed8(e) * green >> 5) & 255
    true_red = new_red if sign > 0 else red
    new_blue = blue + sign * ((_signed8(e >> 8) * green >> 5) + (_signed8(e >> 16) * _signed8(true_red) >> 5)) & 255
    return (p & 0xFF00FF00) | new_red << 16 | new_blue


#: Pixels of a picture at most, unless told otherwise: a few bytes can stand for 268 million.
MOST_PIXELS = 1 << 24


def decode(data: bytes, most_pixels: int | None = MOST_PIXELS) -> tuple[int, int, np.ndarray]:
    """(width, height, pixels as uint32 ARGB); raises Broken."""
    if len(data) < 20 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise Broken("container")
    at, body = 12, None
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"VP8L":
            body = data[at + 8 : at + 8 + size]
            break
        at += 8 + size + (size & 1)
    if body is None:
        raise Broken("container")
    b = _Bits(body)
    if b.read(8) != 0x2F:
        raise Broken("header")
    width, height = b.read(14) + 1, b.read(14) + 1
    b.read(1)
    if b.read(3):
        raise Broken("header")
    if most_pixels is not None and width * height > most_pixels:
        raise Broken("size")
    undo, across, seen = [], width, set()
    while b.read(1):
        kind = b.read(2)
        if kind in seen:
            raise Broken("corrupt")
        seen.add(kind)
        if kind < 2:
            shift = b.read(3) + 2
            undo.append((kind, across, shift, _image(b, -(-across >> shift), -(-height >> shift), False)))
        elif kind == 2:
            undo.append((kind, across, 0, None))
        else:
            n = b.read(8) + 1
            parts = np.array(_image(b, n, 1, False), np.uint32).view(np.uint8).reshape(-1, 4)
            colours = np.cumsum(parts, axis=0, dtype=np.uint8).view(np.uint32)[:, 0].astype(np.int64)
            shift = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, across, shift, colours))
            across = -(-across >> shift)
    p = np.array(_image(b, across, height, True), np.int64)
    for kind, wide, shift, more in reversed(undo):
        if kind == 0:
            p = np.array(_undo_predictor(p.tolist(), wide, height, shift, more), np.int64)
        elif kind == 1:
            p = cross_colour(p, _spread(np.array(more, np.int64), wide, height, shift), 1)
        elif kind == 2:
            g = p >> 8 & 255
            p = (p & 0xFF00FF00) | ((p >> 16 & 255) + g & 255) << 16 | ((p & 255) + g & 255)
        else:
            packed = (p >> 8 & 255).reshape(height, -1)
            x = np.arange(wide)
            bits = 8 >> shift
            index = packed[:, x >> shift] >> (bits * (x & (1 << shift) - 1)) & (1 << bits) - 1
            colours = np.concatenate([more, np.zeros(256, np.int64)])
            p = colours[index].ravel()
    return width, height, p.astype(np.uint32)


def decode_column(media: DataFrame, column: str = "webp", most_pixels: int | None = MOST_PIXELS) -> DataFrame:
    """media with width, height, pixels (array of int) and status in place of the column; one pass without a shuffle."""
    new = [("width", T.IntegerType()), ("height", T.IntegerType()), ("pixels", T.ArrayType(T.IntegerType())), ("status", T.StringType())]
    rest = [c for c in media.columns if c != column and c not in {n for n, _ in new}]
    schema = T.StructType([*[media.schema[c] for c in rest], *[T.StructField(n, k) for n, k in new]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for raw in b.column(len(rest)).to_pylist():
                try:
                    if not raw:
                        raise Broken("null" if raw is None else "empty")
                    w, h, p = decode(raw, most_pixels)
                    rows.append((w, h, p.view(np.int32), "ok"))
                except Broken as e:
                    rows.append((None, None, None, str(e)))
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.list_(pa.int32())), pa.array(cols[3], pa.string())], names=schema.names)

    return media.select(*[F.col(f"`{c}`") for c in [*rest, column]]).mapInArrow(run, schema)


# What follows writes files, for queries and tests: the tables hold no images.


class _Out:
    def __init__(self):
        self.acc, self.n = 0, 0

    def put(self, value: int, bits: int) -> None:
        self.acc |= value << self.n
        self.n += bits

    def bytes(self) -> bytes:
        return self.acc.to_bytes((self.n + 7) // 8, "little")


def _lengths(count: Counter, size: int, most: int) -> list[int]:
    """Code lengths of a Huffman code of at most `most` bits."""
    out = [0] * size
    if not count:
        out[0] = 1
        return out
    if len(count) == 1:
        out[next(iter(count))] = 1
        return out
    least = 1
    while True:
        heap = [(max(c, least), s, None) for s, c in sorted(count.items())]
        heapq.heapify(heap)
        k = size
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a[0] + b[0], k, (a, b)))
            k += 1
        stack = [(heap[0], 0)]
        while stack:
            (_, s, kids), d = stack.pop()
            if kids:
                stack += [(kids[0], d + 1), (kids[1], d + 1)]
            else:
                out[s] = d
        if max(out) <= most:
            return out
        least *= 2


def _codes(lengths: list[int]) -> dict[int, tuple[int, int]]:
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    if len(used) == 1:
        return {used[0][1]: (0, 0)}
    out, code, last = {}, 0, used[0][0]
    for n, s in used:
        code <<= n - last
        last = n
        out[s] = (int(format(code, f"0{n}b")[::-1], 2), n)
        code += 1
    return out


def _put_code(o: _Out, count: Counter, size: int) -> dict[int, tuple[int, int]]:
    used = sorted(count) or [0]
    if len(used) <= 2 and used[-1] < 256:
        o.put(1, 1)
        o.put(len(used) - 1, 1)
        o.put(used[0] > 1, 1)
        o.put(used[0], 8 if used[0] > 1 else 1)
        if len(used) == 2:
            o.put(used[1], 8)
        return _codes([1 if s in used else 0 for s in range(size)])
    lengths = _lengths(count, size, 15)
    tokens, i = [], 0
    while i < size:  # runs of zeros and of equal lengths
        j = i
        while j < size and lengths[j] == lengths[i]:
            j += 1
        n = j - i
        if lengths[i] == 0:
            while n >= 11:
                k = min(n, 138)
                tokens.append((18, k - 11, 7))
                n -= k
            if n >= 3:
                tokens.append((17, n - 3, 3))
                n = 0
            tokens += [(0, 0, 0)] * n
        else:
            tokens.append((lengths[i], 0, 0))
            n -= 1
            while n >= 3:
                k = min(n, 6)
                tokens.append((16, k - 3, 2))
                n -= k
            tokens += [(lengths[i], 0, 0)] * n
        i = j
    first = _lengths(Counter(t for t, _, _ in tokens), 19, 7)
    o.put(0, 1)
    o.put(15, 4)
    for s in _LENGTH_ORDER:
        o.put(first[s], 3)
    o.put(0, 1)
    codes = _codes(first)
    for t, extra, bits in tokens:
        o.put(*codes[t])
        o.put(extra, bits)
    return _codes(lengths)


def _prefix(v: int) -> tuple[int, int, int]:
    """(code, extra value, extra bits) of a length or distance."""
    v -= 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    second = v >> (top - 1) & 1
    return 2 * top + second, v - ((2 + second) << (top - 1)), top - 1


def _put_image(o: _Out, p: list[int], width: int, main: bool, cache_bits: int = 0, meta_shift: int | None = None, match: bool = True) -> None:
    o.put(cache_bits > 0, 1)
    if cache_bits:
        o.put(cache_bits, 4)
    height = len(p) // width
    groups, meta, across = 1, None, 0
    if main:
        o.put(meta_shift is not None, 1)
        if meta_shift is not None:
            across = -(-width >> meta_shift)
            meta = [(x + y) % 2 for y in range(-(-height >> meta_shift)) for x in range(across)]
            groups = max(meta) + 1
            o.put(meta_shift - 2, 3)
            _put_image(o, [g << 8 for g in meta], across, False)
    near = {max(1, (v >> 4) * width + 8 - (v & 15)): k + 1 for k, v in reversed(list(enumerate(NEAR)))}
    cache, items, last, i = [0] * (1 << cache_bits), [], {}, 0
    while i < len(p):
        j = last.get((p[i], p[i + 1], p[i + 2])) if match and i + 2 < len(p) else None
        n = 1
        group = meta[(i // width >> meta_shift) * across + (i % width >> meta_shift)] if meta else 0
        if j is not None:
            while i + n < len(p) and n < 4096 and p[i + n] == p[j + n]:
                n += 1
            d = i - j
            items.append((group, 256, *_prefix(n), *_prefix(near.get(d, d + 120))))
        elif cache_bits and cache[(p[i] * _CACHE_MUL & 0xFFFFFFFF) >> (32 - cache_bits)] == p[i]:
            items.append((group, 280 + ((p[i] * _CACHE_MUL & 0xFFFFFFFF) >> (32 - cache_bits))))
        else:
            items.append((group, p[i] >> 8 & 255, p[i] >> 16 & 255, p[i] & 255, p[i] >> 24))
        for k in range(i, i + n):
            if cache_bits:
                cache[(p[k] * _CACHE_MUL & 0xFFFFFFFF) >> (32 - cache_bits)] = p[k]
            if k + 2 < len(p):
                last[(p[k], p[k + 1], p[k + 2])] = k
        i += n
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    counts = [[Counter() for _ in sizes] for _ in range(groups)]
    for g, s, *rest in items:
        c = counts[g]
        if s == 256:
            c[0][256 + rest[0]] += 1
            c[4][rest[3]] += 1
        else:
            c[0][s] += 1
            for k, v in enumerate(rest):
                c[k + 1][v] += 1
    codes = [[_put_code(o, c, n) for c, n in zip(cs, sizes)] for cs in counts]
    for g, s, *rest in items:
        c = codes[g]
        if s == 256:
            o.put(*c[0][256 + rest[0]])
            o.put(rest[1], rest[2])
            o.put(*c[4][rest[3]])
            o.put(rest[4], rest[5])
        else:
            o.put(*c[0][s])
            for k, v in enumerate(rest):
                o.put(*c[k + 1][v])


def encode(p: np.ndarray, width: int, transforms: str = "", cache_bits: int = 0, meta_shift: int | None = None, match: bool = True) -> bytes:
    """A lossless WebP file of uint32 ARGB pixels; transforms are letters in order: p(redictor), c(ross-colour), g(reen), i(ndex)."""
    o, height, across, wide = _Out(), len(p) // width, width, width
    q = p.astype(np.int64)
    for bits, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        o.put(bits, n)
    for t in transforms:
        o.put(1, 1)
        o.put("pcgi".index(t), 2)
        wide = across
        if t == "p":
            shift = 2
            nx = -(-wide >> shift)
            modes = [(3 * k + k // nx) % 14 for k in range(nx * -(-height >> shift))]
            src, out = q.tolist(), []
            for i, v in enumerate(src):
                y, x = divmod(i, wide)
                if y == 0:
                    g = src[i - 1] if x else 0xFF000000
                elif x == 0:
                    g = src[i - wide]
                else:
                    g = predict(modes[(y >> shift) * nx + (x >> shift)], src[i - 1], src[i - wide], src[i - wide - 1], src[i - wide + 1])
                out.append(_join([(a - b) & 255 for a, b in zip(_parts(v), _parts(g))]))
            o.put(shift - 2, 3)
            _put_image(o, [m << 8 | 0xFF000000 for m in modes], nx, False)
            q = np.array(out, np.int64)
        elif t == "c":
            shift = 2
            n = -(-wide >> shift) * -(-height >> shift)
            e = np.array([0xFF000000 | (17 * k + 200 & 255) << 16 | (31 * k & 255) << 8 | (7 * k + 9 & 255) for k in range(n)], np.int64)
            o.put(shift - 2, 3)
            _put_image(o, e.tolist(), -(-wide >> shift), False)
            q = cross_colour(q, _spread(e, wide, height, shift), -1)
        elif t == "g":
            g = q >> 8 & 255
            q = (q & 0xFF00FF00) | ((q >> 16 & 255) - g & 255) << 16 | ((q & 255) - g & 255)
        else:
            colours, index = np.unique(q, return_inverse=True)
            if len(colours) > 256:
                raise ValueError("more than 256 colours")
            parts = colours.astype(np.uint32).view(np.uint8).reshape(-1, 4)
            o.put(len(colours) - 1, 8)
            _put_image(o, np.diff(parts, axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8).view(np.uint32)[:, 0].tolist(), len(colours), False)
            shift = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
            across = -(-wide >> shift)
            padded = np.zeros((height, across << shift), np.int64)
            padded[:, :wide] = index.reshape(height, wide)
            packed = sum(padded[:, k :: 1 << shift] << (8 >> shift) * k for k in range(1 << shift))
            q = (packed.ravel() << 8) | 0xFF000000
    o.put(0, 1)
    _put_image(o, q.tolist(), across, True, cache_bits, meta_shift, match)
    body = o.bytes()
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


ROWS = 4


def pictures(embeddings: DataFrame) -> DataFrame:
    """(vec_id, webp): each vector as a picture of ROWS rows; the way it is coded goes by vec_id."""
    ways = [dict(transforms="pg"), dict(transforms="cg", cache_bits=6), dict(transforms="i"), dict(transforms="pcg", meta_shift=3), dict(cache_bits=4), dict(transforms="ip", match=False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                way = ways[i % len(ways)]
                q = np.floor((np.clip(np.array(v, np.float32).astype(np.float64), -1, 1) + 1) * 127.5).astype(np.int64)
                y = np.arange(ROWS)[:, None]
                if "i" in way.get("transforms", ""):
                    p = 0xFF000000 | (q // 16 * 65793)[None] + 0 * y
                else:
                    p = 0xFF000000 | (q + 3 * y) % 256 << 16 | q << 8 | (2 * q + y) % 256
                out.append(encode(p.ravel().astype(np.uint32), len(v), **way))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["vec_id", "webp"])

    return embeddings.where("vec_id is not null and size(embedding) > 0").select("vec_id", "embedding").mapInArrow(run, "vec_id bigint, webp binary")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decode_column(pictures(table(spark, sf_dir, "embeddings")))
    return got.withColumn("pixels", F.array_join("pixels", ","))


OP1_SQL = f"""
WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: floor((greatest(-1, least(1, x::DOUBLE)) + 1) * 127.5)::BIGINT) AS q FROM embeddings)
SELECT vec_id, len(q)::INTEGER AS width, {ROWS} AS height, 'ok' AS status,
  array_to_string(flatten(list_transform(range({ROWS}), lambda y: list_transform(q, lambda x:
    CASE WHEN vec_id % 6 IN (2, 5) THEN x // 16 * 65793 ELSE (x + 3 * y) % 256 * 65536 + x * 256 + (2 * x + y) % 256 END - 16777216))), ',') AS pixels
FROM q
"""

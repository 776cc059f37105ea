"""Array-at-a-time tokenising and hashing of Arrow string columns.

Texts are handled as the bytes of the Arrow buffer.  A polynomial over the bytes modulo 2**64, kept as a
prefix sum, gives the hash of every token (and of every window of tokens) by one subtraction and one
multiplication with the inverse power, so that no Python loop runs over characters or words.

Bytes of multi-byte UTF-8 characters count as word characters.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 1
WORD_BASE = 0xD1B54A32D192ED03 | 1
MASK = (1 << 64) - 1
#: Bytes of text handled at once, so that the work arrays stay in the processor's cache.
CHUNK_BYTES = 1 << 20

_WORD = np.zeros(256, np.uint8)
for _c in range(256):
    _WORD[_c] = 1 if _c >= 128 or chr(_c).isalnum() or _c == ord("_") else 0
_WORD_PUNCT = _WORD.copy()
for _c in range(33, 127):
    if not _WORD[_c]:
        _WORD_PUNCT[_c] = 2

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        with np.errstate(over="ignore"):
            up = np.full(size, base, np.uint64)
            up[0] = 1
            down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
            down[0] = 1
            have = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
        if n <= 2 * CHUNK_BYTES:  # longer texts are rare, and their powers should not stay in memory
            _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every bit of a uint64 over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the n + 1 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose bytes come to about limit; a longer row stands alone and whole."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end
        row = end


class Tokens:
    """Tokens of the rows of one chunk: byte bounds, mixed hash and number of the row of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, punctuation: bool = False, spaces: bool = False):
        """spaces: tokens are whatever stands between blanks; punctuation: runs of punctuation count as tokens."""
        n = len(data)
        self.rows = len(offsets) - 1
        if spaces:
            kind = (data > 32).astype(np.uint8)
        else:
            kind = (_WORD_PUNCT if punctuation else _WORD)[data]
        edge = np.empty(n + 1, bool)
        edge[0] = edge[n] = True
        np.not_equal(kind[1:], kind[:-1], out=edge[1:n]) if n else None
        edge[offsets] = True
        at = np.flatnonzero(edge) if n else np.zeros(0, np.int64)
        inside = kind[at[:-1]] != 0 if n else np.zeros(0, bool)
        self.start = at[:-1][inside] if n else at
        self.end = at[1:][inside] if n else at
        first = np.searchsorted(self.start, offsets)
        self.first = first
        self.count = np.diff(first)
        up, down = powers(BASE, n + 1)
        prefix = np.zeros(n + 1, np.uint64)
        if n:
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
        self.hash = mix((prefix[self.end] - prefix[self.start]) * down[self.start])
        self.kind = kind[self.start] if n else kind

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.count)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each window of size tokens of one row, and the number of its first token.

        Windows that would leave their row are left out."""
        n = len(self.hash)
        if n < size:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        up, down = powers(WORD_BASE, n + 1)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hash * up[:n], out=prefix[1:])
        whole = self.left() >= size
        at = np.flatnonzero(whole)
        return mix((prefix[at + size] - prefix[at]) * down[at]), at

    def span_hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the tokens [a, b) of each pair of bounds; that of windows() where they are as long."""
        up, down = powers(WORD_BASE, len(self.hash) + 1)
        prefix = np.zeros(len(self.hash) + 1, np.uint64)
        np.cumsum(self.hash * up[: len(self.hash)], out=prefix[1:])
        return mix((prefix[b] - prefix[a]) * down[a])

    def left(self) -> np.ndarray:
        """Tokens from each token to the end of its row, itself included."""
        return np.repeat(self.first[1:], self.count) - np.arange(len(self.hash))


def tokenised(column: pa.Array, **kind) -> Iterator[tuple[int, int, Tokens]]:
    """(first row, end row, tokens) of the chunks of a string column."""
    data, offsets = buffers(column)
    for a, b in chunks(offsets):
        yield a, b, Tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], **kind)


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over [first[i], first[i + 1]); empty ranges give 0."""
    if values.ndim == 1:
        prefix = np.zeros(len(values) + 1, np.float64)
        np.cumsum(values, out=prefix[1:])
        return prefix[first[1:]] - prefix[first[:-1]]
    out = np.zeros((len(first) - 1, values.shape[1]), values.dtype)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, first[full], axis=0)
    return out

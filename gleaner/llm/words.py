"""Words, hashes and windows of whole Arrow batches of texts, a block of documents at a time.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D; in UTF-8 these bytes
never occur inside a character, so words can be cut on bytes. There is no loop over
words: all work is on numpy arrays of 64-bit values.

A word's hash is a sum of its 8-byte pieces, each mixed with its place; a run's hash is
a sum of its word hashes, each mixed with its place; a window's hash joins those of its
halves. Every step mixes before it adds, so no algebraic pattern of letters or words
(as of a polynomial modulo 2**64) makes different ones collide. Hashes only propose
equality; operators that need certainty compare 128 bits or the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18

_DELIMITER = np.zeros(256, dtype=bool)
_DELIMITER[[0x20, *range(0x09, 0x0E)]] = True

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_LETTERS = [np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for seed in (11, 12)]

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32

# By kind: what a piece's place, a piece, a word's place in a run, and a half of a window are mixed with.
_SALTS = np.random.default_rng(13).integers(1, 1 << 63, (2, 4), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PIECE_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def powers(base: int, count: int) -> np.ndarray:
    """base**0 ... base**(count-1) modulo 2**64."""
    out = np.full(count, base, dtype=np.uint64)
    if count:
        out[0] = 1
    np.multiply.accumulate(out, out=out)
    return out


class _Powers:
    """Powers of a base and of its inverse, grown when a longer block asks for them."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def get(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < count:
            self.up, self.down = powers(self.base, 2 * count), powers(self.inverse, 2 * count)
        return self.up, self.down


_POWERS = [_Powers(base) for base in _BASES]


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread all bits of a 64-bit value over all others; one to one."""
    out = values ^ (values >> np.uint64(30))
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return out


def _places(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... of each member of consecutive groups of these lengths."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum modulo 2**64 of each of consecutive groups of these lengths; 0 for an empty one."""
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=total[1:])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int = 0) -> np.ndarray:
    """Hash of the bytes data[start:end] of each range, from its 8-byte pieces."""
    place_salt, piece_salt, _, _ = _SALTS[kind]
    lengths = ends - starts
    pieces = (lengths + 7) >> 3
    place = _places(pieces)
    at = np.repeat(starts, pieces) + (place << 3)
    left = np.minimum(np.repeat(ends, pieces) - at, 8)
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    value = np.lib.stride_tricks.sliding_window_view(padded, 8)[at].view(np.uint64).reshape(-1) & _PIECE_MASKS[left]
    value = mixed(mixed(value ^ piece_salt) ^ (place.astype(np.uint64) + np.uint64(1)) * place_salt)
    return mixed(_sums(value, pieces) + lengths.astype(np.uint64) * piece_salt)


def _range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: _Powers) -> np.ndarray:
    """Hash of values[start:end] for each range: a polynomial, from one running sum."""
    up, down = table.get(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


@dataclass
class Block:
    """Some consecutive rows of a batch. Word k lies in data[starts[k]:ends[k]]; row r has words first[r]:first[r + 1]."""

    row: int
    data: np.ndarray
    edges: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.edges) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts())

    def word_hashes(self, kind: int = 0, folded: bool = False) -> np.ndarray:
        """folded: A-Z count as a-z."""
        return span_hashes(_FOLD[self.data] if folded else self.data, self.starts, self.ends, kind)

    def window_starts(self, size: int) -> np.ndarray:
        """Index of the first word of every window of ``size`` words; windows stay within a row."""
        index = np.arange(len(self.starts))
        last = np.repeat(self.first[1:], self.counts()) - size
        return index[index <= last]

    def text(self, row: int) -> bytes:
        return self.data[self.edges[row] : self.edges[row + 1]].tobytes()


def window_hashes(hashes: np.ndarray, at: np.ndarray, size: int, kind: int = 0) -> np.ndarray:
    """Hash of the ``size`` word hashes that begin at each place in ``at``.

    Hashes of 1, 2, 4, ... words come from two of the half before; those that the
    binary digits of ``size`` name are joined in order.
    """
    salt = _SALTS[kind, 3]
    level, width, out, offset = hashes, 1, None, 0
    while True:
        if size & width:
            part = level[at + offset]
            out = mixed(part ^ salt) if out is None else mixed(out * salt + part)
            offset += width
        if offset == size:
            return out
        level = mixed(mixed(level[:-width] ^ salt) + level[width:]) if len(level) > width else level[:0]
        width *= 2


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int = 0) -> np.ndarray:
    """Hash of data[start:end] for each range of bytes, however they overlap; for windows of a fixed, small size."""
    return _range_hashes(_LETTERS[kind][data], starts, ends, _POWERS[kind])


def every_byte_hash(data: np.ndarray, size: int, kind: int = 0) -> np.ndarray:
    """``byte_hashes`` of all ranges of ``size`` bytes, one from each byte on; without an index for each."""
    up, down = _POWERS[kind].get(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.multiply(_LETTERS[kind][data], up[: len(data)], out=sums[1:])
    np.cumsum(sums[1:], out=sums[1:])
    value = sums[size:] - sums[: len(sums) - size]
    value *= down[: len(value)]
    return mixed(value)


def run_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int = 0) -> np.ndarray:
    """Hash of hashes[start:end] for runs of any length."""
    salt = _SALTS[kind, 2]
    lengths = ends - starts
    place = _places(lengths)
    value = hashes[np.repeat(starts, lengths) + place]
    value = mixed(value ^ (place.astype(np.uint64) + np.uint64(1)) * salt)
    return mixed(_sums(value, lengths) + lengths.astype(np.uint64) * salt)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row edges of a string column; a null row is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    edges = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None and buffer.size else np.zeros(0, dtype=np.uint8)
    return data, edges


def row_blocks(edges: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer row is a block of its own."""
    row, rows = 0, len(edges) - 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(edges, edges[row] + size, side="right")) - 1)
        stop = min(stop, rows, row + 4096)
        yield row, stop
        row = stop


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """The words of a string column, block by block."""
    data, edges = text_buffer(column)
    for row, stop in row_blocks(edges, size):
        part = data[edges[row] : edges[stop]]
        own = edges[row : stop + 1] - edges[row]
        inside = np.zeros(len(part) + 2, dtype=np.int8)
        inside[1:-1] = ~_DELIMITER[part]
        step = np.diff(inside)
        starts, ends = step[:-1] == 1, step[1:] == -1
        cuts = own[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(part))]
        glued = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
        starts[glued], ends[glued - 1] = True, True
        begin, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        yield Block(row, part, own, begin, end, np.searchsorted(begin, own))


def kept_text(block: Block, row: int, keep: np.ndarray) -> bytes:
    """The kept words of a row, joined by one space. keep: a flag for each word of the row."""
    lo, hi = block.first[row], block.first[row + 1]
    if keep.all() and hi > lo:
        gaps = block.starts[lo + 1 : hi] - block.ends[lo : hi - 1]
        if (gaps == 1).all():
            out = block.data[block.starts[lo] : block.ends[hi - 1]].copy()
            out[(block.ends[lo : hi - 1] - block.starts[lo])] = 0x20
            return out.tobytes()
    starts, ends = block.starts[lo:hi][keep], block.ends[lo:hi][keep]
    data = block.data
    return b" ".join([data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])

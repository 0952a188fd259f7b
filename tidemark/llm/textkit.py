"""Vectorised text kernels shared by the operators, for use inside Arrow tasks.

A batch's text column is one contiguous UTF-8 buffer, so splitting and hashing
run over the whole buffer with numpy instead of once per word.  Word hashes are
polynomial prefix sums modulo 2**64, mixed afterwards; sequences of words are
hashed the same way over the word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text handled by one numpy step; bounds the memory of a task.
STEP_BYTES = 1 << 20
#: Bytes whose prefix sums are held at once, so that they stay in the processor's cache.
HASH_BYTES = 1 << 16
#: Odd multipliers of the byte and the word polynomials.
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93
SECOND_BASE = 0xA0761D6478BD642F

ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII but digits and small letters; with ``LOWER`` applied first this leaves [a-z0-9] and all beyond ASCII.
ASCII_MARKS = np.zeros(256, bool)
ASCII_MARKS[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.up.size:
            size = max(n, 2 * self.up.size, 1 << 12)
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, U64(base), U64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


BYTES, WORDS, SECOND = Powers(BYTE_BASE), Powers(WORD_BASE), Powers(SECOND_BASE)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)) if len(column) else np.zeros(1, np.int64)
    offs = offs.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def row_groups(offsets: np.ndarray, step: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``step`` bytes; a longer row stands alone."""
    row, rows = 0, offsets.size - 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + step, "right")) - 1)
        yield row, min(stop, rows)
        row = stop


def split_words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = ASCII_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the index of its first word.

    ``breaks`` marks the byte values between words; a row's edge also ends a word.
    """
    n = data.size
    gap = breaks[data]
    before, after = np.ones(n, bool), np.ones(n, bool)
    if n:
        before[1:], after[:-1] = gap[:-1], gap[1:]
        edges = offsets[(offsets > 0) & (offsets < n)]
        before[edges] = True
        after[edges - 1] = True
        before[0] = after[-1] = True
    starts = np.flatnonzero(~gap & before)
    ends = np.flatnonzero(~gap & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers = BYTES) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever the word stands."""
    out = np.empty(starts.size, U64)
    w = 0
    while w < starts.size:
        stop = max(w + 1, int(np.searchsorted(ends, starts[w] + HASH_BYTES, "right")))
        base, top = int(starts[w]), int(ends[stop - 1])
        up, down = powers.get(top - base)
        sums = np.zeros(top - base + 1, U64)
        np.cumsum((data[base:top].astype(U64) + U64(1)) * up, out=sums[1:])
        a, b = starts[w:stop] - base, ends[w:stop] - base
        out[w:stop] = (sums[b] - sums[a]) * down[a]
        w = stop
    return mix(out)


class Sequence:
    """Hashes of any run of consecutive words, from prefix sums."""

    def __init__(self, hashes: np.ndarray, powers: Powers = WORDS):
        up, self.down = powers.get(hashes.size + 1)
        self.sums = np.zeros(hashes.size + 1, U64)
        np.cumsum(hashes * up[: hashes.size], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(U64))

    def runs(self, size: int) -> np.ndarray:
        """The hash of every ``size`` consecutive words."""
        n = max(0, self.sums.size - size)
        return mix((self.sums[size : size + n] - self.sums[:n]) * self.down[:n] + U64(size))


def sliding_argmin(values: np.ndarray, size: int) -> np.ndarray:
    """Position of the leftmost minimum of each ``size`` consecutive values."""
    best, span = np.arange(values.size), 1
    while span < size:
        step = min(span, size - span)
        left, right = best[:-step] if step else best, best[step:]
        best = np.where(values[right] < values[left], right, left)
        span += step
    return best


#: For each byte, its eight bits spread over the eight bytes of one integer.
_SPREAD = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], U64)


def majority_bits(hashes: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """SimHash: for each group of hashes, the bits set in over half of them.

    Groups are runs of ``counts`` hashes from ``first`` on, in order and without
    gaps; an empty group gives zero.  Counters are bytes, summed in pieces of at
    most 255 hashes and then widened.
    """
    out = np.zeros(first.size, U64)
    full = np.flatnonzero(counts)
    if not full.size:
        return out
    first, counts = first[full], counts[full]
    pieces = (counts + 254) // 255
    owner = np.repeat(np.arange(full.size), pieces)
    inside = np.arange(owner.size) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cuts = first[owner] + 255 * inside
    heads = np.cumsum(pieces) - pieces
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    bits = np.zeros(full.size, U64)
    for lane in range(8):
        sums = np.add.reduceat(_SPREAD[lanes[:, lane]], cuts)
        ones = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), heads, axis=0)
        for i in range(8):
            bits |= (2 * ones[:, i] > counts).astype(U64) << U64(8 * lane + i)
    out[full] = bits
    return out


def text_chunks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of about ``STEP_BYTES`` of text, with bytes and offsets."""
    for batch in batches:
        data, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
        for lo, hi in row_groups(offsets):
            yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]

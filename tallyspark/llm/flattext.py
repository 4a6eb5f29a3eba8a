"""Texts of an Arrow batch as flat numpy arrays: bytes, offsets, words and word hashes.

No Python object is made per word. A stretch of bytes is read as 64-bit numbers, eight bytes each, which are mixed with
their places and summed up: bytes enter by a bijection that is not linear, so no family of words, such as the Thue-Morse
words under a polynomial hash, collides by its form. Where a hash must not decide alone, `Stretches` compares all bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
WINDOW = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit moves every output bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


BYTES = np.arange(256, dtype=np.uint8)
LOWER = BYTES.copy()
LOWER[65:91] = BYTES[97:123]
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
#: By how many of its bytes are valid.
MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], U)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and the n + 1 places where texts begin and end. Null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    ends = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[ends[0] : ends[-1]], ends - ends[0]


def slices(batch: pa.RecordBatch, column: str | int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most limit bytes of that column, one row at least."""
    lengths = np.diff(text_bytes(batch.column(column))[1])
    ends = np.cumsum(lengths)
    start, n = 0, batch.num_rows
    while start < n:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def find_words(buf: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are no ASCII white space; none spans two texts."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~SPACES[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = places[(places > 0) & (places < len(buf))]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def windows(starts: np.ndarray, ends: np.ndarray, size: int = WINDOW) -> Iterator[slice]:
    """Neighbouring stretches, of about size bytes together, one at least. starts and ends ascend."""
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + size, side="right")))
        yield slice(i, j)
        i = j


class Numbers:
    """An array that grows at its end."""

    def __init__(self, dtype: type, width: int = 0) -> None:
        self.n, self.width, self.held = 0, width, np.zeros((1024, width) if width else 1024, dtype)

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.held):
            more = np.zeros((max(2 * len(self.held), self.n + len(values)), *self.held.shape[1:]), self.held.dtype)
            more[: self.n] = self.held[: self.n]
            self.held = more
        self.held[self.n : self.n + len(values)] = values
        self.n += len(values)

    @property
    def all(self) -> np.ndarray:
        return self.held[: self.n]


class Hasher:
    """64-bit hashes of stretches of bytes, read through a table of 256 bytes."""

    def __init__(self, table: np.ndarray = LOWER) -> None:
        self.table = None if table is BYTES else table

    def eights(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The stretches' bytes, eight to a number, the last one filled up with zeros; and how many numbers each has, one
        at least. starts and ends ascend."""
        if not len(starts):
            return np.zeros(0, U), np.zeros(0, np.int64)
        low, high = int(starts[0]), int(ends[-1])
        own = np.zeros(high - low + 8, np.uint8)
        own[: high - low] = buf[low:high] if self.table is None else self.table[buf[low:high]]
        by_eight = np.ndarray(high - low + 1, "<u8", own, strides=(1,))
        sizes = ends - starts
        counts = np.maximum((sizes + 7) >> 3, 1)
        if int(counts.max()) == 1:
            return by_eight[starts - low] & MASKS[sizes], counts
        before = np.cumsum(counts) - counts
        k = np.arange(int(counts.sum()), dtype=np.int64) - np.repeat(before, counts)
        at = np.repeat(starts - low, counts) + 8 * k
        return by_eight[at] & MASKS[np.minimum(np.repeat(sizes, counts) - 8 * k, 8)], counts

    def of(self, values: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Hashes of stretches that eights() has read."""
        if not len(sizes):
            return np.zeros(0, U)
        one = mix(values ^ U(0x9FB21C651E98DF25))
        if len(values) > len(sizes):
            before = np.cumsum(counts) - counts
            k = np.arange(len(values), dtype=np.int64) - np.repeat(before, counts)
            one = np.add.reduceat(mix(one + k.astype(U) * U(0xD6E8FEB86659FD93)), before)
        else:
            one = mix(one)
        return mix(one + sizes.astype(U) * U(0x9E3779B97F4A7C15))

    def __call__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """starts and ends ascend."""
        out = np.empty(len(starts), U)
        for w in windows(starts, ends):
            out[w] = self.of(*self.eights(buf, starts[w], ends[w]), ends[w] - starts[w])
        return out


class Stretches:
    """Numbers different stretches of bytes from 0, equal ones alike. Hashes find a stretch, all its bytes decide: two
    that share a hash have two numbers. Which stretches are remembered depends on the size of the table; one that was
    forgotten gets a new number, which costs time and nothing else."""

    def __init__(self, bits: int = 20, limit: int = 1 << 19) -> None:
        self.hasher, self.bits, self.limit = Hasher(BYTES), bits, limit
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.hashes, self.sizes, self.heads, self.values = Numbers(U), Numbers(np.int64), Numbers(np.int64), Numbers(U)

    @property
    def full(self) -> bool:
        """Whether to clear before the next call; whoever keeps something for each number clears that too."""
        return self.hashes.n > self.limit or self.values.n > 4 * self.limit

    def _equal(self, numbers: np.ndarray, values: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether stretches are those with these numbers, by size and all bytes."""
        same = self.sizes.all[numbers] == sizes
        before = np.cumsum(counts) - counts
        if not same.all():
            on = np.flatnonzero(same)
            same[on] = self._equal(numbers[on], values[spread(before[on], counts[on])], counts[on], sizes[on])
            return same
        equal = self.values.all[spread(self.heads.all[numbers], counts)] == values
        return equal if len(equal) == len(sizes) else np.logical_and.reduceat(equal, before)

    def numbers(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A number for each stretch, and places of stretches that have the new numbers, in their order. starts and ends
        ascend."""
        sizes = ends - starts
        values, counts = self.hasher.eights(buf, starts, ends)
        hashes = self.hasher.of(values, counts, sizes)
        before = np.cumsum(counts) - counts
        slot = (hashes >> U(64 - self.bits)).astype(np.int64)
        out = self.slots[slot].astype(np.int64)
        maybe = np.flatnonzero(out >= 0)
        maybe = maybe[self.hashes.all[out[maybe]] == hashes[maybe]]
        known = np.zeros(len(out), bool)
        if len(maybe) == len(out):
            known = self._equal(out, values, counts, sizes)
        elif len(maybe):
            known[maybe] = self._equal(out[maybe], values[spread(before[maybe], counts[maybe])], counts[maybe], sizes[maybe])
        todo = np.flatnonzero(~known)
        if not len(todo):
            return out, todo
        _, first, group = np.unique(hashes[todo], return_index=True, return_inverse=True)
        base = self.hashes.n
        out[todo] = base + group
        fresh = todo[first]
        self._remember(hashes, sizes, values, counts, before, fresh)
        self.slots[slot[fresh]] = np.arange(base, self.hashes.n, dtype=np.int32)
        other = todo[~self._equal(out[todo], values[spread(before[todo], counts[todo])], counts[todo], sizes[todo])]
        if len(other):  # they share a hash with another stretch of this call: a number each
            out[other] = np.arange(self.hashes.n, self.hashes.n + len(other))
            self._remember(hashes, sizes, values, counts, before, other)
        return out, np.r_[fresh, other]

    def _remember(self, hashes: np.ndarray, sizes: np.ndarray, values: np.ndarray, counts: np.ndarray, before: np.ndarray, on: np.ndarray) -> None:
        self.hashes.add(hashes[on])
        self.sizes.add(sizes[on])
        self.heads.add(self.values.n + np.cumsum(counts[on]) - counts[on])
        self.values.add(values[spread(before[on], counts[on])])


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all elements of the stretches [start, start + length), one stretch after another."""
    lengths = np.asarray(lengths, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(np.asarray(starts, np.int64) - before, lengths) + np.arange(int(lengths.sum()), dtype=np.int64)


def take_stretches(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return values[spread(starts, lengths)]


def segment_sums(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Sums of values between neighbouring places; empty stretches have 0."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[places[1:]] - total[places[:-1]]

"""The texts of an Arrow batch as flat numpy arrays: words, spans and their hashes.

Texts stay where Arrow put them, one after the other in one buffer; a word is a
pair of offsets. No Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes worked on at a time. Temporary arrays hold some 60 bytes per text byte.
PORTION = 2_000_000
# The separators between words, and multipliers of published
# 64-bit finalisers.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
MIX_A = np.uint64(0xFF51AFD7ED558CCD)
MIX_B = np.uint64(0xC4CEB9FE1A85EC53)
BASE = 0x9E3779B97F4A7C15 | 1
# Bytes of a span that are hashed one after the other; a multiple of eight.
LONG = 512
# The first 0 to 8 bytes of a number.
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)

IS_SEPARATOR = np.zeros(256, dtype=bool)
IS_SEPARATOR[list(SEPARATORS)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offset of each; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(offsets):
        offsets = np.zeros(1, dtype=np.int64)
    return data, offsets


def portions(offsets: np.ndarray, size: int = PORTION) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `size` bytes, or one longer row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def text_portions(column: pa.Array, size: int = PORTION):
    """Per portion its first row and the bytes and offsets of its texts."""
    data, offsets = text_bytes(column)
    for first, last in portions(offsets, size):
        begin, end = offsets[first], offsets[last]
        yield first, data[begin:end], offsets[first : last + 1] - begin


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, `size` of them, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


def word_spans(data: np.ndarray, offsets: np.ndarray, is_separator: np.ndarray = IS_SEPARATOR):
    """Starts and ends of all words, and per text the index of its first word
    (with the number of words at the end). `is_separator` says of each byte whether
    it stands between words."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    separator = is_separator[data]
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = True, separator[:-1]
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = True, separator[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges], after[edges - 1] = True, True
    starts = np.flatnonzero(~separator & before)
    ends = np.flatnonzero(~separator & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    values = values ^ (values >> np.uint64(33))
    values = values * MIX_A
    values ^= values >> np.uint64(33)
    values *= MIX_B
    return values ^ (values >> np.uint64(33))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit number per span of `values` (bytes, code points or numbers).

    Eight bytes a step go through a finaliser that is one to one, so spans of one
    length up to eight bytes never share a number, and longer ones do only by
    chance: no structure of a text, such as a word made of two halves in turn,
    makes them meet. A span of more than LONG bytes is hashed in pieces, and then
    as the row of their numbers, so that no span needs many steps.
    """
    width = values.itemsize
    sizes = (ends - starts) * width
    hashes = np.empty(len(starts), dtype=np.uint64)
    long = np.flatnonzero(sizes > LONG)
    if len(long):
        step = LONG // width
        n_pieces = -(-(ends[long] - starts[long]) // step)
        edges = np.concatenate(([0], np.cumsum(n_pieces)))
        begins = np.repeat(starts[long], n_pieces) + ranges(np.zeros(len(long), np.int64), n_pieces) * step
        pieces = span_hashes(values, begins, np.minimum(begins + step, np.repeat(ends[long], n_pieces)))
        hashes[long] = span_hashes(pieces, edges[:-1], edges[1:])
    # Bytes after the last one are there to be read and masked.
    padded = np.append(np.ascontiguousarray(values).view(np.uint8), np.zeros(8, np.uint8))
    eights = np.ndarray(len(padded) - 7, dtype="<u8", buffer=padded.data, strides=(1,))
    rest = np.flatnonzero(sizes <= LONG)
    at, left = starts[rest] * width, sizes[rest]
    now = mix(left.astype(np.uint64) * np.uint64(BASE) + MIX_B)
    while len(rest):
        now = mix(now ^ (eights[at] & MASKS[np.minimum(left, 8)]))
        more = left > 8
        if not more.any():
            hashes[rest] = now
            break
        done = ~more
        hashes[rest[done]] = now[done]
        rest, now, at, left = rest[more], now[more], at[more] + 8, left[more] - 8
    return hashes


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word with A-Z in lower case, and per text the index of its
    first word."""
    starts, ends, firsts = word_spans(data, offsets)
    return span_hashes(LOWER[data], starts, ends), firsts


def sums_by(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sum of the values of each text; `firsts` as `word_spans` gives it."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[firsts[1:]] - total[firsts[:-1]]


def odd_numbers(name: str, n: int) -> np.ndarray:
    """`n` odd 64-bit multipliers that follow from their name."""
    seed = np.frombuffer(name.encode(), dtype=np.uint8).astype(np.uint64)
    start = span_hashes(seed, np.array([0]), np.array([len(seed)]))
    return mix(start + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)


def counted(owner: np.ndarray, value: np.ndarray, n_owners: int, n_values: int):
    """Distinct values (below `n_values`) of each owner, how often each is there,
    and where each owner begins."""
    found, n = np.unique(owner * n_values + value, return_counts=True)
    return found % n_values, n, np.searchsorted(found, np.arange(n_owners + 1) * n_values)


def listed(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Lists of an array cut at `edges`."""
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values))


class Index:
    """From 64-bit numbers to small ones, for whole arrays at a time: a table
    with linear probing, at most half full."""

    def __init__(self, keys: np.ndarray = np.zeros(0, np.uint64), values: np.ndarray | None = None):
        self.count, self.mask = 0, np.uint64((1 << 10) - 1)
        self.keys = np.zeros(1 << 10, dtype=np.uint64)
        self.values = np.full(1 << 10, -1, dtype=np.int64)
        self.add(keys, np.arange(len(keys)) if values is None else values)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add keys that are not there yet, with values from 0 on."""
        self.count += len(keys)
        if 2 * self.count > len(self.keys):
            used = self.values >= 0
            keys = np.concatenate((self.keys[used], keys))
            values = np.concatenate((self.values[used], values))
            size = 1 << int(2 * self.count).bit_length()
            self.mask = np.uint64(size - 1)
            self.keys = np.zeros(size, dtype=np.uint64)
            self.values = np.full(size, -1, dtype=np.int64)
        step = np.uint64(0)
        while len(keys):
            slot = (keys + step) & self.mask
            free = self.values[slot] < 0
            self.keys[slot[free]] = keys[free]
            self.values[slot[free]] = values[free]
            # Of several keys for one free slot the last has it.
            rest = ~free | (self.keys[slot] != keys)
            keys, values, step = keys[rest], values[rest], step + np.uint64(1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where it is not there."""
        slot = keys & self.mask
        found = self.values[slot]
        pending = np.flatnonzero((self.keys[slot] != keys) & (found >= 0))
        step = np.uint64(0)
        while len(pending):
            step += np.uint64(1)
            wanted = keys[pending]
            slot = (wanted + step) & self.mask
            found[pending] = self.values[slot]
            pending = pending[(self.keys[slot] != wanted) & (found[pending] >= 0)]
        return found

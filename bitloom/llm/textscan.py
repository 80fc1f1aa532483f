"""Vectorised scanning of text columns: words and their 64-bit hashes, straight from Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text scanned at once; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64 bits that spreads every input bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def join_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two hashed sequences laid end to end; not symmetric."""
    return mix(left * U64(0x9E3779B97F4A7C15) + (right ^ U64(0xD1B54A32D192ED03)))


_ROUND = 64
_TABLE = mix(np.arange(_ROUND * 256, dtype=U64) + U64(0x5851F42D4C957F2D))

_ALL = np.arange(256, dtype=np.uint8)
#: A-Z to a-z, all other bytes unchanged.
FOLD = np.where((_ALL >= 65) & (_ALL <= 90), _ALL + 32, _ALL).astype(np.uint8)
#: Separators of words [^\x20\x09-\x0D]+
SPACES = (_ALL == 32) | ((_ALL >= 9) & (_ALL <= 13))
#: Separators of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ in folded text
NOT_WORD = (_ALL < 128) & ~(((_ALL >= 48) & (_ALL <= 57)) | ((_ALL >= 97) & (_ALL <= 122)))


class Words(NamedTuple):
    """Words of a slice: hash, first and last byte, and for each row where its words begin."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    offs: np.ndarray


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string or binary column; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def slices(offs: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes, or of one row."""
    first, rows = 0, len(offs) - 1
    while first < rows:
        last = int(np.searchsorted(offs, offs[first] + most, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def words(data: np.ndarray, offs: np.ndarray, separators: np.ndarray, fold: bool) -> Words:
    """Words of the rows that `offs` (from the slice's first byte on) cuts out of data."""
    base = int(offs[0])
    raw, at = data[base : int(offs[-1])], offs - base
    if fold:
        raw = FOLD[raw]
    n = len(raw)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return Words(np.zeros(0, U64), empty, empty, np.zeros(len(offs), np.int64))
    inside = ~separators[raw]
    first = np.zeros(n + 1, bool)
    first[at[:-1]] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(start):
        return Words(np.zeros(0, U64), start, end, np.zeros(len(offs), np.int64))
    place = np.arange(n, dtype=np.int32)
    place -= np.maximum.accumulate(np.where(begins, place, np.int32(0)))
    part = _TABLE[((place & (_ROUND - 1)) << 8) | raw]
    if n > _ROUND and int((end - start).max()) > _ROUND:
        part = part * (U64(2) * (place >> 6).astype(U64) + U64(1))
    part[~inside] = 0
    hashed = mix(np.add.reduceat(part, start) + (end - start).astype(U64))
    return Words(hashed, start + base, end + base, np.searchsorted(start, at))


def windows(hashed: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` consecutive items, by doubling; shorter input gives nothing."""
    n = len(hashed) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, done, power, size = None, 0, hashed, 1
    while True:
        if width & size:
            piece = power[done : done + n]
            out = piece if out is None else join_hash(out, piece)
            done += size
        size *= 2
        if size > width:
            return out
        power = join_hash(power[: len(power) - size // 2], power[size // 2 :])


def within(offs: np.ndarray, width: int, n: int) -> np.ndarray:
    """For window starts 0..n-1 over concatenated rows: does the window stay in its row."""
    ok = np.zeros(n, bool)
    if n > 0:
        row_end = np.repeat(offs[1:], np.diff(offs))[:n]
        ok = np.arange(n) + width <= row_end
    return ok


class Pool:
    """Open-addressing table in numpy: 64-bit key -> slot of a variable-length int array.

    It only saves work: a full pool is emptied and filled anew, results stay the same. `most` is
    where callers empty it; one text may hold more keys than that, for which the table doubles.
    """

    def __init__(self, most: int = 1_200_000, bits: int = 21) -> None:
        self.most, self.least_bits = most, bits
        self.clear()

    def clear(self) -> None:
        self.bits = self.least_bits
        self.keys = np.zeros(1 << self.bits, U64)
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.begin = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int32)
        self.values = np.zeros(1 << 18, np.int32)
        self.n = self.used = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where it is missing."""
        mask = U64((1 << self.bits) - 1)
        at = (keys & mask).astype(np.int64)
        out = self.slots[at]
        todo = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        while len(todo):
            at[todo] = (at[todo] + 1) & int(mask)
            out[todo] = self.slots[at[todo]]
            todo = todo[(out[todo] >= 0) & (self.keys[at[todo]] != keys[todo])]
        return out

    def add(self, keys: np.ndarray, arrays: list[np.ndarray]) -> None:
        """New distinct keys with their arrays."""
        size = np.fromiter(map(len, arrays), np.int64, len(arrays))
        total = int(size.sum())
        while self.used + total > len(self.values):
            self.values = np.concatenate([self.values, np.zeros(len(self.values), np.int32)])
        while self.n + len(keys) > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros(len(x), x.dtype)]) for x in (self.begin, self.size))
        if total:
            self.values[self.used : self.used + total] = np.concatenate(arrays)
        ids = np.arange(self.n, self.n + len(keys))
        self.begin[ids] = self.used + np.cumsum(size) - size
        self.size[ids] = size
        self.used += total
        self.index(keys)

    def index(self, keys: np.ndarray) -> None:
        """Next slots for new distinct keys; the table doubles before it is three quarters full."""
        if 4 * (self.n + len(keys)) > 3 << self.bits:
            taken = np.flatnonzero(self.slots >= 0)
            keys = np.concatenate([self.keys[taken[np.argsort(self.slots[taken])]], keys])
            while 4 * len(keys) > 3 << self.bits:
                self.bits += 1
            self.keys, self.slots, self.n = np.zeros(1 << self.bits, U64), np.full(1 << self.bits, -1, np.int32), 0
        ids = np.arange(self.n, self.n + len(keys))
        self.n += len(keys)
        mask = (1 << self.bits) - 1
        at, todo = (keys & U64(mask)).astype(np.int64), np.arange(len(keys))
        while len(todo):
            free = self.slots[at[todo]] < 0
            spot, first = np.unique(at[todo[free]], return_index=True)
            won = todo[free][first]
            self.slots[spot], self.keys[spot] = ids[won], keys[won]
            left = np.ones(len(keys), bool)
            left[won] = False
            todo = todo[left[todo]]
            at[todo] = np.where(self.slots[at[todo]] >= 0, (at[todo] + 1) & mask, at[todo])

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values laid end to end, size of each) for slots in order."""
        size = self.size[slots].astype(np.int64)
        ends = np.cumsum(size)
        take = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.begin[slots] - (ends - size), size)
        return self.values[take], size

"""Numpy helpers over Arrow string columns, shared by the Python operators of this subpackage.

All of them work on the UTF-8 bytes of a slice of rows at a time, so memory is bounded by
SLICE_BYTES plus the longest single text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time.
SLICE_BYTES = 1 << 20

#: The white space of the contracts: \x20 and \x09-\x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream64(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit words by rule, the same everywhere."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BASE = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = stream64(256, 11)
_BYTE_LOWER = _BYTE[LOWER]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about `limit` bytes; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def word_bounds(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes that aren't in `space`; runs end at row ends."""
    inside = ~space[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= cut[1:-1] | ~inside[:-1]
    last[:-1] &= cut[1:-1] | ~inside[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def range_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the byte ranges; equal bytes, equal hashes wherever they stand. Never 0."""
    up, down = _power_tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[raw] * up[: len(raw)], out=total[1:])
    out = mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    out[out == 0] = 1
    return out


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items of these lengths laid end to end: the item of each element, and its place in the item."""
    item = np.repeat(np.arange(len(lengths)), lengths)
    return item, np.arange(len(item)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


class HashStore:
    """A map from 64-bit hashes (not 0) to small integers as an open-addressed numpy table of fixed size.

    It is a cache: once `limit` keys are in it, `full` says so and the owner clears it.
    """

    def __init__(self, bits: int = 21):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.limit = (1 << bits) * 6 // 10
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(self.mask + 1, np.uint64)
        self.values = np.zeros(self.mask + 1, np.int32)
        self.n = 0

    def full(self, more: int) -> bool:
        return self.n + more > self.limit

    def find(self, h: np.ndarray) -> np.ndarray:
        """The value of each hash, -1 if it isn't here."""
        out, slot, left = np.full(len(h), -1, np.int32), (h >> self.shift).astype(np.int64), np.arange(len(h))
        while len(left):
            at = slot[left]
            key = self.keys[at]
            hit = key == h[left]
            out[left[hit]] = self.values[at[hit]]
            left = left[~hit & (key != 0)]
            slot[left] = (slot[left] + 1) & self.mask
        return out

    def insert(self, h: np.ndarray, values: np.ndarray) -> None:
        """New, distinct hashes."""
        slot, left = (h >> self.shift).astype(np.int64), np.arange(len(h))
        self.n += len(h)
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]] = h[free]
            done = np.zeros(len(left), bool)
            done[:] = self.keys[slot[left]] == h[left]
            self.values[slot[left[done]]] = values[left[done]]
            left = left[~done]
            slot[left] = (slot[left] + 1) & self.mask


class WordTable:
    """Per distinct word, a row of ids or figures that `make(words) -> list` gives; a bounded cache.

    ids=True: rows are arrays of ids of any length. Else: rows are float vectors of one length.
    """

    #: Stored ids at which the cache starts anew.
    MOST_IDS = 1 << 22

    def __init__(self, make: Callable[[list[bytes]], list], ids: bool, bits: int = 20, lower: bool = False):
        self.make, self.ids, self.store, self.lower = make, ids, HashStore(bits), lower
        self.reset()

    def reset(self) -> None:
        self.store.clear()
        self.rows: np.ndarray | None = None
        self.used = 0
        self.at = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.n = 0

    def _grow(self, name: str, need: int, like: np.ndarray) -> None:
        have = getattr(self, name)
        if have is None or len(have) < need:
            wide = np.zeros((max(1024, 2 * need), *like.shape[1:]), like.dtype)
            if have is not None:
                wide[: len(have)] = have
            setattr(self, name, wide)

    def _add(self, h: np.ndarray, words: list[bytes]) -> None:
        made = self.make(words)
        if self.ids:
            length = np.fromiter(map(len, made), np.int64, len(made))
            flat = np.fromiter(chain.from_iterable(made), np.uint32, int(length.sum()))
            at = self.used + np.cumsum(length) - length
            self._grow("at", self.n + len(made), at)
            self._grow("length", self.n + len(made), length)
            self.at[self.n : self.n + len(made)], self.length[self.n : self.n + len(made)] = at, length
        else:
            flat = np.asarray(made, np.float32)
        self._grow("rows", self.used + len(flat), flat)
        self.rows[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.store.insert(h, np.arange(self.n, self.n + len(h), dtype=np.int32))
        self.n += len(h)

    def index(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The row number of each word (valid until the next call)."""
        h = range_hashes(raw, starts, ends, self.lower)
        out = self.store.find(h)
        new = np.flatnonzero(out < 0)
        if len(new):
            u, first, back = np.unique(h[new], return_index=True, return_inverse=True)
            if self.store.full(len(u)) or self.used > self.MOST_IDS:
                self.reset()
                new = np.arange(len(h))
                u, first, back = np.unique(h, return_index=True, return_inverse=True)
                while self.store.limit < len(u):  # one long text with more distinct words than the table holds
                    self.store = HashStore(self.store.mask.bit_length() + 1)
            pick = new[first]
            text = raw.tobytes()
            base = self.n
            self._add(u, [text[a:b] for a, b in zip(starts[pick].tolist(), ends[pick].tolist(), strict=True)])
            out[new] = base + back
        return out

    def gather(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For ids: all ids of these words end to end, and the number of ids of each."""
        length = self.length[index]
        item, place = ragged(length)
        return self.rows[self.at[index][item] + place], length

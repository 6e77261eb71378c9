"""Whole Arrow batches of texts as flat NumPy arrays: bytes, words, hashes.

Everything here works on the UTF-8 bytes of many documents at once, in pieces
of about one megabyte, so a task's memory follows the longest document and not
the batch. Hashes are position-independent: equal byte strings have equal
hashes wherever they stand. Words and lines, which can be of any length, are
hashed by ``hashed``; ``Rolling`` hashes short runs of such values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: White space that ends a word: ``[\x20\x09-\x0D]``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_MULT = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INV = pow(_MULT, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Masks of the lowest 0 to 8 bytes of a lane.
_LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer slices are hashed in chunks of so many bytes, and then their chunks' hashes.
_LONG = 1024


def hashed(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of byte slices, eight bytes at a time through ``mix``; each salt gives an independent one.

    Nothing in it is linear in the bytes, so periodic and other regular texts
    collide no more often than any others.
    """
    n = end - begin
    lanes = np.ndarray(len(raw) + 1, "<u8", np.concatenate((raw, np.zeros(8, np.uint8))), strides=(1,))
    out = mix(n.astype(np.uint64) * np.uint64(_MULT) + np.uint64((salt * 0xA0761D6478BD642F + 0xE7037ED1A0B428DB) & (1 << 64) - 1))
    long = np.flatnonzero(n > _LONG)
    if len(long):
        many = -(-n[long] // _LONG)
        start = np.repeat(begin[long], many) + ranges(np.zeros(len(long), np.int64), many) * _LONG
        part = hashed(raw, start, np.minimum(start + _LONG, np.repeat(end[long], many)), salt)
        at = np.concatenate(([0], np.cumsum(many))) * 8
        out[long] = mix(out[long] ^ hashed(part.view(np.uint8), at[:-1], at[1:], salt + 1))
    live, done = np.flatnonzero((n > 0) & (n <= _LONG)), 0
    while len(live):
        left = n[live] - done
        out[live] = mix(out[live] * np.uint64(_MULT) ^ lanes[begin[live] + done] & _LANE[np.minimum(left, 8)])
        live, done = live[left > 8], done + 8
    return out


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.cumprod(out, out=out)
    return out


class Rolling:
    """Hashes of any slices of a sequence of 64-bit values, from one prefix sum."""

    _pow: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, values: np.ndarray):
        n = len(values)
        if Rolling._pow.get(0, (np.empty(0),))[0].size <= n:
            m = max(n + 1, 1 << 20)
            Rolling._pow[0] = (powers(m, _MULT), powers(m, _INV))
        self.up, inv = Rolling._pow[0]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * inv[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        """Hash of ``values[start:end]`` for each pair; ``salt`` gives another family."""
        raw = (self.sums[end] - self.sums[start]) * self.up[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(salt * 0xA0761D6478BD642F & (1 << 64) - 1))

    def grams(self, k: int, salt: int = 0) -> np.ndarray:
        """Hash of every slice of ``k`` values, by its start."""
        n = len(self.sums) - 1
        if n < k:
            return np.empty(0, np.uint64)
        raw = (self.sums[k:] - self.sums[:-k]) * self.up[: n - k + 1]
        return mix(raw + np.uint64(k * 0xD6E8FEB86659FD93 + salt * 0xA0761D6478BD642F & (1 << 64) - 1))


#: A random 64-bit value for each byte.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its offsets (one more than rows); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw, at


def pieces(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of runs of rows of about ``limit`` bytes."""
    if not len(column):
        return
    raw, at = flat(column)
    low = 0
    while low < len(at) - 1:
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
        yield low, high, raw[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high


def spans(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that cross no document: starts, ends, and each document's first run."""
    n = len(inside)
    if not n:
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[at[:-1][at[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[at[1:][at[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, at)


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\x20\x09-\x0D]+``: byte starts, byte ends, first word of each document."""
    return spans(~SPACE[raw], at)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of ``arange(s, s + c)``."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return shift + np.arange(total)


def lowest(keys: np.ndarray, width: int) -> np.ndarray:
    """For each start, the leftmost place of the least key among ``width`` from there on.

    Keys are compared by their upper 32 bits, ties go to the left, so equal
    windows choose the same place relative to their start.
    """
    n = len(keys) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    packed = (keys >> np.uint64(32) << np.uint64(32)) | np.arange(len(keys), dtype=np.uint64)
    size = 1
    while size * 2 <= width:
        packed = np.minimum(packed[:-size], packed[size:])
        size *= 2
    packed = np.minimum(packed[:n], packed[width - size : width - size + n])
    return (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open intervals as disjoint, non-touching ones."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > reach[:-1]))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(starts) - 1]))
    return starts[new], reach[last]

"""Words of many texts at once, as numpy columns over the bytes of an Arrow string column.

A word is a run of bytes other than space and 0x09-0x0D. Word hashes have 64 bits, the same for
equal words wherever they stand; what must be exact is compared by such hashes only where the
module says so.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_P = U64(0x9E3779B97F4A7C15)
_SPAN = 1 << 18


class Words(NamedTuple):
    """Words of a batch: byte ranges, hashes, and where each document's words start (one more entry than rows)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the offset of each; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data | ((data - np.uint8(65) < 26).view(np.uint8) << 5)


def split(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of rows whose bytes lie between consecutive offsets."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(0, U64), np.zeros(len(offsets), np.int64))
    space = (data == 32) | (data - np.uint8(9) < 5)
    first, last = ~space, ~space
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    full = offsets[1:] > offsets[:-1]
    head, tail = offsets[:-1][full], offsets[1:][full] - 1
    first[head] = ~space[head]
    last[tail] = ~space[tail]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, starts, ends, _hashes(data, starts, ends), np.searchsorted(starts, offsets))


#: Bytes of a word whose values come from a table; those behind are worked out.
_NEAR = 64
_TABLE = mix(np.arange(_NEAR * 256, dtype=U64) * _P + U64(0x632BE59BD9B4E019))


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of a random number for each byte at its place in the word, in stretches that end between words.

    No arithmetic of bytes is left in it that words could be made to cancel, as they can in polynomials modulo 2^64.
    """
    out = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + _SPAN, "right")))
        begin, sizes = starts[at:to] - low, ends[at:to] - starts[at:to]
        first = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
        key = (place << 8) | data[low + place + np.repeat(begin, sizes)]
        value = _TABLE[np.minimum(key, len(_TABLE) - 1)]
        far = np.flatnonzero(place >= _NEAR)
        if len(far):
            value[far] = mix(key[far].astype(U64) * _P + U64(0x632BE59BD9B4E019))
        out[at:to] = np.add.reduceat(value, first)
        at = to
    return mix(out)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; the last k - 1 entries are left out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    factor = np.cumprod(np.full(k, _P))
    total = np.zeros(n, U64)
    for i in range(k):
        total += hashes[i : i + n] * factor[i]
    return mix(total)


def slices(batch: pa.RecordBatch | pa.Table, text: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch | pa.Table]:
    """The batch in runs of rows of about `most` bytes of text, at least one row each."""
    sizes = np.frombuffer(pc.fill_null(pc.binary_length(batch[text]), 0).cast(pa.int64()).to_numpy(zero_copy_only=False), np.int64)
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to

"""Words, lines and hashes of Arrow text columns, computed with numpy on the UTF-8 bytes.

A word is a run of bytes outside ``\\x20`` and ``\\x09-\\x0D``. A null text is an empty one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Text bytes that are worked on at once; bounds a Python worker's memory (one longer text is a slice of its own).
SLICE_BYTES = 1 << 20


def lower(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased, by arithmetic: several times faster than a look-up of each."""
    return data + ((data - np.uint8(65)) < 26).view(np.uint8) * np.uint8(32)


def solid_of(data: np.ndarray) -> np.ndarray:
    """Per byte: not white space."""
    return (data != 32) & ((data - np.uint8(9)) >= 5)


def tidy() -> None:
    """Gives memory that a Python worker no longer needs back to the system; workers wait for other tasks while others run."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of at most ``limit`` text bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(sizes.astype(np.int64)) // limit
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
    tidy()


def utf8_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and the offset of each row in them (one more than rows)."""
    a = pc.fill_null(texts, "").cast(pa.large_binary())
    buffers = a.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    data: np.ndarray  #: bytes of all rows
    offsets: np.ndarray  #: of rows in the bytes
    solid: np.ndarray  #: per byte: not white space
    starts: np.ndarray  #: of words in the bytes
    ends: np.ndarray
    rows: np.ndarray  #: first word of each row, one more than rows

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    @property
    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), self.counts)


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    data, offsets = utf8_bytes(texts)
    if lower:
        data = LOWER[data]
    solid = solid_of(data)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    first = np.flatnonzero(starts)
    return Words(data, offsets, solid, first, np.flatnonzero(ends) + 1, np.searchsorted(first, offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span, eight bytes at a step."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    left = (ends - starts).astype(np.int64)
    h = mix(left.astype(U64) + U64(seed * 0x9E3779B97F4A7C15 % 2**64))
    at, live = starts.astype(np.int64), np.arange(len(starts))
    while len(live):
        keep = np.minimum(left, 8)
        lane = lanes[at] & (~U64(0) >> (U64(64) - U64(8) * keep.astype(U64)))
        h[live] = mix((h[live] ^ lane) + U64(0x9E3779B97F4A7C15))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return h


def windows(hashes: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's windows of ``width`` words, in order, and each row's first; a shorter row has none."""
    counts = np.maximum(np.diff(rows) - width + 1, 0)
    out = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(rows[:-1] - out[:-1], counts) + np.arange(out[-1])
    h = np.zeros(len(at), U64)
    for k in range(width):
        h = mix(h ^ hashes[at + k]) if k else mix(hashes[at])
    return h, out


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between offsets."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def lists(values: np.ndarray, rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(values, kind))


def table(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, schema.field(k).type) for k, c in columns.items()], schema=schema)

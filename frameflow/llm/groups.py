"""Documents in hash groups, and number streams that travel between groups and slices.

Most operators here ask one question of the whole corpus: which keys do others have too?
They work in passes over groups of some megabytes of documents. A pass sends each slice
of the key space one packed row per group; the slice answers with one packed row per
group; the next pass meets the same documents with the answers. Every pass is a
`groupBy` or `cogroup` on the same hash exchange, which Spark writes once and reuses.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import U64

GROUP_BYTES, MOST_GROUP_BYTES = 8 << 20, 128 << 20


def text_bytes(documents: DataFrame, text: str) -> int:
    """UTF-8 bytes of all texts; one aggregation, one row to the driver."""
    return int(documents.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0)


def group_count(total_bytes: int, group_bytes: int = GROUP_BYTES) -> int:
    """Groups of at least `group_bytes`, larger ones (up to 128 MB) in a larger corpus,
    so that the rows between groups and slices stay long."""
    size = max(group_bytes, min(MOST_GROUP_BYTES, 64 * math.isqrt(total_bytes)))
    return max(1, -(-total_bytes // size))


def group_of(n: int, *columns: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def slices(hashes: np.ndarray, n: int) -> np.ndarray:
    """The slice of each hash: equal ranges of its high 32 bits."""
    return ((hashes >> U64(32)) * U64(n)) >> U64(32)


def cuts(sorted_slices: np.ndarray, n: int) -> np.ndarray:
    """Slice s holds the entries cuts[s]:cuts[s + 1]."""
    return np.searchsorted(sorted_slices, np.arange(n + 1))


def pack_gaps(values: np.ndarray) -> bytes:
    """Sorted distinct non-negative integers as differences of 16 or 32 bits; the
    largest value of that width stands for itself and is carried on."""
    if not len(values):
        return b""
    gaps = np.diff(values.astype(np.int64), prepend=np.int64(0))
    kind = np.dtype(np.uint16 if values[-1] < len(values) << 14 else np.uint32)
    top = np.iinfo(kind).max
    over = gaps // top
    out = np.full(int(over.sum()) + len(gaps), top, kind)
    out[np.cumsum(over + 1) - 1] = gaps % top
    return bytes([kind.itemsize]) + out.tobytes()


def unpack_gaps(packed: bytes) -> np.ndarray:
    if not packed:
        return np.zeros(0, np.int64)
    kind = np.dtype(np.uint16 if packed[0] == 2 else np.uint32)
    raw = np.frombuffer(packed, kind, offset=1)
    return np.cumsum(raw, dtype=np.int64)[raw != np.iinfo(kind).max]


def pack_ints(values: np.ndarray) -> bytes:
    """Integers less their minimum, in the narrowest unsigned type."""
    if not len(values):
        return b""
    low = int(values.min())
    spread = int(values.max()) - low
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if spread <= np.iinfo(k).max)
    shifted = (values.astype(np.int64) - np.int64(low)) if spread < 1 << 63 else values.view(U64) - U64(low % (1 << 64))
    return np.int64(low).tobytes() + bytes([np.dtype(kind).itemsize]) + shifted.astype(kind).tobytes()


def unpack_ints(packed: bytes) -> np.ndarray:
    if not packed:
        return np.zeros(0, np.int64)
    low, width = int(np.frombuffer(packed, np.int64, 1)[0]), packed[8]
    raw = np.frombuffer(packed, np.dtype(f"u{width}"), offset=9)
    return (raw.astype(U64) + U64(low % (1 << 64))).view(np.int64)


def pack_planes(values: np.ndarray) -> bytes:
    """Sorted 64-bit values, byte by byte of all: their high bytes compress well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_planes(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(8, -1).T).view(U64).reshape(-1)


def pack_bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unpack_bits(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=n).view(bool)

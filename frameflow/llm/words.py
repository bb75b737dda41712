"""Words and windows of whole texts as flat numpy arrays, straight from Arrow buffers.

A batch of texts is one byte array with offsets. Words are runs of bytes other than
0x20 and 0x09 to 0x0D; they never cross texts. A null text is an empty one.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .worker import kept

U64 = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
STEP = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
WORD_RADIX, WINDOW_RADIX = 0xD6E8FEB86659FD93, 0x0A0761D6478BD642F % ((1 << 61) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (two multiply and shift rounds); a bijection."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def byte_values(lane: int, lower: bool) -> np.ndarray:
    """A random 64-bit value per byte; with `lower`, A-Z share those of a-z."""
    values = mix(np.arange(1, 257, dtype=U64) * U64(STEP) + U64(lane * 0x51_7CC1))
    if lower:
        values[65:91] = values[97:123]
    return values


def powers(radix: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """radix**i and its inverse modulo 2**64 for i < n, kept between calls."""
    tables = kept("powers", dict)
    have = tables.get(radix)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        pair = []
        for base in (radix, pow(radix, -1, 1 << 64)):
            out = np.full(size, base, U64)
            out[0] = 1
            pair.append(np.multiply.accumulate(out))
        have = tables[radix] = (pair[0], pair[1])
    return have[0][:n], have[1][:n]


def span_sums(values: np.ndarray, radix: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each [start, end): sum of values[j] * radix**(j - start), modulo 2**64."""
    up, down = powers(radix, len(values) + 1)
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[:-1], out=total[1:])
    return (total[end] - total[start]) * down[start]


P61 = (1 << 61) - 1
#: Blocks of a word beyond which it is digested.
MOST_BLOCKS = 64


def reduced(x: np.ndarray) -> np.ndarray:
    """Any 64-bit values modulo 2**61 - 1."""
    x = (x & U64(P61)) + (x >> U64(61))
    return np.where(x >= U64(P61), x - U64(P61), x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2**61 - 1 of values below it, by halves of 30 and 31 bits."""
    a1, a0, b1, b0 = a >> U64(31), a & U64(0x7FFFFFFF), b >> U64(31), b & U64(0x7FFFFFFF)
    mid = a1 * b0 + a0 * b1
    return reduced(((a1 * b1) << U64(1)) + (mid >> U64(30)) + ((mid & U64(0x3FFFFFFF)) << U64(31)) + a0 * b0)


def prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """WINDOW_RADIX**i and its inverse modulo 2**61 - 1 for i < n, kept between calls."""
    tables = kept("prime_powers", dict)
    have = tables.get("pair")
    if have is None or len(have[0]) < n:
        pair = []
        for base in (WINDOW_RADIX % P61, pow(WINDOW_RADIX, -1, P61)):
            out = np.ones(1, U64)
            while len(out) < max(n, 1 << 16):
                out = np.concatenate([out, times(out, np.full(1, pow(base, len(out), P61), U64))])
            pair.append(out)
        have = tables["pair"] = (pair[0], pair[1])
    return have[0][:n], have[1][:n]


def prime_sums(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each [start, end): sum of values[j] * WINDOW_RADIX**(j - start) modulo 2**61 - 1.
    Unlike a modulus that is a power of two, this one has no sequences that equal
    their mirror for any radix."""
    up, down = prime_powers(len(values) + 1)
    terms = times(reduced(values), up[:-1])
    low, high = np.zeros(len(values) + 1, U64), np.zeros(len(values) + 1, U64)
    np.cumsum(terms & U64(0xFFFFFFFF), out=low[1:])
    np.cumsum(terms >> U64(32), out=high[1:])
    top = high[end] - high[start]  # times 2**32, of which 2**61 counts as 1
    total = reduced(low[end] - low[start]) + (top >> U64(29)) + ((top & U64((1 << 29) - 1)) << U64(32))
    return times(reduced(total), down[start])


def byte_digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=16).digest(), "little")


def slice_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of a digest of data[start:end] of each slice; slices follow each other, don't
    overlap and aren't empty. Each distinct one is digested once."""
    if not len(start):
        return np.zeros(0, U64)
    mark = np.zeros(len(data) + 1, np.int8)
    mark[start] += 1
    mark[end] -= 1
    packed = data[np.cumsum(mark[:-1], dtype=np.int8).astype(bool)]
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(packed))]).dictionary_encode()
    out = np.array([byte_digest(piece) & 0xFFFFFFFFFFFFFFFF for piece in found.dictionary.to_pylist()], U64)
    return out[found.indices.to_numpy(zero_copy_only=False)]


@dataclass
class Texts:
    """Texts laid end to end: text i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    """Bytes and offsets of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        column = pa.array([], pa.binary())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, at, raw = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(at, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return Texts(data, offsets - offsets[0])


def pieces(texts: Texts, limit: int = 1 << 20):
    """(first text, its Texts) with about `limit` bytes each; one text is never split."""
    first, n = 0, len(texts)
    while first < n:
        last = int(np.searchsorted(texts.offsets, texts.offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        lo, hi = texts.offsets[first], texts.offsets[last]
        yield first, Texts(texts.data[lo:hi], texts.offsets[first:last + 1] - lo)
        first = last


@dataclass
class Words:
    """Word i is data[start[i]:end[i]]; text t has the words first[t]:first[t + 1]."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def split_words(texts: Texts) -> Words:
    n = len(texts.data)
    if not n:
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64))
    inside = ~SPACE[texts.data]
    edge = np.zeros(n + 1, bool)
    edge[texts.offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(start, end, np.searchsorted(start, texts.offsets))


def word_hashes(texts: Texts, words: Words, lane: int = 0, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes; `lane` selects an independent function.

    A word is a polynomial modulo 2**61 - 1 of blocks of seven bytes, which tells short
    words apart for certain; words of many blocks go by a digest.
    """
    if not len(words.start):
        return np.zeros(0, U64)
    size = words.end - words.start
    padded = np.concatenate([LOWER[texts.data] if lower else texts.data, np.zeros(8, np.uint8)])
    at_byte = np.ndarray((len(texts.data) + 1,), "<u8", padded, strides=(1,))
    radix, power = (WORD_RADIX >> (3 + lane)) | 1, 1
    sums, left = np.zeros(len(size), U64), np.arange(len(size))
    for block in range(MOST_BLOCKS):
        rest = np.minimum(size[left] - 7 * block, 7).astype(U64)
        value = at_byte[words.start[left] + 7 * block] & ((U64(1) << (rest * U64(8))) - U64(1))
        sums[left] += value if power == 1 else times(value, np.full(1, power, U64))
        sums[left] = reduced(sums[left])
        power = power * radix % P61
        left = left[size[left] > 7 * (block + 1)]
        if not len(left):
            break
    for i in left.tolist():
        sums[i] = byte_digest(padded[words.start[i]:words.end[i]].tobytes()) >> 64 * (lane & 1) & P61
    return mix(sums + size.astype(U64) * U64(STEP))


def rough_hashes(texts: Texts, words: Words) -> np.ndarray:
    """A cheaper hash, for sketches alone: different words may be built to share one."""
    if not len(words.start):
        return np.zeros(0, U64)
    sums = span_sums(byte_values(0, False)[texts.data], WORD_RADIX, words.start, words.end)
    return mix(sums + (words.end - words.start).astype(U64) * U64(STEP))


def rough_windows(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    return mix(span_sums(hashes, WORD_RADIX, at, at + k)) if len(at) else np.zeros(0, U64)


def joined_words(texts: Texts, words: Words) -> tuple[bytes, np.ndarray]:
    """All words with one space behind each, and where each word begins."""
    length = words.end - words.start + 1
    total = np.cumsum(length)
    if not len(length):
        return b"", np.zeros(0, np.int64)
    padded = np.append(texts.data, np.uint8(0x20))
    joined = padded[np.repeat(words.start - total + length, length) + np.arange(int(total[-1]))]
    joined[total - 1] = 0x20
    return joined.tobytes(), total - length


def window_digests(texts: Texts, words: Words, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of a digest of the k words themselves from each index in `at`, in halves."""
    joined, begin = joined_words(texts, words)
    view = memoryview(joined)
    end = begin + words.end - words.start
    digest = hashlib.blake2b
    found = b"".join([digest(view[a:b], digest_size=16).digest() for a, b in zip(begin[at].tolist(), end[at + k - 1].tolist(), strict=True)])
    both = np.frombuffer(found, "<u8").reshape(-1, 2)
    return both[:, 0].astype(U64), both[:, 1].astype(U64)


def window_starts(words: Words, k: int) -> np.ndarray:
    """Index of the first word of every window of k consecutive words of one text."""
    if len(words.start) < k:
        return np.zeros(0, np.int64)
    at = np.arange(len(words.start))
    room = np.repeat(words.first[1:], words.counts()) - at
    return at[room >= k]


def window_hashes(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k words from each index in `at`."""
    if not len(at):
        return np.zeros(0, U64)
    return mix(prime_sums(hashes, at, at + k))

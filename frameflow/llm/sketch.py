"""Count-min sketches of keys, one per group of documents, merged slice by slice.

A sketch has a few rows of 2**bits counters. A group's sketch is sparse: the sorted
indices of its counters that aren't zero, and their counts (saturating at 255). All
groups' counters of one slice of a row meet in one task, which adds them up and answers
each group for the counters that it sent: the merged count, 0 standing for 1. A merged
counter never underestimates, so a key counted twice is never taken for a single one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .groups import pack_gaps, unpack_gaps
from .words import U64, mix

ROWS = 2
SENT = pa.schema([("_row", pa.int32()), ("_slice", pa.int32()), ("_g", pa.int32()), ("at", pa.binary()), ("n", pa.binary())])
REPLY = pa.schema([("_g", pa.int32()), ("_row", pa.int32()), ("_slice", pa.int32()), ("n", pa.binary())])
SENT_DDL = "_row int, _slice int, _g int, at binary, n binary"
REPLY_DDL = "_g int, _row int, _slice int, n binary"


def width_bits(keys: int) -> int:
    """Counters per row: eight to sixteen for each key, so that a single key is taken
    for a repeated one about once in a hundred times."""
    return max(16, (max(keys, 1) * 8 - 1).bit_length())


def counters(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (hashes if row == 0 else mix(hashes ^ U64(0x5851F42D4C957F2D * row % (1 << 64)))) >> U64(64 - bits)


def slice_starts(n: int, bits: int) -> np.ndarray:
    """First counter of each slice, and the end."""
    return np.array([(s << bits) // n for s in range(n + 1)], np.int64)


def sent_rows(g: int, hashes: np.ndarray, n_slices: int, bits: int, rows: int = ROWS) -> pa.Table:
    """A group's sketch of `hashes`, one row per sketch row and slice."""
    out: dict[str, list] = {name: [] for name in SENT.names}
    starts = slice_starts(n_slices, bits)
    for row in range(rows):
        index, count = np.unique(counters(hashes, row, bits), return_counts=True)
        index, count = index.astype(np.int64), np.minimum(count, 255).astype(np.uint8)
        edge = np.searchsorted(index, starts)
        for s in np.flatnonzero(np.diff(edge)):
            part = slice(edge[s], edge[s + 1])
            for name, value in zip(SENT.names, (row, int(s), g, pack_gaps(index[part] - starts[s]), count[part].tobytes()), strict=True):
                out[name].append(value)
    return pa.table(out, schema=SENT)


def merge_slice(table: pa.Table) -> pa.Table:
    """One slice of one row from all groups: the merged counts, back to each group."""
    at = [unpack_gaps(x) for x in table["at"].to_pylist()]
    n = [np.frombuffer(x, np.uint8) for x in table["n"].to_pylist()]
    index, inverse = np.unique(np.concatenate(at), return_inverse=True)
    total = np.minimum(np.bincount(inverse, np.concatenate(n), len(index)), 255).astype(np.uint8)
    total[total == 1] = 0
    answers = np.split(total[inverse], np.cumsum([len(x) for x in at])[:-1])
    return pa.table({"_g": table["_g"], "_row": table["_row"], "_slice": table["_slice"],
                     "n": [x.tobytes() for x in answers]}, schema=REPLY)


def merged_counts(hashes: np.ndarray, replies: pa.Table, bits: int, rows: int = ROWS) -> np.ndarray:
    """For each of the group's keys the smallest of its merged counters (0 for 1; 255 and
    more as 255). `hashes` are those that the group's sketch was made of."""
    least = np.full(len(hashes), 255, np.uint8)
    for row in range(rows):
        _, inverse = np.unique(counters(hashes, row, bits), return_inverse=True)
        mine = [(s, n) for r, s, n in zip(*(replies[c].to_pylist() for c in ("_row", "_slice", "n")), strict=True) if r == row]
        merged = np.frombuffer(b"".join(n for _, n in sorted(mine)), np.uint8)
        if len(hashes):
            least = np.minimum(least, merged[inverse])
    return least


def corpus_sketch(groups: DataFrame, keys: Callable[[pa.Table], np.ndarray], n_slices: int, bits: int,
                  rows: int = ROWS) -> DataFrame:
    """Answers (`REPLY`) for each group of `groups` (_g, ...); `keys` takes the hashes
    of a group's rows and must give the same ones whenever it is called."""
    def send(key: tuple, table: pa.Table) -> pa.Table:
        return sent_rows(key[0].as_py(), keys(table), n_slices, bits, rows)
    return (groups.groupBy("_g").applyInArrow(send, SENT_DDL)
            .groupBy("_row", "_slice").applyInArrow(merge_slice, REPLY_DDL))

"""Packing documents into sequences by linear grouping, configurations and best fit.

The plan needs only how many pieces there are of each length, at most `capacity`
numbers, however large the corpus: lengths are planned on the driver by counts, pieces
find their places by joins. A planned run says: the pieces of one length with ranks
first, first + 1, ... go to sequences at, at + 1, ... at one offset.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import BROADCAST_ROWS, checkpoint
from .tokens import byte_encoder

CAPACITY, END_ID = 2048, 0
#: Pieces longer than 1 / SMALL of a sequence count as large; they form up to GROUPS groups.
SMALL, GROUPS = 8, 80
#: Pieces of one length are numbered in this many parts, so that no length is one task.
PARTS = 64


def linear_groups(lengths: np.ndarray, counts: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Groups of equal cardinality over pieces in descending length: (the length that each
    group is rounded up to, its cardinality); groups of the same length are one."""
    total = int(counts.sum())
    size = -(-total // groups)
    ends = np.cumsum(counts)
    firsts = np.arange(0, total, size)
    tops = lengths[np.searchsorted(ends, firsts, "right")]
    cards = np.minimum(firsts + size, total) - firsts
    kept = np.flatnonzero(np.diff(tops, prepend=-1))
    return tops[kept], np.add.reduceat(cards, kept)


def best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of greatest worth: a knapsack over all capacities, one piece more
    in each step."""
    rooms = np.arange(capacity + 1)[None, :] - sizes[:, None]
    value, choices = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        gains = np.where(rooms >= 0, worth[:, None] + value[np.maximum(rooms, 0)], -1.0)
        choice = np.argmax(gains, axis=0)
        better = gains[choice, np.arange(capacity + 1)]
        choices.append(np.where(better > value + 1e-12, choice, -1))
        value = np.maximum(value, better)
    pattern, room = np.zeros(len(sizes)), capacity
    for choice in reversed(choices):
        if choice[room] >= 0:
            pattern[choice[room]] += 1
            room -= int(sizes[choice[room]])
    return float(value[capacity]), pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(pieces of each size in one sequence, sequences) of the fractional optimum, rounded
    down: the linear program over configurations, by column generation."""
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(20 * len(sizes)):
        worth = np.linalg.solve(basis.T, np.ones(len(sizes)))
        value, column = best_pattern(sizes, worth, capacity)
        if value <= 1 + 1e-3:
            break
        amounts, change = np.linalg.solve(basis, demand), np.linalg.solve(basis, column)
        ratio = np.where(change > 1e-9, np.maximum(amounts, 0) / np.maximum(change, 1e-9), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    uses = np.floor(np.maximum(np.linalg.solve(basis, demand), 0) + 1e-9).astype(int)
    left, chosen = demand.astype(int).copy(), []
    for column, use in zip(basis.T.round().astype(int), uses, strict=True):
        need = column > 0
        use = min([int(use), *(left[need] // column[need])])
        if use > 0:
            left -= column * use
            chosen.append((column, use))
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY, *, groups: int = GROUPS) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, offset) that place `counts`
    pieces of each length 1..capacity into sequences of at most `capacity`."""
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError("a piece is empty or longer than a sequence")
    lengths = np.array(sorted((x for x, n in counts.items() if n > 0), reverse=True), int)
    if not len(lengths):
        return []
    amount = np.array([counts[x] for x in lengths.tolist()], int)
    large = int(np.searchsorted(-lengths, -(capacity // SMALL), "left"))
    runs: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[list[int]]] = {}  # room left -> [first sequence, sequences]
    rest: dict[int, list[list[int]]] = {}  # length -> [first rank, pieces] not placed yet
    opened = 0
    if large:
        sizes, demand = linear_groups(lengths[:large], amount[:large], groups)
        ends = np.concatenate([[0], np.cumsum(amount[:large])])
        at = np.concatenate([[0], np.cumsum(demand)])[:-1].copy()  # next piece of each group
        stop = at + demand

        def spans(lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
            """(length, first rank, pieces) of the large pieces lo..hi in descending order."""
            i = int(np.searchsorted(ends, lo, "right")) - 1
            while lo < hi:
                top = min(hi, int(ends[i + 1]))
                yield int(lengths[i]), lo - int(ends[i]), top - lo
                lo, i = top, i + 1
        for column, use in configurations(sizes, demand.astype(float), capacity):
            slots = []
            for j in np.flatnonzero(column):
                for _ in range(column[j]):
                    slots.append(list(spans(int(at[j]), int(at[j]) + use)))
                    at[j] += use
            edges = sorted({0, use} | {int(x) for slot in slots for x in np.cumsum([n for *_, n in slot])})
            where = [[0, 0] for _ in slots]  # span and pieces of it used, per slot
            for lo, hi in zip(edges, edges[1:], strict=False):
                offset = 0
                for slot, place in zip(slots, where, strict=True):
                    length, first, n = slot[place[0]]
                    runs.append((length, first + place[1], hi - lo, opened + lo, offset))
                    offset += length
                    place[1] += hi - lo
                    if place[1] == n:
                        place[:] = [place[0] + 1, 0]
                room.setdefault(capacity - offset, []).append([opened + lo, hi - lo])
            opened += use
        for j in range(len(sizes)):
            for length, first, n in spans(int(at[j]), int(stop[j])):
                rest.setdefault(length, []).append([first, n])
    for length, n in zip(lengths[large:].tolist(), amount[large:].tolist(), strict=True):
        rest.setdefault(length, []).append([0, n])
    # best fit, longest first: the tightest sequences that still hold the length
    open_rooms = sorted(room)
    for length in sorted(rest, reverse=True):
        for first, n in rest[length]:
            while n:
                i = int(np.searchsorted(open_rooms, length))
                if i == len(open_rooms):
                    fresh = -(-n // (capacity // length))
                    room[capacity] = [[opened, fresh]]
                    open_rooms.append(capacity)
                    opened += fresh
                    continue
                tight = open_rooms[i]
                start, have = room[tight].pop()
                take = min(n, have)
                if take < have:
                    room[tight].append([start + take, have - take])
                if not room[tight]:
                    del room[tight], open_rooms[i]
                runs.append((length, first, take, start, capacity - tight))
                left = tight - length
                if left:
                    if left not in room:
                        room[left] = []
                        insort(open_rooms, left)
                    room[left].append([start, take])
                first, n = first + take, n - take
    return runs


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: whole if it fits, else full pieces after a first
    one that holds what is left over."""
    if n <= capacity:
        return [n]
    return [n % capacity] * bool(n % capacity) + [capacity] * (n // capacity)


def pieces_of(documents: DataFrame, key: str, text: str, capacity: int, tokenizer: str | None, keep_ids: bool) -> DataFrame:
    """key, piece, start, length, ids_crc32 and, if asked for, ids (little-endian uint32)."""
    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_encoder(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for name, value in zip(batch["key"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = encode(value or "") + END_ID.to_bytes(4, "little")
                start = 0
                for i, length in enumerate(cut_lengths(len(ids) // 4, capacity)):
                    part = ids[4 * start:4 * (start + length)]
                    rows.append((name, i, start, length, zlib.crc32(part), part if keep_ids else None))
                    start += length
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             ["key", "piece", "start", "length", "ids_crc32", "ids"])
    rows = documents.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    out = rows.mapInArrow(tokenize, "key long, piece int, start long, length long, ids_crc32 long, ids binary")
    return out if keep_ids else out.drop("ids")


def pack(documents: DataFrame, key: str = "doc_id", text: str = "text", *, capacity: int = CAPACITY,
         tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Pack all documents into few sequences of at most `capacity` tokens.

    Result, one row per piece: key, piece (from 0), start (ids of the document before
    it), length, ids_crc32, sequence_id, offset (gapless from 0 in each sequence) and
    with `keep_ids` the ids. Each document ends with id 0; a null or empty text is that
    id alone. Only longer documents are cut. Rows with a null key are packed as well;
    repeated rows are packed each. An empty table gives no rows. Other columns are
    ignored.

    The linear grouping scheme: pieces over an eighth of a sequence, in descending
    length, form up to GROUPS groups of equal cardinality and are rounded up to the
    longest of their group; the linear program over the configurations of these few
    sizes is solved and rounded down; actual pieces take the places of their group;
    what is left, and all small pieces, go by best fit, the longest first.
    """
    rows = checkpoint(pieces_of(documents, key, text, capacity, tokenizer, keep_ids))
    part = F.pmod(F.xxhash64("key", "piece", "ids_crc32"), F.lit(PARTS)).cast("int")
    rows = rows.withColumn("_part", part)
    amounts = rows.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    counts = {r[0]: r[1] for r in amounts.groupBy("length").agg(F.sum("_n")).collect()}  # at most `capacity` rows
    spark = documents.sparkSession
    runs = plan(counts, capacity)
    planned = spark.createDataFrame(runs, "length long, _first long, _count long, _at long, offset long")
    if len(runs) <= BROADCAST_ROWS:
        planned = F.broadcast(planned)
    before = amounts.withColumn("_before", F.sum("_n").over(
        Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).drop("_n")
    order = Window.partitionBy("length", "_part").orderBy("key", "piece", "ids_crc32")
    ranked = (rows.withColumn("_i", F.row_number().over(order) - 1).join(before, ["length", "_part"])
              .withColumn("_rank", F.col("_before") + F.col("_i")))
    placed = ranked.join(planned, (ranked["length"] == planned["length"])
                         & F.col("_rank").between(F.col("_first"), F.col("_first") + F.col("_count") - 1)).drop(planned["length"])
    return placed.select(F.col("key").alias(key), "piece", "start", "length", "ids_crc32",
                         (F.col("_at") + F.col("_rank") - F.col("_first")).alias("sequence_id"), "offset",
                         *(["ids"] if keep_ids else []))

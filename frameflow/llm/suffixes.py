"""Substring dedup by bytes: suffix arrays over what fingerprints cannot decide.

Each window of LENGTH bytes has an anchor: of its ANCHOR-byte pieces the one with the
least hash, the first of several. Equal windows have equal anchors at the same place, so
an anchor that occurs once rules out all its windows, and windows meet by their anchor's
hash. Neighbouring windows with one anchor form a run. A run whose whole text occurs
twice is repeated throughout; what remains are runs at the borders of copies. Their
texts go to the shard of their anchor, where a suffix array and common prefixes decide.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import cuts, group_count, group_of, pack_bits, pack_ints, pack_planes, slices, text_bytes, unpack_bits, unpack_ints, unpack_planes
from .words import U64, WORD_RADIX, Texts, byte_values, mix, pieces, powers, texts_of

LENGTH, ANCHOR = 200, 64
#: Bits of a place within a piece of text; the hash's others choose the anchor.
PLACE_BITS = 30
#: An anchor with more distinct runs isn't left to one shard: its windows are sent as
#: sorted fingerprints to ranges of these, and merged there by binary search.
HOT_RUNS = 2000
#: Shards of texts for each slice of anchors: suffix arrays take some 50 bytes a byte.
SHARDS = 4
SEPARATOR = 0xFF  # in no UTF-8 text
REPEATED, SEND, HOT = 1, 2, 4


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` consecutive values: prefix and suffix minima of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width + width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    head = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(tail[:n], head[width - 1:width - 1 + n])


@dataclass
class Runs:
    """Windows first..last (starts in the group's bytes) with one anchor, its hash (mixed
    again, since the least of many lie low), and the fingerprint of the run's text."""

    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    mark: np.ndarray


def runs_of(texts: Texts, length: int, width: int) -> Runs:
    found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, U64)], [np.zeros(0, U64)]]
    mask = U64((1 << PLACE_BITS) - 1)
    for index, part in pieces(texts):
        n = len(part.data)
        if n < length:
            continue
        if n > int(mask):
            raise ValueError(f"a text has more than 2**{PLACE_BITS} bytes")
        up, down = powers(WORD_RADIX, n + 1)
        total = np.zeros(n + 1, U64)
        np.cumsum(byte_values(3, False)[part.data] * up[:-1], out=total[1:])
        hashes = mix((total[width:] - total[:-width]) * down[:n - width + 1])
        chosen = sliding_least(hashes & ~mask | np.arange(len(hashes), dtype=U64), length - width + 1)[:n - length + 1] & mask
        ends = np.repeat(part.offsets[1:], np.diff(part.offsets))[:n - length + 1]
        start = np.flatnonzero(np.arange(n - length + 1) + length <= ends)
        if not len(start):
            continue
        place = chosen[start].astype(np.int64)
        new = np.ones(len(start), bool)
        new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
        first = start[new]
        last = start[np.append(np.flatnonzero(new)[1:], len(start)) - 1]
        size = (last + length - first).astype(U64)
        mark = mix((total[last + length] - total[first]) * down[first] + size)
        base = texts.offsets[index]
        for into, value in zip(found, (first + base, last + base, mix(hashes[place[new]]), mark), strict=True):
            into.append(value)
    return Runs(*(np.concatenate(x) for x in found))


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of `text` in the order of what follows them. Larsson and Sadakane: groups of
    equal beginnings are refined by the rank of what stands as far behind again, and
    places that are alone in their group are left as they are."""
    n = len(text)
    key = np.zeros(n, U64)
    for i in range(7):  # seven bytes of nine bits: the end of the text sorts first
        key <<= U64(9)
        key[:n - i] |= text[i:] + U64(1)
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    edge = np.ones(n, bool)
    edge[1:] = key[1:] != key[:-1]
    rank = np.full(n + 1, -1, np.int32)
    rank[order] = np.flatnonzero(edge).astype(np.int32)[np.cumsum(edge, dtype=np.int32) - 1]
    del key
    known = 7
    while True:
        alone = edge & np.append(edge[1:], True)
        open_at = np.flatnonzero(~alone).astype(np.int32)
        if not len(open_at):
            break
        suffix = order[open_at]
        both = rank[suffix].astype(np.int64) << 32
        both |= rank[np.minimum(suffix + known, n)] + np.int64(1)
        again = np.argsort(both, kind="stable")
        suffix, both = suffix[again], both[again]
        order[open_at] = suffix
        new = np.ones(len(suffix), bool)
        new[1:] = both[1:] != both[:-1]
        edge[open_at] = new
        rank[suffix] = open_at[np.flatnonzero(new)][np.cumsum(new, dtype=np.int32) - 1]
        known = min(2 * known, n)
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, first: np.ndarray, count: np.ndarray, most: int) -> np.ndarray:
    """For places first..first + count - 1 of every chain: the length, up to `most`, that
    each shares with its predecessor in `order`, chain after chain. Kasai's rule: the next
    place of a chain shares at most one byte less, so only the rest is compared. All
    chains go on together."""
    n = len(text)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    base = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.int32)
    length = np.zeros(len(first), np.int64)
    padded = np.append(text, np.zeros(most, text.dtype))
    for step in range(int(count.max(initial=0))):
        live = np.flatnonzero(count > step)
        here = first[live] + step
        there = before[here]
        shared = np.where(there < 0, 0, np.maximum(length[live] - 1, 0))
        going = np.flatnonzero((there >= 0) & (shared < most))
        while len(going):
            a, b = here[going] + shared[going], there[going] + shared[going]
            same = (padded[a] == padded[b]) & (a < n) & (b < n)
            going = going[same]
            shared[going] += 1
            going = going[shared[going] < most]
        length[live] = shared
        out[base[live] + step] = shared
    return out


def repeated_windows(text: np.ndarray, first: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """Which windows, chain after chain, also start at another place of `text`."""
    order = suffix_array(text)
    shared = common_prefixes(text, order, first, count, length)
    starts = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    hit = shared >= length
    out = hit.copy()
    # the predecessor shares it as well
    before = np.full(len(text), -1, np.int32)
    before[order[1:]] = order[:-1]
    number = np.full(len(text), -1, np.int32)
    number[starts] = np.arange(len(starts))
    out[number[before[starts[hit]]]] = True
    return out


def sorted_pairs(runs: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (anchor, mark) in anchor order: their anchors, marks, whether they occur
    twice in the group, and of each run the number of its pair."""
    order = np.lexsort((runs.mark, runs.anchor))
    a, m = runs.anchor[order], runs.mark[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (m[1:] != m[:-1])
    number = np.empty(len(a), np.int64)
    number[order] = np.cumsum(new) - 1
    many = np.bincount(number, minlength=int(new.sum())) > 1
    return a[new], m[new], many, number


def judge_runs(table: pa.Table, hot_runs: int) -> pa.Table:
    """Status of the pairs that each group sent: REPEATED, and SEND where the run's text
    is needed (from the first group that has it), HOT if its anchor has too many."""
    anchors = [unpack_planes(x) for x in table["anchors"].to_pylist()]
    sizes = [len(x) for x in anchors]
    anchor = np.concatenate(anchors)
    mark = np.concatenate([np.frombuffer(x, U64) for x in table["marks"].to_pylist()])
    many = np.concatenate([unpack_bits(x, n) for x, n in zip(table["many"].to_pylist(), sizes, strict=True)])
    owner = np.repeat(np.asarray(table["_g"]), sizes)
    order = np.lexsort((owner, mark, anchor))
    a, m = anchor[order], mark[order]
    new_a = np.ones(len(a), bool)
    new_a[1:] = a[1:] != a[:-1]
    new = new_a.copy()
    new[1:] |= m[1:] != m[:-1]
    pair, group = np.cumsum(new) - 1, np.cumsum(new_a) - 1
    twice = (np.bincount(pair) > 1) | (np.bincount(pair, many[order]) > 0)
    distinct = np.bincount(group, new)
    undecided = np.bincount(group, new & ~twice[pair])
    wanted = (distinct[group] > 1) & (undecided[group] > 0)
    status = REPEATED * twice[pair] + SEND * (wanted & new) + HOT * (wanted & (distinct[group] > hot_runs))
    out = np.empty(len(order), np.uint8)
    out[order] = status
    parts = np.split(out, np.cumsum(sizes)[:-1])
    return pa.table({"_g": table["_g"], "_kind": pa.array([0] * len(parts), pa.int32()), "_slice": table["_slice"],
                     "said": pa.array([x.tobytes() for x in parts], pa.binary())})


def search_texts(table: pa.Table, length: int) -> pa.Table:
    """A shard: which windows of the texts that were sent occur twice among them."""
    sizes = [unpack_ints(x) for x in table["sizes"].to_pylist()]
    size = np.concatenate(sizes)
    raw = np.frombuffer(b"".join(table["data"].to_pylist()), np.uint8)
    ends = np.cumsum(size + 1)
    text = np.full(int(ends[-1]), SEPARATOR, np.uint8)
    inside = np.ones(len(text), bool)
    inside[ends - 1] = False
    text[inside] = raw
    count = size - length + 1
    flags = repeated_windows(text, ends - 1 - size, count, length)
    total = np.cumsum([int((x - length + 1).sum()) for x in sizes])
    return pa.table({"_g": table["_g"], "_kind": pa.array([1] * len(sizes), pa.int32()), "_slice": table["_slice"],
                     "said": pa.array([pack_bits(x) for x in np.split(flags, total[:-1])], pa.binary())})


def merge_marks(table: pa.Table) -> pa.Table:
    """A range of hot windows' fingerprints: those in several groups' sorted lists, or
    twice in one, found by binary search in the merged order."""
    lists = [unpack_planes(x) for x in table["data"].to_pylist()]
    merged = np.sort(np.concatenate(lists), kind="stable")
    said = [pack_bits(np.searchsorted(merged, x, "right") - np.searchsorted(merged, x, "left") > 1) for x in lists]
    return pa.table({"_g": table["_g"], "_kind": pa.array([2] * len(lists), pa.int32()), "_slice": table["_slice"],
                     "said": pa.array(said, pa.binary())})


def window_marks(texts: Texts, starts: np.ndarray, length: int) -> np.ndarray:
    """Fingerprints of single windows."""
    out = np.zeros(len(starts), U64)
    for index, part in pieces(texts):
        lo, hi = texts.offsets[index], texts.offsets[index] + len(part.data)
        at = np.flatnonzero((starts >= lo) & (starts < hi))
        if len(at):
            up, down = powers(WORD_RADIX, len(part.data) + 1)
            total = np.zeros(len(part.data) + 1, U64)
            np.cumsum(byte_values(4, False)[part.data] * up[:-1], out=total[1:])
            p = starts[at] - lo
            out[at] = mix((total[p + length] - total[p]) * down[p])
    return out


def spread_windows(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    count = last - first + 1
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def remove_repeated_bytes(documents: DataFrame, key: str = "doc_id", text: str = "text", *, length: int = LENGTH,
                          anchor: int = ANCHOR, hot_runs: int = HOT_RUNS) -> DataFrame:
    """Remove each byte covered by a string of `length` bytes that also starts anywhere
    else, in the same document or another; overlapping places count, and strings are
    judged on the input.

    Result, one row per input row: key, n_bytes, n_removed, n_spans (maximal removed
    runs) and kept (binary: the other bytes; a cut may part a character). A null text is
    empty; texts under `length` bytes keep all. Null keys and repeated rows count like
    others, so a repeated row of `length` bytes or more loses all. Other columns are
    ignored. Texts of over 2**30 bytes are refused.

    Whole runs are compared by 64-bit fingerprints, their borders byte by byte; where an
    anchor has over `hot_runs` distinct runs, windows are compared by fingerprints, too.
    """
    n = group_count(text_bytes(documents, text))
    rows = documents.select(group_of(n, F.col(key), F.col(text)).alias("_g"), F.col(key).cast("long").alias("key"),
                            F.col(text).cast("string").alias("text"))

    def own(table: pa.Table):
        texts = texts_of(table["text"])
        runs = runs_of(texts, length, anchor)
        pairs = sorted_pairs(runs)
        return texts, runs, pairs, cuts(slices(pairs[0], n), n)

    def ask(group: tuple, table: pa.Table) -> pa.Table:
        _, _, (anchors, marks, many, _), edge = own(table)
        parts = [(int(s), slice(edge[s], edge[s + 1])) for s in np.flatnonzero(np.diff(edge))]
        return pa.table({"_slice": pa.array([s for s, _ in parts], pa.int32()), "_g": pa.array([group[0].as_py()] * len(parts), pa.int32()),
                         "anchors": pa.array([pack_planes(anchors[p]) for _, p in parts], pa.binary()),
                         "marks": pa.array([marks[p].tobytes() for _, p in parts], pa.binary()),
                         "many": pa.array([pack_bits(many[p]) for _, p in parts], pa.binary())})
    statuses = (rows.groupBy("_g").applyInArrow(ask, "_slice int, _g int, anchors binary, marks binary, many binary")
                .groupBy("_slice").applyInArrow(lambda t: judge_runs(t, hot_runs), "_g int, _kind int, _slice int, said binary"))

    def status_of(edge: np.ndarray, reply: pa.Table) -> np.ndarray:
        said = sorted((s, x) for k, s, x in zip(*(reply[c].to_pylist() for c in ("_kind", "_slice", "said")), strict=True) if k == 0)
        return np.frombuffer(b"".join(x for _, x in said), np.uint8) if said else np.zeros(0, np.uint8)

    def sent_runs(runs: Runs, pairs: tuple, status: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(runs whose text is sent, runs whose windows are sent), in pair order."""
        number = pairs[3]
        of_pair = np.full(len(status), -1)
        of_pair[number[::-1]] = np.arange(len(number))[::-1]  # the first run of each pair
        wanted = status & SEND > 0
        return of_pair[wanted & (status & HOT == 0)], of_pair[wanted & (status & HOT > 0)]

    def hot_windows(texts: Texts, runs: Runs, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window starts, fingerprints, order of these)."""
        starts = spread_windows(runs.first[hot], runs.last[hot])
        marks = window_marks(texts, starts, length)
        return starts, marks, np.argsort(marks, kind="stable")

    def give(group: tuple, table: pa.Table, reply: pa.Table) -> pa.Table:
        texts, runs, pairs, edge = own(table)
        plain, hot = sent_runs(runs, pairs, status_of(edge, reply))
        out: dict[str, list] = {c: [] for c in ("_kind", "_slice", "sizes", "data")}
        where = cuts(slices(runs.anchor[plain], SHARDS * n), SHARDS * n)
        for s in np.flatnonzero(np.diff(where)):
            chosen = plain[where[s]:where[s + 1]]
            size = runs.last[chosen] + length - runs.first[chosen]
            for c, x in zip(out, (1, int(s), pack_ints(size), texts.data[spread_windows(runs.first[chosen], runs.first[chosen] + size - 1)].tobytes()), strict=True):
                out[c].append(x)
        _, marks, order = hot_windows(texts, runs, hot)
        marks = marks[order]
        where = cuts(slices(marks, n), n)
        for s in np.flatnonzero(np.diff(where)):
            for c, x in zip(out, (2, int(s), b"", pack_planes(marks[where[s]:where[s + 1]])), strict=True):
                out[c].append(x)
        return pa.table({"_kind": pa.array(out["_kind"], pa.int32()), "_slice": pa.array(out["_slice"], pa.int32()),
                         "_g": pa.array([group[0].as_py()] * len(out["_kind"]), pa.int32()),
                         "sizes": pa.array(out["sizes"], pa.binary()), "data": pa.array(out["data"], pa.binary())})

    def decide(group: tuple, table: pa.Table) -> pa.Table:
        return search_texts(table, length) if group[0].as_py() == 1 else merge_marks(table)
    windows = (rows.groupBy("_g").cogroup(statuses.groupBy("_g")).applyInArrow(give, "_kind int, _slice int, _g int, sizes binary, data binary")
               .groupBy("_kind", "_slice").applyInArrow(decide, "_g int, _kind int, _slice int, said binary"))

    def cut(group: tuple, table: pa.Table, reply: pa.Table) -> pa.Table:
        texts, runs, pairs, edge = own(table)
        status = status_of(edge, reply)
        plain, hot = sent_runs(runs, pairs, status)
        said = {(k, s): x for k, s, x in zip(*(reply[c].to_pylist() for c in ("_kind", "_slice", "said")), strict=True)}
        change = np.zeros(len(texts.data) + 1, np.int32)

        def cover(first: np.ndarray, end: np.ndarray) -> None:
            np.add.at(change, first, 1)
            np.add.at(change, end, -1)
        whole = status[pairs[3]] & REPEATED > 0
        cover(runs.first[whole], runs.last[whole] + length)
        where = cuts(slices(runs.anchor[plain], SHARDS * n), SHARDS * n)
        for s in np.flatnonzero(np.diff(where)):
            chosen = plain[where[s]:where[s + 1]]
            starts = spread_windows(runs.first[chosen], runs.last[chosen])
            hit = starts[unpack_bits(said[1, int(s)], len(starts))]
            cover(hit, hit + length)
        starts, marks, order = hot_windows(texts, runs, hot)
        where = cuts(slices(marks[order], n), n)
        for s in np.flatnonzero(np.diff(where)):
            chosen = order[where[s]:where[s + 1]]
            hit = starts[chosen[unpack_bits(said[2, int(s)], len(chosen))]]
            cover(hit, hit + length)
        gone = np.cumsum(change[:-1], dtype=np.int32) > 0
        del change
        total = np.concatenate([np.zeros(1, np.int32), np.cumsum(gone, dtype=np.int32)])
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = texts.offsets[:-1][np.diff(texts.offsets) > 0]
        begins[inner] = gone[inner]
        spans = np.concatenate([np.zeros(1, np.int32), np.cumsum(begins, dtype=np.int32)])
        kept_at = texts.offsets - total[texts.offsets]
        kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(kept_at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(texts.data[~gone]))])
        return pa.table({"key": table["key"], "n_bytes": np.diff(texts.offsets), "n_removed": np.diff(total[texts.offsets]).astype(np.int64),
                         "n_spans": np.diff(spans[texts.offsets]).astype(np.int64), "kept": kept.cast(pa.binary())})
    both = statuses.unionByName(windows)
    return rows.groupBy("_g").cogroup(both.groupBy("_g")).applyInArrow(
        cut, "key long, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("key", key)

"""Substring dedup by windows of words: a count-min prefilter, then exact grouping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import cuts, group_count, group_of, pack_bits, pack_ints, slices, text_bytes, unpack_bits, unpack_ints
from .sketch import corpus_sketch, merged_counts, width_bits
from .words import SPACE, Texts, Words, pieces, rough_hashes, rough_windows, split_words, texts_of, window_digests, window_starts

WINDOW = 13
LAST = np.iinfo(np.int64).max  # stands for a null key: after all others


def all_windows(texts: Texts, k: int) -> np.ndarray:
    """Rough hashes of all windows of all texts, in text order."""
    found = [np.zeros(0, np.uint64)]
    for _, part in pieces(texts):
        words = split_words(part)
        found.append(rough_windows(rough_hashes(part, words), window_starts(words, k), k))
    return np.concatenate(found)


def digests_of(texts: Texts, k: int, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of a digest of the words of the windows with these numbers (sorted),
    as `all_windows` counts them."""
    high, low, done = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)], 0
    for _, part in pieces(texts):
        words = split_words(part)
        at = window_starts(words, k)
        mine = chosen[np.searchsorted(chosen, done):np.searchsorted(chosen, done + len(at))] - done
        done += len(at)
        a, b = window_digests(part, words, at[mine], k)
        high.append(a)
        low.append(b.astype(np.uint32))
    return np.concatenate(high), np.concatenate(low)


def window_texts(texts: Texts, k: int) -> np.ndarray:
    """Index of the text of each window of `all_windows`."""
    found = [np.zeros(0, np.int64)]
    for first, part in pieces(texts):
        words = split_words(part)
        n = np.maximum(words.counts() - k + 1, 0)
        found.append(np.repeat(np.arange(len(n)) + first, n))
    return np.concatenate(found)


def keys_of(table: pa.Table) -> np.ndarray:
    return np.asarray(table["key"].combine_chunks().fill_null(LAST), np.int64) if len(table) else np.zeros(0, np.int64)


def exact_keys(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Dense numbers of distinct (high, low) pairs, in the order of `high`."""
    index, number = np.unique(high, return_inverse=True)
    first = np.zeros(len(index), low.dtype)
    first[number] = low
    if (first[number] != low).any():  # two windows share one 64-bit hash: tell them apart
        pairs = np.rec.fromarrays([high, low])
        return np.unique(pairs, return_inverse=True)[1]
    return number


def kept_words(texts: Texts, words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts made of the kept words, joined by one space.

    A kept word that isn't its text's last kept one takes the byte after it along,
    which is white space of the same text.
    """
    at = np.flatnonzero(keep)
    text = words.text_of()[at]
    follow = np.zeros(len(at), bool)
    follow[:-1] = text[1:] == text[:-1]
    take = np.zeros(len(texts.data) + 2, np.int32)
    np.add.at(take, words.start[at], 1)
    np.add.at(take, words.end[at] + follow, -1)
    inside = np.cumsum(take[:len(texts.data)]) > 0
    data = texts.data[inside]
    data = np.where(SPACE[data], np.uint8(0x20), data)
    total = np.concatenate([[0], np.cumsum(inside)])
    return data, total[texts.offsets]


def remove_repeats(documents: DataFrame, key: str = "doc_id", text: str = "text", *, k: int = WINDOW) -> DataFrame:
    """Remove each word covered by a window of k words that also starts in a document
    with a smaller key; windows are judged on the input.

    Result: key, n_words, n_removed, kept (kept words joined by one space). Words are
    runs of other bytes than 0x20 and 0x09-0x0D, compared as they are. A null text has
    no words and keeps "". A null key counts as larger than all others; rows that
    share a key don't take words from each other. Texts under k words are kept whole.
    Other columns are ignored.

    Pass 1 sketches all windows per group of documents and merges the sketches. Pass 2
    sends the windows estimated repeated to the slice of a digest of their words (96 bits
    of BLAKE2), where the smallest key of each is found. Pass 3 cuts the words.
    """
    total = text_bytes(documents, text)
    n = group_count(total)
    bits = width_bits(total // 6)
    rows = documents.select(group_of(n, F.col(key), F.col(text)).alias("_g"), F.col(key).cast("long").alias("key"),
                            F.col(text).cast("string").alias("text"))

    replies = corpus_sketch(rows, lambda table: all_windows(texts_of(table["text"]), k), n, bits)

    def own(table: pa.Table) -> tuple:
        """The group's distinct windows with their smallest key, in slice order."""
        texts, ids = texts_of(table["text"]), keys_of(table)
        return texts, ids, all_windows(texts, k), window_texts(texts, k)

    def candidates(key: tuple, table: pa.Table, reply: pa.Table) -> pa.Table:
        texts, ids, high, where = own(table)
        may = np.flatnonzero(merged_counts(high, reply, bits) > 1)
        (high, low), doc = digests_of(texts, k, may), ids[where[may]]
        number = exact_keys(high, low)
        order = np.lexsort((doc, number))
        first = order[np.flatnonzero(np.diff(number[order], prepend=-1))]
        # every window's place in the list that is sent; the last pass needs it again
        high, low, least = high[first], low[first], doc[first]
        edge = cuts(slices(high, n), n)
        parts = [(int(s), slice(edge[s], edge[s + 1])) for s in np.flatnonzero(np.diff(edge))]
        return pa.table({"_slice": pa.array([s for s, _ in parts], pa.int32()),
                         "_g": pa.array([key[0].as_py()] * len(parts), pa.int32()),
                         "high": pa.array([pack_ints(high[p].view(np.int64)) for _, p in parts], pa.binary()),
                         "low": pa.array([low[p].tobytes() for _, p in parts], pa.binary()),
                         "least": pa.array([pack_ints(least[p]) for _, p in parts], pa.binary())})

    def first_keys(table: pa.Table) -> pa.Table:
        high = [unpack_ints(x).view(np.uint64) for x in table["high"].to_pylist()]
        size = np.cumsum([len(x) for x in high])
        number = exact_keys(np.concatenate(high), np.concatenate([np.frombuffer(x, np.uint32) for x in table["low"].to_pylist()]))
        doc = np.concatenate([unpack_ints(x) for x in table["least"].to_pylist()])
        least = np.full(int(number.max()) + 1, LAST)
        np.minimum.at(least, number, doc)
        earlier = np.split(least[number] < doc, size[:-1])
        return pa.table({"_g": table["_g"], "_row": pa.array([-1] * len(earlier), pa.int32()), "_slice": table["_slice"],
                         "n": pa.array([pack_bits(x) for x in earlier], pa.binary())})

    found = rows.groupBy("_g").cogroup(replies.groupBy("_g")).applyInArrow(
        candidates, "_slice int, _g int, high binary, low binary, least binary")
    verdicts = found.groupBy("_slice").applyInArrow(first_keys, "_g int, _row int, _slice int, n binary")

    def cut(key: tuple, table: pa.Table, reply: pa.Table) -> pa.Table:
        texts, ids, high, where = own(table)
        kind = np.asarray(reply["_row"])
        may = np.flatnonzero(merged_counts(high, reply.filter(pa.array(kind >= 0)), bits) > 1)
        (exact, low), doc = digests_of(texts, k, may), ids[where[may]]
        number = exact_keys(exact, low)
        least = np.full(int(number.max(initial=-1)) + 1, LAST)
        np.minimum.at(least, number, doc)
        first = np.zeros(len(least), np.uint64)
        first[number] = exact
        size = np.diff(cuts(slices(first, n), n))
        said = {s: x for r, s, x in zip(kind, reply["_slice"].to_pylist(), reply["n"].to_pylist(), strict=True) if r < 0}
        earlier = np.concatenate([np.zeros(0, bool)] + [unpack_bits(said[int(s)], int(size[s])) for s in np.flatnonzero(size)])
        bad = np.zeros(len(high), bool)
        bad[may] = earlier[number] | (doc > least[number])
        done, out = 0, {"n_words": [], "n_removed": [], "kept": []}
        for _, part in pieces(texts):
            words = split_words(part)
            at = window_starts(words, k)
            hit = at[bad[done:done + len(at)]]
            done += len(at)
            cover = np.zeros(len(words.start) + 1, np.int32)
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + k, -1)
            removed = np.cumsum(cover[:-1]) > 0
            data, offsets = kept_words(part, words, ~removed)
            gone = np.concatenate([[0], np.cumsum(removed)])
            out["n_words"].append(words.counts())
            out["n_removed"].append(np.diff(gone[words.first]))
            out["kept"].append(pa.LargeStringArray.from_buffers(len(part), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string()))
        none = [np.zeros(0, np.int64)]
        return pa.table({"key": table["key"], "n_words": np.concatenate(none + out["n_words"]).astype(np.int64),
                         "n_removed": np.concatenate(none + out["n_removed"]).astype(np.int64),
                         "kept": pa.chunked_array(out["kept"], pa.string())})

    both = replies.unionByName(verdicts)
    return (rows.groupBy("_g").cogroup(both.groupBy("_g"))
            .applyInArrow(cut, "key long, n_words long, n_removed long, kept string")
            .withColumnRenamed("key", key))

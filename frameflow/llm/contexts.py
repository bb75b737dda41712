"""Language-model scores by context-tree weighting over bytes, binary decomposed.

A byte is eight decisions; decision i of a byte is made at the node of its first i bits.
Every such node has a tree of contexts: the last 0, 1, ... DEPTH bytes. A context counts
its zeros and ones and estimates by Krichevsky and Trofimov's rule; weighting mixes, at
every context, its own estimate with that of the contexts one byte longer, by how well
each would have coded the training text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import group_count, group_of, pack_ints, pack_planes, text_bytes, unpack_ints, unpack_planes
from .words import SPACE, U64, Texts, mix, pieces, split_words, texts_of, word_hashes

DEPTH = 5
#: Contexts of TOP bytes are roots of the subtrees that slices hold; the tree above them
#: has at most 256**TOP * 255 nodes for any corpus.
TOP = 2
BASE_ADD = 0.1
HELD_OUT = 10  # one in so many keys, by CRC-32 of its digits
END = 0x0A
LOG2, LOGPI = math.log(2), math.log(math.pi)


def normal_bytes(part: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, first byte of each text): words with A-Z in lower case, each followed by
    one space, and one END per text."""
    words = split_words(part)
    owner = words.text_of()
    take = np.zeros(len(part.data) + 2, np.int32)
    np.add.at(take, words.start, 1)
    np.add.at(take, words.end, -1)
    inside = np.cumsum(take[:len(part.data)]) > 0
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    letters = low[part.data[inside]]
    n_words = words.counts()
    length = words.end - words.start
    # a word's bytes move right by the words and text ends before it
    number = np.arange(len(length))
    shift = number + owner
    size = len(letters) + len(length) + len(part)
    out = np.full(size, 0x20, np.uint8)
    out[np.arange(len(letters)) + np.repeat(shift, length)] = letters
    first_byte = np.concatenate([[0], np.cumsum(length)])[words.first]
    first = first_byte + words.first + np.arange(len(words.first))
    out[first[1:] - 1] = END
    return out, first


def grams(data: np.ndarray, first: np.ndarray, depth: int) -> np.ndarray:
    """For every byte: its `depth` bytes before, the nearest one highest, then itself.
    Before a text's first byte stands END."""
    keys = data.astype(U64)
    for back in range(1, depth + 1):
        before = np.full(len(data), END, U64)
        before[back:] = data[:-back] if back < len(data) else 0
        for late in range(back):  # the first bytes of a text don't see the text before
            at = first[:-1] + late
            at = at[at < first[1:]]
            before[at] = END
        keys |= before << U64(8 * (depth - back + 1))
    return keys


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0: Stirling's series, from x + 8 down."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        small = y < 8
        shift[small] += np.log(y[small])
        y = np.where(small, y + 1, y)
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - z * (1 / 360 - z / 1260)) / y - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability of a sequence with these counts by the KT rule."""
    zeros, ones = zeros.astype(float), ones.astype(float)
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - LOGPI


@dataclass
class Level:
    """The nodes of one context length, sorted by (context, first bits)."""

    node: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    log_weighted: np.ndarray
    own: np.ndarray  # weight of the node's own estimate

    def places(self, node: np.ndarray) -> np.ndarray:
        """Index of each node, -1 where it isn't."""
        if not len(self.node):
            return np.full(len(node), -1)
        at = np.minimum(np.searchsorted(self.node, node), len(self.node) - 1)
        return np.where(self.node[at] == node, at, -1)


def weigh(node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, deeper: np.ndarray | None) -> Level:
    """`deeper`: sum of the longer contexts' weighted log probabilities; None for leaves."""
    own = log_kt(zeros, ones)
    if deeper is None:
        return Level(node, zeros, ones, own, np.ones(len(node)))
    weighted = np.logaddexp(own, deeper) - LOG2
    return Level(node, zeros, ones, weighted, np.exp(own - LOG2 - weighted))


def prefixes(byte: np.ndarray, i: int) -> np.ndarray:
    """Number of the node after a byte's first i bits: 1, 2-3, 4-7, ..."""
    return (U64(1 << i) | byte >> U64(8 - i)) if i else np.ones(len(byte), U64)


def count_level(context: np.ndarray, byte: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, zeros, ones) of contexts and the bytes that followed, sorted by both."""
    nodes, zeros, ones = [], [], []
    for i in range(8):
        node = context << U64(8) | prefixes(byte, i)
        edge = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, int)
        bit = (byte >> U64(7 - i) & U64(1)).astype(np.int64)
        total = np.add.reduceat(count, edge) if len(edge) else np.zeros(0, np.int64)
        one = np.add.reduceat(count * bit, edge) if len(edge) else np.zeros(0, np.int64)
        nodes.append(node[edge])
        zeros.append(total - one)
        ones.append(one)
    node = np.concatenate(nodes)
    order = np.argsort(node)
    return node[order], np.concatenate(zeros)[order], np.concatenate(ones)[order]


def subtree(keys: np.ndarray, count: np.ndarray, depth: int, top: int = TOP) -> dict[int, Level]:
    """Levels depth..top of the trees of all contexts in `keys` (sorted, distinct)."""
    seen = count > 0
    context, byte, count = keys[seen] >> U64(8), keys[seen] & U64(255), count[seen]
    levels: dict[int, Level] = {}
    for d in range(depth, top - 1, -1):
        if d < depth:
            short = (context >> U64(8)) << U64(8) | byte
            short, inverse = np.unique(short, return_inverse=True)
            count = np.bincount(inverse, count, len(short)).astype(np.int64)
            context, byte = short >> U64(8), short & U64(255)
        node, zeros, ones = count_level(context, byte, count)
        deeper = None
        if d < depth:
            below = levels[d + 1]
            parent = below.node >> U64(16) << U64(8) | below.node & U64(255)
            deeper = np.bincount(np.searchsorted(node, parent), below.log_weighted, len(node))
        levels[d] = weigh(node, zeros, ones, deeper)
    return levels


def top_levels(node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, deeper: np.ndarray, top: int = TOP) -> dict[int, Level]:
    """Levels above `top`, from the sums over its contexts (nodes of length top - 1)."""
    levels = {}
    for d in range(top - 1, -1, -1):
        order = np.argsort(node)
        levels[d] = level = weigh(node[order], zeros[order], ones[order], deeper[order])
        parent, inverse = np.unique(level.node >> U64(16) << U64(8) | level.node & U64(255), return_inverse=True)
        zeros, ones = (np.bincount(inverse, x, len(parent)).astype(np.int64) for x in (level.zeros, level.ones))
        node, deeper = parent, np.bincount(inverse, level.log_weighted, len(parent))
    return levels


def log_probabilities(keys: np.ndarray, levels: dict[int, Level], depth: int) -> np.ndarray:
    """log10 probability of each key's byte after its context. A context that the training
    text doesn't have leaves the choice to the shorter ones."""
    out = np.zeros(len(keys))
    byte = keys & U64(255)
    for i in range(8):
        bit = (byte >> U64(7 - i) & U64(1)).astype(bool)
        first = prefixes(byte, i)
        chance, reached = np.full(len(keys), 0.5), np.zeros(len(keys), bool)
        for d in range(depth, -1, -1):
            level = levels[d]
            at = level.places(keys >> U64(8 * (depth - d + 1)) << U64(8) | first)
            have = at >= 0
            at = at[have]
            zeros, ones = level.zeros[at], level.ones[at]
            own = (np.where(bit[have], ones, zeros) + 0.5) / (zeros + ones + 1)
            weight = np.where(reached[have], level.own[at], 1.0)
            chance[have] = weight * own + (1 - weight) * chance[have]
            reached[have] = True
        out += np.log10(chance)
    return out


def by_slice(keys: np.ndarray, where: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """(slice, indices of its keys in their order)."""
    order = np.argsort(where, kind="stable")
    edge = np.searchsorted(where[order], np.arange(n + 1))
    return [(int(s), order[edge[s]:edge[s + 1]]) for s in np.flatnonzero(np.diff(edge))]


def gram_slice(keys: np.ndarray, depth: int, n: int) -> np.ndarray:
    """All keys with one context of TOP bytes are in one slice."""
    return mix(keys >> U64(8 * (depth - TOP + 1))) % U64(n)


def score(documents: DataFrame, key: str = "doc_id", text: str = "text", *, depth: int = DEPTH) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score, code_length.

    Rows whose CRC-32 of the key as text leaves a remainder modulo HELD_OUT train the
    model; the others are held out (a null key is as an empty text: held out). Tokens:
    words with A-Z in lower case, then one end. n_known counts tokens that training has;
    base_score sums log10((c + 0.1) / (N + 0.1 * (V + 1))); score is the log10
    probability of the words, each followed by a space, and the end, by context-tree
    weighting with `depth` bytes of context; code_length its bits per byte. A null or
    empty text is the end alone. Without training rows every bit has the chance 1/2.
    Repeated rows train and are scored each. Other columns are ignored.

    Groups of documents send the slices of the key space their distinct byte contexts
    and words with training counts; slices weigh their subtrees; the tree above them,
    which no corpus makes larger than 256**TOP * 255 nodes, goes back to all slices; and
    these answer each group for what it sent.
    """
    if not TOP < depth <= 7:
        raise ValueError("depth must be 3 to 7")
    n = group_count(text_bytes(documents, text))
    held = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % HELD_OUT == 0
    rows = documents.select(group_of(n, F.col(key), F.col(text)).alias("_g"), F.col(key).cast("long").alias("key"),
                            held.alias("held"), F.col(text).cast("string").alias("text"))

    def read(table: pa.Table) -> tuple[list, list, np.ndarray]:
        """Of each piece of the group's texts: (distinct keys, number of each key among
        them, its text), for contexts and for tokens; and the bytes of each text."""
        grams_of, words_of, size = [], [], [np.zeros(0, np.int64)]
        for first, part in pieces(texts_of(table["text"])):
            data, at = normal_bytes(part)
            size.append(np.diff(at))
            words = split_words(part)
            tokens = np.concatenate([word_hashes(part, words, lower=True), np.full(len(part), 1, U64)])  # 1: the end
            for into, keys, owner in ((grams_of, grams(data, at, depth), np.repeat(np.arange(len(part)), size[-1])),
                                      (words_of, tokens, np.concatenate([words.text_of(), np.arange(len(part))]))):
                index, inverse = np.unique(keys, return_inverse=True)
                into.append((index, inverse.astype(np.int32), (owner + first).astype(np.int32)))
        return grams_of, words_of, np.concatenate(size)

    def parts_of(table: pa.Table, found: tuple):
        """The group's distinct keys of both kinds, as they are sent: (kind, its pieces,
        keys, training counts, indices by slice)."""
        train = ~np.asarray(table["held"].combine_chunks(), bool) if len(table) else np.zeros(0, bool)
        for kind, parts in enumerate(found[:2]):
            index = np.unique(np.concatenate([np.zeros(0, U64), *(p[0] for p in parts)]))
            count = np.zeros(len(index), np.int64)
            for keys, inverse, owner in parts:
                count[np.searchsorted(index, keys)] += np.bincount(inverse, train[owner], len(keys)).astype(np.int64)
            where = gram_slice(index, depth, n) if kind == 0 else mix(index) % U64(n)
            yield kind, parts, index, count, by_slice(index, where, n)

    def send(group: tuple, table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for kind, _, index, count, split in parts_of(table, read(table)):
            out += [(kind, s, group[0].as_py(), pack_planes(index[at]), pack_ints(count[at])) for s, at in split]
        return pa.table({c: pa.array([x[i] for x in out], t) for i, (c, t) in enumerate(
            (("_kind", pa.int32()), ("_slice", pa.int32()), ("_g", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())))})
    sent = rows.groupBy("_g").applyInArrow(send, "_kind int, _slice int, _g int, keys binary, counts binary")

    def merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        keys = [unpack_planes(x) for x in table["keys"].to_pylist()]
        index, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(inverse, np.concatenate([unpack_ints(x) for x in table["counts"].to_pylist()]), len(index)).astype(np.int64)
        return index, count, np.split(inverse, np.cumsum([len(x) for x in keys])[:-1])

    def summary(group: tuple, table: pa.Table) -> pa.Table:
        index, count, _ = merged(table)
        if group[0].as_py() == 1:
            columns = [np.array([-1]), count.sum(keepdims=True), np.array([(count > 0).sum()]), np.zeros(1)]
        else:
            level = subtree(index, count, depth)[TOP]
            parent = level.node >> U64(16) << U64(8) | level.node & U64(255)
            node, inverse = np.unique(parent, return_inverse=True)
            columns = [node.astype(np.int64), *(np.bincount(inverse, x, len(node)).astype(np.int64) for x in (level.zeros, level.ones)),
                       np.bincount(inverse, level.log_weighted, len(node)).astype(float)]
        return pa.table(dict(zip(("node", "zeros", "ones", "deeper"), (pa.array(c) for c in columns), strict=True)))
    top = (sent.groupBy("_kind", "_slice").applyInArrow(summary, "node long, zeros long, ones long, deeper double")
           .groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("deeper").alias("deeper")))

    def packed(table: pa.Table) -> pa.Table:
        """The tree's top, a table of 256**TOP * 255 nodes at most, in one row."""
        table = table.select(["node", "zeros", "ones", "deeper"]).sort_by("node")
        return pa.table({c: pa.array([np.asarray(table[c]).tobytes()], pa.binary()) for c in table.column_names})
    one = top.withColumn("_one", F.lit(0)).groupBy("_one").applyInArrow(packed, "node binary, zeros binary, ones binary, deeper binary")
    spots = documents.sparkSession.range(2 * n).select((F.col("id") % 2).cast("int").alias("_kind"), F.floor(F.col("id") / 2).cast("int").alias("_slice"))
    tops = spots.crossJoin(F.broadcast(one))  # one row, handed to each slice where it is

    def answer(group: tuple, table: pa.Table, copy: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({"_g": pa.array([], pa.int32()), "_kind": pa.array([], pa.int32()), "_slice": pa.array([], pa.int32()),
                             "tokens": pa.array([], pa.int64()), "values": pa.array([], pa.binary())})
        index, count, inverse = merged(table)
        node, zeros, ones, deeper = (np.frombuffer(copy[c][0].as_py(), k) for c, k in (
            ("node", np.int64), ("zeros", np.int64), ("ones", np.int64), ("deeper", float)))
        words = node < 0
        tokens, kinds = int(zeros[words].sum()), int(ones[words].sum())
        if group[0].as_py() == 1:
            values = np.log10((count + BASE_ADD) / (tokens + BASE_ADD * (kinds + 1)))
            values = np.where(count > 0, values, 1 - values)  # above 0: not known
        else:
            levels = subtree(index, count, depth) | top_levels(node[~words].astype(U64), zeros[~words], ones[~words], deeper[~words])
            values = log_probabilities(index, levels, depth)
        return pa.table({"_g": table["_g"], "_kind": table["_kind"], "_slice": table["_slice"],
                         "tokens": pa.array([tokens] * len(table), pa.int64()), "values": [values[x].tobytes() for x in inverse]})
    replies = sent.groupBy("_kind", "_slice").cogroup(tops.groupBy("_kind", "_slice")).applyInArrow(
        answer, "_g int, _kind int, _slice int, tokens long, values binary")

    def add_up(table: pa.Table, reply: pa.Table) -> pa.Table:
        said = {(k, s): x for k, s, x in zip(*(reply[c].to_pylist() for c in ("_kind", "_slice", "values")), strict=True)}
        m = len(table)
        found, sums = read(table), []
        for kind, parts, index, _, split in parts_of(table, found):
            values = np.zeros(len(index))
            for s, at in split:
                values[at] = np.frombuffer(said[kind, s], float)
            known = values <= 0
            values = np.where(known, values, 1 - values)
            total, tokens, seen = np.zeros(m), np.zeros(m, np.int64), np.zeros(m, np.int64)
            for keys, inverse, owner in parts:
                at = np.searchsorted(index, keys)[inverse]
                total += np.bincount(owner, values[at], m)
                tokens += np.bincount(owner, minlength=m)
                seen += np.bincount(owner, known[at], m).astype(np.int64)
            sums.append((total, tokens, seen))
        bytes_of = found[2]
        (model, *_), (base, tokens, known) = sums
        return pa.table({"key": table["key"], "held_out": table["held"], "n_tokens": tokens, "n_known": known,
                         "train_tokens": pa.array([reply["tokens"][0].as_py()] * m, pa.int64()), "base_score": base, "score": model,
                         "code_length": -model / math.log10(2) / np.maximum(bytes_of, 1)})
    return rows.groupBy("_g").cogroup(replies.groupBy("_g")).applyInArrow(
        add_up, "key long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, code_length double"
    ).withColumnRenamed("key", key)

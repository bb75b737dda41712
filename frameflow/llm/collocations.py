"""Phrase collocations by marginalising the counts of the longest windows.

Every word leads a window of up to five words of its piece, padded behind. Only these
windows are counted, in five columns; ROLLUP sums them over ever shorter beginnings, which
are the counts of all shorter phrases. A window ends early at a word or pair that is too
rare to be in any candidate; which ones are is found out by groups of documents, whose
words and pairs are counted first.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import checkpoint
from .groups import cuts, group_count, group_of, pack_bits, pack_ints, pack_planes, slices, text_bytes, unpack_bits, unpack_ints, unpack_planes
from .words import Texts, mix, texts_of

#: Words of the longest phrase, occurrences of a candidate, phrases listed per language.
LONGEST, OFTEN, MOST = 5, 100, 2000
#: A longer candidate with this percentage of a phrase's occurrences stands for it.
ABSORB = 100
SALTS = 16
#: What a byte is: part of a word (0), a blank (1), the end of a piece (2).
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORDS_DDL = "_slice int, _g int, langs array<string>, lang binary, size binary, words binary, n binary"
PAIRS_DDL = "_slice int, _g int, pair binary, n binary"
HEARD = pa.schema([("_g", pa.int32()), ("_slice", pa.int32()), ("kind", pa.string()), ("data", pa.binary()),
                   ("lang", pa.string()), ("word", pa.string()), ("id", pa.int32()), ("n", pa.int64())])
HEARD_DDL = "_g int, _slice int, kind string, data binary, lang string, word string, id int, n long"
REPLY = pa.schema(list(HEARD)[:4])
REPLY_DDL = "_g int, _slice int, kind string, data binary"


@dataclass
class Spoken:
    """The words of a group's texts in order: word i has the number code[i] in `words`, a
    list of distinct (language, word); linked[i]: word i + 1 follows in the same piece."""

    code: np.ndarray
    linked: np.ndarray
    langs: pa.Array
    words: pa.Array


def places(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start and end of every word, its text, and whether the next one is in its piece."""
    data, n = texts.data, len(texts.data)
    if not n:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
    kind = KIND[data]
    inside = kind == 0
    edge = np.zeros(n + 1, bool)
    edge[texts.offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    stops = np.cumsum(kind == 2, dtype=np.int32)[start]
    text = np.searchsorted(texts.offsets, start, "right") - 1
    linked = np.zeros(len(start), bool)
    linked[:-1] = (stops[1:] == stops[:-1]) & (text[1:] == text[:-1])
    return start, end, text, linked


def spoken(table: pa.Table) -> Spoken:
    """All words of a group, in lower case (A-Z only)."""
    texts = texts_of(table["text"])
    lang = table["lang"].combine_chunks().dictionary_encode() if len(table) else pa.array([], pa.string()).dictionary_encode()
    start, end, text, linked = places(texts)
    size = end - start
    mark = np.zeros(len(texts.data) + 1, np.int8)
    mark[start] += 1
    mark[end[:]] -= 1
    packed = LOWER[texts.data[np.cumsum(mark[:-1], dtype=np.int8).astype(bool)]]
    offsets = np.concatenate([[0], np.cumsum(size)])
    found = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(packed)).dictionary_encode()
    words, langs = found.dictionary.cast(pa.string()), lang.dictionary
    both = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[text] * max(len(words), 1) + found.indices.to_numpy(zero_copy_only=False)
    distinct, code = np.unique(both, return_inverse=True)
    return Spoken(code, linked, langs.take(pa.array(distinct // max(len(words), 1))), words.take(pa.array(distinct % max(len(words), 1))))


def word_order(told: Spoken, n_slices: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words in an order that follows from them alone, slice by slice, and
    where each slice begins. A group's rows come in another order each time it is read."""
    langs, words = told.langs.to_pylist(), told.words.to_pylist()
    number = np.fromiter((zlib.crc32(f"{lang}\0{word}".encode()) for lang, word in zip(langs, words, strict=True)), np.int64, len(words))
    where = number % n_slices
    order = np.lexsort((number, where))
    for i in np.flatnonzero(np.diff(number[order]) == 0):
        same = order[number[order] == number[order[i]]]
        order[number[order] == number[order[i]]] = sorted(same, key=lambda j: (langs[j], words[j]))
    return order, np.searchsorted(where[order], np.arange(n_slices + 1))


def strings(sizes: np.ndarray, data: bytes) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data))


def word_rows(n_slices: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """A group's distinct words with their counts, one row per slice."""
    def send(key: tuple, table: pa.Table) -> pa.Table:
        told = spoken(table)
        order, edge = word_order(told, n_slices)
        n = np.bincount(told.code, minlength=len(told.words))[order]
        lang = told.langs.take(pa.array(order)).dictionary_encode()
        code, langs = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64), lang.dictionary.to_pylist()
        texts = [w.encode() for w in told.words.take(pa.array(order)).to_pylist()]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        out = {name: [] for name in ("_slice", "_g", "langs", "lang", "size", "words", "n")}
        for s in np.flatnonzero(np.diff(edge)):
            p = slice(edge[s], edge[s + 1])
            row = (int(s), key[0].as_py(), langs, pack_ints(code[p]), pack_ints(size[p]), b"".join(texts[p]), pack_ints(n[p]))
            for name, value in zip(out, row, strict=True):
                out[name].append(value)
        types = (pa.int32(), pa.int32(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({name: pa.array(column, t) for (name, column), t in zip(out.items(), types, strict=True)})
    return send


def count_words(n_slices: int, often: int) -> Callable[[pa.Table], pa.Table]:
    """One slice of the words of all groups: the frequent ones with a number each, their
    numbers (0 for a rare one) back to every group, and the words of each language."""
    def merge(table: pa.Table) -> pa.Table:
        names = pa.array([x for row in table["langs"].to_pylist() for x in row], pa.string()).dictionary_encode()
        first = np.cumsum([0, *(len(x) for x in table["langs"].to_pylist())])
        lang_of, at = names.indices.to_numpy(zero_copy_only=False), [unpack_ints(x) for x in table["lang"].to_pylist()]
        lang = np.concatenate([lang_of[f + x] for f, x in zip(first, at, strict=False)])
        size = np.concatenate([unpack_ints(x) for x in table["size"].to_pylist()])
        words = strings(size, b"".join(table["words"].to_pylist())).dictionary_encode()
        n = np.concatenate([unpack_ints(x) for x in table["n"].to_pylist()])
        both, inverse = np.unique(lang.astype(np.int64) * len(words.dictionary) + words.indices.to_numpy(zero_copy_only=False), return_inverse=True)
        total = np.zeros(len(both), np.int64)
        np.add.at(total, inverse, n)
        good = np.flatnonzero(total >= often)
        here = table["_slice"][0].as_py()
        number = np.zeros(len(both), np.int64)
        number[good] = np.arange(len(good)) * n_slices + here + 1
        replies = np.split(number[inverse].astype("<u4"), np.cumsum([len(x) for x in at])[:-1])
        spoken_in = np.zeros(len(names.dictionary), np.int64)
        np.add.at(spoken_in, both // len(words.dictionary), total)
        known = pa.table({"_g": pa.nulls(len(good), pa.int32()), "_slice": pa.nulls(len(good), pa.int32()), "kind": pa.array(["word"] * len(good), pa.string()),
                          "data": pa.nulls(len(good), pa.binary()), "lang": names.dictionary.take(pa.array(both[good] // len(words.dictionary))),
                          "word": words.dictionary.take(pa.array(both[good] % len(words.dictionary))).cast(pa.string()),
                          "id": pa.array(number[good], pa.int32()), "n": pa.array(total[good], pa.int64())}, schema=HEARD)
        k = len(spoken_in)
        sums = pa.table({"_g": pa.nulls(k, pa.int32()), "_slice": pa.nulls(k, pa.int32()), "kind": pa.array(["lang"] * k, pa.string()), "data": pa.nulls(k, pa.binary()),
                         "lang": names.dictionary, "word": pa.nulls(k, pa.string()), "id": pa.nulls(k, pa.int32()), "n": pa.array(spoken_in, pa.int64())}, schema=HEARD)
        m = len(replies)
        answers = pa.table({"_g": table["_g"], "_slice": table["_slice"], "kind": pa.array(["ids"] * m, pa.string()),
                            "data": pa.array([x.tobytes() for x in replies], pa.binary()), "lang": pa.nulls(m, pa.string()), "word": pa.nulls(m, pa.string()),
                            "id": pa.nulls(m, pa.int32()), "n": pa.nulls(m, pa.int64())}, schema=HEARD)
        return pa.concat_tables([known, sums, answers])
    return merge


def answers(reply: pa.Table, kind: str) -> dict[int, bytes]:
    """Slice -> what it answered."""
    return {s: d for s, k, d in zip(reply["_slice"].to_pylist(), reply["kind"].to_pylist(), reply["data"].to_pylist(), strict=True) if k == kind}


def with_ids(told: Spoken, reply: pa.Table, n_slices: int) -> np.ndarray:
    """The number of each word in order, 0 for a rare one."""
    order, _ = word_order(told, n_slices)
    said = answers(reply, "ids")
    ids = np.zeros(len(told.words), np.int64)
    ids[order] = np.frombuffer(b"".join(said[s] for s in sorted(said)), "<u4")
    return ids[told.code]


def pair_keys(ids: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where two words that aren't rare follow each other, and the two numbers as one."""
    at = np.flatnonzero(linked[:-1] & (ids[:-1] > 0) & (ids[1:] > 0)) if len(ids) else np.zeros(0, np.int64)
    return at, (ids[at].astype(np.uint64) << np.uint64(32)) | ids[at + 1].astype(np.uint64)


def by_slice(pair: np.ndarray, n_slices: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of distinct pairs by slice and number, and where each slice begins."""
    where = slices(mix(pair), n_slices)
    order = np.lexsort((pair, where))
    return order, cuts(where[order], n_slices)


def distinct_rows(columns: list[np.ndarray], n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of each row among the distinct ones, one place of each of these, and
    the sum of `n` over it."""
    number = np.zeros(len(n), np.int64)
    for column in columns:
        values, at = np.unique(column, return_inverse=True)
        number = np.unique(number * max(len(values), 1) + at, return_inverse=True)[1]
    total = np.zeros(int(number.max(initial=-1)) + 1, np.int64)
    np.add.at(total, number, n)
    first = np.zeros(len(total), np.int64)
    first[number] = np.arange(len(n))
    return number, first, total


def window_counts(rows: DataFrame, replies: DataFrame, n_slices: int, longest: int, often: int) -> DataFrame:
    """w0 to w4, n: how often each longest window of frequent words and pairs occurs. The
    groups' windows meet by their first pair; one is padded behind its last frequent
    beginning, as no candidate reaches beyond it."""
    def pairs(key: tuple, table: pa.Table, reply: pa.Table) -> pa.Table:
        told = spoken(table)
        _, found = pair_keys(with_ids(told, reply, n_slices), told.linked)
        pair, n = np.unique(found, return_counts=True)
        order, edge = by_slice(pair, n_slices)
        pair, n = pair[order], n[order]
        parts = [(int(s), slice(edge[s], edge[s + 1])) for s in np.flatnonzero(np.diff(edge))]
        return pa.table({"_slice": pa.array([s for s, _ in parts], pa.int32()), "_g": pa.array([key[0].as_py()] * len(parts), pa.int32()),
                         "pair": pa.array([pack_planes(pair[p]) for _, p in parts], pa.binary()),
                         "n": pa.array([pack_ints(n[p]) for _, p in parts], pa.binary())})

    def frequent(table: pa.Table) -> pa.Table:
        pair = [unpack_planes(x) for x in table["pair"].to_pylist()]
        _, inverse = np.unique(np.concatenate(pair), return_inverse=True)
        total = np.zeros(int(inverse.max()) + 1, np.int64)
        np.add.at(total, inverse, np.concatenate([unpack_ints(x) for x in table["n"].to_pylist()]))
        bits = np.split(total[inverse] >= often, np.cumsum([len(x) for x in pair])[:-1])
        return pa.table({"_g": table["_g"], "_slice": table["_slice"], "kind": pa.array(["pairs"] * len(bits), pa.string()),
                         "data": pa.array([pack_bits(x) for x in bits], pa.binary())}, schema=REPLY)

    def windows(key: tuple, table: pa.Table, reply: pa.Table) -> pa.Table:
        told = spoken(table)
        ids = with_ids(told, reply, n_slices)
        at, found = pair_keys(ids, told.linked)
        pair, inverse = np.unique(found, return_inverse=True)
        order, edge = by_slice(pair, n_slices)
        said = answers(reply, "pairs")
        good = np.zeros(len(pair), bool)
        good[order] = np.concatenate([np.zeros(0, bool)] + [unpack_bits(said[int(s)], int(edge[s + 1] - edge[s])) for s in np.flatnonzero(np.diff(edge))])
        next_good = np.zeros(len(ids) + longest, bool)
        next_good[at] = good[inverse]
        lead = np.flatnonzero(next_good)
        columns, going = [ids[lead]], np.ones(len(lead), bool)
        for k in range(1, longest):
            going &= next_good[lead + k - 1]
            columns.append(np.where(going, ids[np.minimum(lead + k, max(len(ids) - 1, 0))], 0))
        number, first, n = distinct_rows(columns, np.ones(len(lead), np.int64))
        columns = [c[first] for c in columns]
        where = slices(mix((columns[0].astype(np.uint64) << np.uint64(32)) | columns[1].astype(np.uint64)), n_slices)
        order = np.argsort(where, kind="stable")
        edge = cuts(where[order], n_slices)
        parts = [(int(s), order[edge[s]:edge[s + 1]]) for s in np.flatnonzero(np.diff(edge))]
        return pa.table({"_slice": pa.array([s for s, _ in parts], pa.int32())}
                        | {f"w{k}": pa.array([pack_ints(c[p]) for _, p in parts], pa.binary()) for k, c in enumerate(columns)}
                        | {"n": pa.array([pack_ints(n[p]) for _, p in parts], pa.binary())})

    def padded(table: pa.Table) -> pa.Table:
        """All windows of a slice's first pairs, padded behind the last word up to which
        they are frequent."""
        columns = [np.concatenate([unpack_ints(x) for x in table[f"w{k}"].to_pylist()]) for k in range(longest)]
        n = np.concatenate([unpack_ints(x) for x in table["n"].to_pylist()])
        going = np.ones(len(n), bool)
        for k in range(1, longest):
            number, _, total = distinct_rows(columns[:k + 1], n)
            going &= (total[number] >= often) & (columns[k] > 0)
            columns[k] = np.where(going, columns[k], 0)
        _, first, n = distinct_rows(columns, n)
        return pa.table({f"w{k}": pa.array(c[first], pa.int32()) for k, c in enumerate(columns)} | {"n": pa.array(n, pa.int64())})

    counted = rows.groupBy("_g").cogroup(replies.groupBy("_g")).applyInArrow(pairs, PAIRS_DDL).groupBy("_slice").applyInArrow(frequent, REPLY_DDL)
    names = [f"w{k}" for k in range(longest)]
    found = rows.groupBy("_g").cogroup(replies.unionByName(counted).groupBy("_g")).applyInArrow(
        windows, "_slice int, " + ", ".join(f"{c} binary" for c in names) + ", n binary")
    return found.groupBy("_slice").applyInArrow(padded, ", ".join(f"{c} int" for c in names) + ", n long")


def phrase_counts(windows: DataFrame, longest: int, often: int) -> DataFrame:
    """ids (two words at least), f: the counts of all beginnings of windows, by ROLLUP."""
    names = [f"w{k}" for k in range(longest)]
    counted = windows.groupBy(*names).agg(F.sum("n").alias("n"))
    view = f"_windows_{id(counted)}"
    counted.createOrReplaceTempView(view)
    spark = counted.sparkSession
    rolled = spark.sql(f"SELECT {', '.join(names)}, sum(n) AS f FROM {view} GROUP BY w0, w1" + (f", ROLLUP({', '.join(names[2:])})" if longest > 2 else ""))
    spark.catalog.dropTempView(view)
    ids = F.array_compact(F.array(*names))  # a column that was summed over is null
    return rolled.where(F.col("f") >= often).select(ids.alias("ids"), "f").where(F.element_at("ids", -1) != 0)


def scored(candidates: DataFrame, parts: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, ids, a, l, r, n, score of each candidate at its lowest cut. `parts`: ids and f
    of every frequent phrase, single words included; `totals`: id of a word, lang, n."""
    cut = candidates.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cut = cut.select("ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("first"), F.expr("slice(ids, k + 1, size(ids) - k)").alias("rest"))
    cut = cut.join(parts.select(F.col("ids").alias("first"), F.col("f").alias("l")), "first").join(parts.select(F.col("ids").alias("rest"), F.col("f").alias("r")), "rest")
    cut = cut.withColumn("id", F.element_at("ids", 1)).join(totals, "id")
    whole = [F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")]
    cut = cut.withColumn("up", whole[0] * whole[1]).withColumn("down", (whole[2] * whole[3]).cast("decimal(38,0)"))
    cut = cut.withColumn("score", F.expr("cast(up * cast(1000 as decimal(4,0)) as decimal(38,0)) div down"))
    best = cut.groupBy("ids").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"), F.first("a").alias("a"), F.first("n").alias("n"), F.first("lang").alias("lang"))
    return best.select("lang", "ids", "a", "c.l", "c.r", "n", "c.score")


def absorbed(candidates: DataFrame, absorb: int) -> DataFrame:
    """ids of the candidates whose words lie within a longer one that is as frequent."""
    longer = candidates.where(F.size("ids") > 2).select(F.col("ids").alias("long"), F.col("f").alias("g"))
    parts = longer.select("g", F.explode(F.expr(
        "filter(flatten(transform(sequence(0, size(long) - 2), i -> transform(sequence(2, size(long) - i), m -> slice(long, i + 1, m)))), p -> size(p) < size(long))")).alias("ids"))
    most = parts.groupBy("ids").agg(F.max("g").alias("g"))
    return candidates.join(most, "ids").where(100 * F.col("g") >= absorb * F.col("f")).select("ids")


def collocations(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", *, longest: int = LONGEST,
                 often: int = OFTEN, most: int = MOST, absorb: int = ABSORB, unknown: str = "und", **sizes: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `most` phrases of each language that
    stand together more often than their parts would by chance.

    Texts are in lower case (A-Z only); `.,;:!?` and the ends of lines end a piece, blanks
    and tabs a word. A candidate has 2 to `longest` words of one piece and a >= `often`
    occurrences; its score is floor(1000 * a * n / (l * r)) at the cut where that is least.
    A candidate within a longer one of at least `absorb` percent of its occurrences is
    left out. Ties are ordered by a, then by the phrase's bytes. A null text is empty, a
    null language `unknown`, a null key a key like another; rows that share a key are each
    read, other columns are ignored, and an empty table gives no rows.

    Rare words and pairs only end windows early: no phrase with them can be a candidate,
    and all parts of a candidate are as frequent as it is. They all count in n.
    """
    n_groups = group_count(text_bytes(documents, text), **sizes)
    rows = documents.select(group_of(n_groups, F.col(key), F.col(text)).alias("_g"), F.coalesce(F.col(lang).cast("string"), F.lit(unknown)).alias("lang"),
                            F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    heard = checkpoint(rows.groupBy("_g").applyInArrow(word_rows(n_groups), WORDS_DDL)
                       .groupBy("_slice").applyInArrow(count_words(n_groups, often), HEARD_DDL))
    known = heard.where("kind = 'word'").select("lang", "word", "id", "n")
    spoken_in = heard.where("kind = 'lang'").groupBy("lang").agg(F.sum("n").alias("n"))
    windows = window_counts(rows, heard.where("kind = 'ids'").select(*REPLY.names), n_groups, longest, often)
    phrases = checkpoint(phrase_counts(windows, longest, often))
    parts = phrases.unionByName(known.select(F.array("id").alias("ids"), F.col("n").alias("f")))
    totals = known.select("id", "lang").join(spoken_in, "lang")
    found = scored(phrases, parts, totals).join(absorbed(phrases, absorb), "ids", "left_anti")

    # the first ones by number already, in parts of each language; ties at the end all stay
    salted = Window.partitionBy("lang", "_salt").orderBy(F.desc("score"), F.desc("a"))
    found = checkpoint(found.withColumn("_salt", F.pmod(F.xxhash64("ids"), F.lit(SALTS))).withColumn("_i", F.rank().over(salted)).where(F.col("_i") <= most).drop("_i"))
    spelled = found.select("ids", F.posexplode("ids").alias("at", "id")).join(known.select("id", "word"), "id")
    spelled = spelled.groupBy("ids").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"])).alias("phrase"))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = found.join(spelled, "ids").withColumn("_i", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_i") <= most)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

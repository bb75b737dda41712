"""Spelling variants: words one edit apart, found by composing finite-state machines.

The vocabulary's minimised acceptor is composed with a transducer that makes one edit and
with the acceptor again. Two words one edit apart agree in all that lies before the edit
or in all that lies behind the middle; so each word starts in the initial states of its
first and of its last half, and the pairs of every initial state are enumerated alone.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import checkpoint, shuffle_partitions
from .words import Texts, Words, pieces, texts_of

#: Code points of a word and its occurrences, at least; one run in `SPOIL` loses a code
#: point; a form occurs `RATIO` times as often as its variant, at least.
LEAST, TWICE, SPOIL, RATIO = 7, 2, 31, 10
#: Words of one initial state that are enumerated at once, and the longest part of a word
#: that they may differ in; larger states are halved again.
HEAVY, LONG = 20_000, 64
SLICE_ROWS = 40_000
PIECE = 4 << 20
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
TABLED = 64  # bytes of a run whose checksum is joined by table


def letter_runs(texts: Texts) -> Words:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF: in UTF-8, of those letters and of
    0xC3 with the byte after it."""
    data = texts.data
    if not len(data):
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64))
    lead = data == 0xC3
    inside = LETTER[data] | lead
    inside[1:] |= lead[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[texts.offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(start, end, np.searchsorted(start, texts.offsets))


def shift_tables(n: int) -> np.ndarray:
    """For l < n: what l zero bytes do to each byte of a CRC-32, [l, place, byte]."""
    byte = np.arange(256, dtype=np.uint32)
    step = byte.copy()
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    out = np.empty((n, 4, 256), np.uint32)
    out[0] = [byte << np.uint32(8 * k) for k in range(4)]
    for i in range(1, n):
        out[i] = (out[i - 1] >> np.uint32(8)) ^ step[out[i - 1] & 255]
    return out


def checksums(before: np.ndarray, run: np.ndarray, size: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings laid end to end, from theirs and the second one's length."""
    out = run.copy()
    for k in range(4):
        out ^= tables[size, k, (before >> np.uint32(8 * k)) & 255]
    return out


def tally(keys: list[str], texts: Texts, tables: np.ndarray, least: int = LEAST, spoil: int = SPOIL) -> pa.Table:
    """word and n of the runs of some texts; of a run whose checksum `spoil` divides, one
    code point is taken out first."""
    runs = letter_runs(texts)
    points = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
    length = points[runs.end] - points[runs.start]
    long = length >= least
    start, end, length, text = runs.start[long], runs.end[long], length[long], runs.text_of()[long]
    if not len(start):
        return pa.table({"word": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
    mark = np.zeros(len(texts.data) + 1, np.int8)
    mark[start] += 1
    mark[end] -= 1
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    packed = LOWER[texts.data[np.cumsum(mark[:-1]).astype(bool)]]
    found = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(packed)).dictionary_encode()
    code, words = found.indices.to_numpy(), found.dictionary.to_pylist()
    before = np.array([zlib.crc32(f"{k}:".encode()) for k in keys], np.uint32)
    own = np.array([zlib.crc32(w.encode()) for w in words], np.uint32)
    h = checksums(before[text], own[code], np.minimum(size, TABLED - 1), tables)
    for i in np.flatnonzero(size >= TABLED):
        h[i] = zlib.crc32(f"{keys[text[i]]}:{words[code[i]]}".encode())
    hit = h % spoil == 0
    count = np.bincount(code[~hit], minlength=len(words))
    spoiled: Counter[str] = Counter()
    for i in np.flatnonzero(hit & (length > least)):
        word, at = words[code[i]], int(h[i]) % int(length[i])
        spoiled[word[:at] + word[at + 1:]] += 1
    some = np.flatnonzero(count)
    return pa.table({"word": pa.array([words[i] for i in some] + list(spoiled), pa.string()),
                     "n": pa.array(count[some].tolist() + list(spoiled.values()), pa.int64())})


def vocabulary(documents: DataFrame, key: str, text: str, *, least: int = LEAST, twice: int = TWICE, spoil: int = SPOIL) -> DataFrame:
    """word, n of all words that occur often enough."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shift_tables(TABLED)
        for batch in batches:
            keys, texts = batch.column("key").to_pylist(), texts_of(batch.column("text"))
            parts = [tally(keys[first:first + len(part)], part, tables, least, spoil) for first, part in pieces(texts, PIECE)]
            if parts:
                merged = pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
                yield from merged.to_batches()
    rows = documents.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).cast("string").alias("text"))
    counts = rows.mapInArrow(count, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= twice)


class Acceptor:
    """Minimised acyclic acceptors that share their states: a state is made once for each
    pair of finality and edges, so that equal right languages are one state."""

    def __init__(self) -> None:
        self.known: dict[tuple, int] = {}
        self.final: list[bool] = []
        self.edges: list[dict[str, int]] = []
        self.met: dict[tuple[int, int], list[str]] = {}

    def state(self, words: Iterable[str]) -> int:
        """The state from which exactly these words are accepted."""
        after: dict[str, list[str]] = defaultdict(list)
        final = False
        for word in words:
            if word:
                after[word[0]].append(word[1:])
            else:
                final = True
        edges = {c: self.state(after[c]) for c in sorted(after)}
        shape = (final, *edges.items())
        at = self.known.get(shape)
        if at is None:
            at = self.known[shape] = len(self.final)
            self.final.append(final)
            self.edges.append(edges)
        return at

    def meet(self, p: int, q: int) -> list[str]:
        """The words accepted from both states: the composition after its one edit."""
        found = self.met.get((p, q))
        if found is None:
            found = [""] if self.final[p] and self.final[q] else []
            right = self.edges[q]
            for c, r in self.edges[p].items():
                if (s := right.get(c)) is not None:
                    found += [c + z for z in self.meet(r, s)]
            self.met[p, q] = found
        return found

    def pairs(self, left: int, right: int, open_end: bool) -> Iterator[tuple[str, str]]:
        """The words of `left` with those of `right` that have one code point replaced by a
        larger one, or one more. One more is put in as late as can be; at the very end
        only with `open_end`."""
        todo = [(left, right, "")]
        while todo:
            p, q, read = todo.pop()
            more = self.edges[q]
            for c, r in self.edges[p].items():
                todo.append((r, more[c], read + c))
                for d, t in more.items():
                    if d > c:
                        for z in self.meet(r, t):
                            yield read + c + z, read + d + z
            for d, t in more.items():
                for z in self.meet(p, t):
                    if z[0] != d if z else open_end:
                        yield read + z, read + d + z


def halves(rows: DataFrame) -> DataFrame:
    """Every initial state (words of ell or ell + 1 code points with one beginning of `a`
    and one end of `b`) as two, with half of what lay between fixed as well."""
    between = F.col("ell") - F.col("a") - F.col("b")
    half = F.floor(between / 2).cast("int")
    two = F.array(F.struct((F.col("a") + half).alias("a"), F.col("b")), F.struct(F.col("a"), (F.col("b") + between - half).alias("b")))
    return rows.select("word", "n", "ell", F.explode(two).alias("part")).select("word", "n", "ell", "part.a", "part.b")


def initial_state() -> Column:
    """A number of (ell, beginning, end); two states may share one."""
    size = F.length("word")
    return F.xxhash64("ell", "a", "b", F.col("word").substr(F.lit(1), F.col("a")), F.col("word").substr(size - F.col("b") + 1, F.col("b")))


def state_rows(words: DataFrame, least: int = LEAST, heavy: int = HEAVY, long: int = LONG) -> DataFrame:
    """word, n, ell, a, b, state: every word in its initial states, none of which has more
    than `heavy` words or lets them differ in more than `long` code points, as far as
    halving helps: states of one open code point hold an alphabet squared at most."""
    size = F.length("word")
    rows = words.select("word", "n", F.explode(F.filter(F.array(size, size - 1), lambda x: x >= least)).alias("ell"),
                        F.lit(0).alias("a"), F.lit(0).alias("b"))
    between = F.col("ell") - F.col("a") - F.col("b")
    done = None
    while True:
        rows = halves(rows).withColumn("state", initial_state())
        fit = rows.where(between <= long)
        sizes = rows.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.max(between).alias("between"))
        many = checkpoint(sizes.where(((F.col("n") > heavy) & (F.col("between") > 1)) | ((F.col("n") > 1) & (F.col("between") > long))).select("state"))
        if many.isEmpty():
            return fit if done is None else done.unionByName(fit)
        rest = fit.join(many, "state", "left_anti")
        done = rest if done is None else done.unionByName(rest)
        rows = checkpoint(rows.join(many, "state", "left_semi").drop("state"))


def near_words(table: pa.Table) -> pa.Table:
    """Per word of one slice: how many near words its states give, and of those the one of
    largest n, the smallest of equals."""
    states: dict[tuple, list[str]] = defaultdict(list)
    count = dict(zip(table["word"].to_pylist(), table["n"].to_pylist(), strict=True))
    for word, ell, a, b in zip(*(table[c].to_pylist() for c in ("word", "ell", "a", "b")), strict=True):
        end = len(word) - b
        states[ell, a, b, word[:a], word[end:]].append(word[a:end])
    machine = Acceptor()
    near: Counter[str] = Counter()
    best: dict[str, tuple[int, str]] = {}
    for (ell, a, b, head, tail), middles in states.items():
        own = [m for m in middles if len(m) == ell - a - b]
        if len(middles) < 2 or not own:
            continue
        for x, y in machine.pairs(machine.state(own), machine.state(middles), b == 0):
            x, y = head + x + tail, head + y + tail
            near[x] += 1
            near[y] += 1
            for word, other in ((x, y), (y, x)):
                rank = (-count[other], other)
                if word not in best or rank < best[word]:
                    best[word] = rank
    return pa.table({"word": pa.array(near, pa.string()), "n_near": pa.array(near.values(), pa.int64()),
                     "less": pa.array([best[w][0] for w in near], pa.int64()), "form": pa.array([best[w][1] for w in near], pa.string())})


def followed(links: DataFrame) -> DataFrame:
    """word, root: `links` (word, form) followed to their ends by doubling. Each link leads
    to a word several times as frequent, so that a few rounds do."""
    links = checkpoint(links.select("word", F.col("form").alias("root")))
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        ahead = checkpoint(links.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        links = ahead.select("word", "root")
        if ahead.where("moved").isEmpty():
            return links


def spelling_variants(documents: DataFrame, key: str = "doc_id", text: str = "text", *, least: int = LEAST, twice: int = TWICE,
                      spoil: int = SPOIL, ratio: int = RATIO, heavy: int = HEAVY, long: int = LONG, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary.

    Runs of letters (A-Z, a-z, U+00C0 to U+00FF) of all texts, A-Z in lower case; a run
    loses a code point if `spoil` divides its checksum. Words are what has `least` code
    points and `twice` occurrences at least. Two words are near if one edit of a code point
    makes them equal. A word's form is its near word of largest n (ties: the smallest) if
    that is `ratio` times its own or more; root is where forms lead in the end, the word
    itself without one. A null text is empty, a null key an empty string; rows that share
    a key are each read, other columns are ignored, and an empty table gives no rows.
    """
    words = checkpoint(vocabulary(documents, key, text, least=least, twice=twice, spoil=spoil))
    slices = max(shuffle_partitions(words.sparkSession), -(-4 * words.count() // slice_rows))
    states = state_rows(words, least, heavy, long).withColumn("_slice", F.pmod("state", F.lit(slices)).cast("int"))
    found = states.groupBy("_slice").applyInArrow(near_words, "word string, n_near long, less long, form string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "form")).alias("best"))
    near = words.join(best, "word", "left").withColumn("form_n", -F.col("best.less"))
    often = F.col("form_n") >= ratio * F.col("n")
    near = checkpoint(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(often, F.col("best.form")).alias("form"),
                                  F.when(often, F.col("form_n")).alias("form_n")))
    roots = followed(near.where("form is not null"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

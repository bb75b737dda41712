"""Quality rules: boosted trees over statistics of a document, scored as flat node arrays."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import SPACE, U64, Texts, mix, pieces, slice_hashes, split_words, texts_of, window_hashes, window_starts, word_hashes
from .worker import drop

# Symbols that are counted, and the base rules.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50  # words; percent of words in repeated windows
REPEAT = 3

#: Rows that are judged together.
AT_ONCE = 1000
#: Labelled rows that the trees are fitted to: those of the smallest key hashes.
MOST_LABELS = 20_000
TREES, DEPTH, RATE, BINS, LEAST_WEIGHT, RIDGE = 80, 4, 0.15, 64, 4.0, 1.0
FEATURES = ("words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "upper", "digits", "stops", "line_words", "other")
#: -1: more of it never raises the score; 0: free.
TRENDS = {"symbols": -1, "dup_lines": -1, "repeats": -1}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def in_bytes(chars: bytes) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[list(chars)] = 1
    return table


def per_text(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of marks in each text."""
    total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Which keys occur twice or more."""
    _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
    return count[inverse] > 1


def text_statistics(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(base statistics, features) of each text, one row per text."""
    n = len(texts)
    base, features = np.zeros((n, len(BASE)), np.int64), np.zeros((n, len(FEATURES)))
    for first, part in pieces(texts):
        m = len(part)
        words, data = split_words(part), part.data
        n_words, owner = words.counts(), words.text_of()
        salt = mix(np.arange(1, m + 1, dtype=U64))
        starts_char = (data & 0xC0) != 0x80
        space = SPACE[data]
        # lines: pieces between "\n" and text borders, kept if they hold a word
        edges = np.unique(np.concatenate([part.offsets, np.flatnonzero(data == 10) + 1]))
        lo, hi = edges[:-1], edges[1:]
        hi = hi - ((hi > lo) & (data[np.maximum(hi, 1) - 1] == 10) if len(data) else 0)
        held = per_text(~space, edges) > 0 if len(edges) > 1 else np.zeros(0, bool)
        lo, hi = lo[held], hi[held]
        line_owner = np.searchsorted(part.offsets, lo, "right") - 1
        line_hash = slice_hashes(data, lo, hi) ^ salt[line_owner]
        _, first_line = np.unique(line_hash, return_index=True)
        n_lines = np.bincount(line_owner, minlength=m)
        dup_lines = n_lines - np.bincount(line_owner[first_line], minlength=m)
        hashes = word_hashes(part, words)
        at = window_starts(words, REPEAT)
        twice = at[repeated(window_hashes(hashes, at, REPEAT) ^ salt[owner[at]])]
        cover = np.zeros(len(owner), bool)
        for i in range(REPEAT):
            cover[twice + i] = True
        repeats = np.bincount(owner[cover], minlength=m)
        _, first_word = np.unique(hashes ^ salt[owner], return_index=True)
        distinct = np.bincount(owner[first_word], minlength=m)
        count = lambda marks: per_text(marks, part.offsets)
        chars = count(starts_char & ~space)
        symbols = count(in_bytes(SYMBOLS)[data])
        here = slice(first, first + m)
        base[here] = np.stack([n_words, chars, symbols, dup_lines, repeats], 1)
        w, c, ln = np.maximum(n_words, 1), np.maximum(chars, 1), np.maximum(n_lines, 1)
        upper, digits = count((data >= 65) & (data <= 90)), count((data >= 48) & (data <= 57))
        letters = count(((data | 32) >= 97) & ((data | 32) <= 122))
        wide = count((data >= 0xC0))
        features[here] = np.stack([
            np.log1p(n_words), chars / w, symbols / w, dup_lines / ln, repeats / w, distinct / w, upper / c, digits / c,
            count(in_bytes(b".!?")[data]) / w, n_words / ln, np.maximum(c - letters - wide - digits - symbols, 0) / c], 1)
    return base, features


@dataclass
class Trees:
    """All trees in one set of arrays; a leaf leads to itself. Score: log odds."""

    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                low = x[rows, self.feature[node]] <= self.limit[node]
                node = np.where(low, self.left[node], self.right[node])
            out += self.value[node]
        return out


def fit(x: np.ndarray, y: np.ndarray, trends: Sequence[int], *, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Logistic boosting on binned features. A split on a feature with a trend must part
    the values that way, and its middle then bounds both sides below it."""
    n, width = x.shape
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if n else 0.5
    start = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for f in range(width)]
    bins = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], 1) if n else np.zeros((0, width), int)
    nodes: list[list] = []
    roots, margin = [], np.full(n, start)

    def leaf(value: float) -> int:
        nodes.append([0, np.inf, len(nodes), len(nodes), value])
        return len(nodes) - 1

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        g_all, h_all = g[rows].sum(), h[rows].sum()
        own = float(np.clip(-g_all / (h_all + RIDGE), low, high))
        best = (1e-6, 0, 0, 0.0, 0.0)
        if level < depth and h_all > 2 * LEAST_WEIGHT:
            for f in range(width):
                size = len(cuts[f]) + 1
                gs = np.cumsum(np.bincount(bins[rows, f], g[rows], size))[:-1]
                hs = np.cumsum(np.bincount(bins[rows, f], h[rows], size))[:-1]
                a = np.clip(-gs / (hs + RIDGE), low, high)
                b = np.clip(-(g_all - gs) / (h_all - hs + RIDGE), low, high)
                fall = lambda v, gg, hh: -(gg * v + (hh + RIDGE) * v * v / 2)
                gain = fall(a, gs, hs) + fall(b, g_all - gs, h_all - hs) - fall(own, g_all, h_all)
                gain[(hs < LEAST_WEIGHT) | (h_all - hs < LEAST_WEIGHT) | (trends[f] * (b - a) < 0)] = -np.inf
                if len(gain) and gain.max() > best[0]:
                    i = int(np.argmax(gain))
                    best = (float(gain[i]), f, i, float(a[i]), float(b[i]))
        if best[0] <= 1e-6:
            return leaf(own * rate)
        _, f, i, a, b = best
        down = bins[rows, f] <= i
        at = leaf(0.0)
        middle = (a + b) / 2
        bounds = ((low, high), (low, high)) if not trends[f] else ((middle, high), (low, middle)) if trends[f] < 0 else ((low, middle), (middle, high))
        left, right = (grow(rows[side], g, h, level + 1, *bound) for side, bound in zip((down, ~down), bounds, strict=True))
        nodes[at] = [f, float(cuts[f][i]), left, right, 0.0]
        return at

    def flat() -> Trees:
        feature, limit, left, right, value = (np.array(c) for c in zip(*nodes, strict=True)) if nodes else [np.zeros(0)] * 5
        return Trees(feature.astype(int), limit, left.astype(int), right.astype(int), value, np.array(roots, int), start, depth)
    if n and 0 < y.sum() < n:
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            roots.append(grow(np.arange(n), p - y, p * (1 - p), 0, -np.inf, np.inf))
            tree = flat()
            tree.roots, tree.start = np.array(roots[-1:]), 0.0
            margin += tree.score(x)
    return flat()


def labelled_features(documents: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int) -> DataFrame:
    """key, features and label of at most `most` labelled documents."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("key"), "key").limit(most)
    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "key")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            _, features = text_statistics(texts_of(batch["text"]))
            yield pa.RecordBatch.from_arrays([batch["key"].cast(pa.int64()), batch["label"], pa.array(features.tolist(), pa.list_(pa.float64()))],
                                             ["key", "label", "features"])
    return rows.select("key", "label", "text").mapInArrow(measure, "key long, label int, features array<double>")


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", *, label: str = "quality",
          most: int = MOST_LABELS, trends: dict[str, int] | None = None) -> Trees:
    """Fit the trees to at most `most` labelled rows, those with the smallest hash of the
    key; a bounded sample that the driver holds. Without labels of both kinds every
    document gets the same score."""
    rows = labelled_features(documents, labels, key, text, label, most).orderBy("key").toArrow()
    x = np.array(rows["features"].to_pylist(), float).reshape(len(rows), len(FEATURES))
    wanted = TRENDS if trends is None else trends
    return fit(x, np.asarray(rows["label"], float), [wanted.get(f, 0) for f in FEATURES])


def judge(texts: Texts, model: Trees) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Base statistics, base_failed, score and kept of each text."""
    base, features = text_statistics(texts)
    failed = (base[:, 0] < LEAST_WORDS) | (100 * base[:, 4] > MOST_REPEATED * base[:, 0])
    score = model.score(features)
    return base, failed, score, ~failed & (score >= 0)


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of AT_ONCE rows, without what operators before left in the worker."""
    drop("byte_encoder", "word_encoder")
    for batch in batches:
        yield from (batch.slice(lo, AT_ONCE) for lo in range(0, batch.num_rows, AT_ONCE))


def verdicts(documents: DataFrame, model: Trees, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept
    and score (log odds of good quality) for every row.

    A null or empty text has no words and fails the base rules, as do texts under
    LEAST_WORDS words or with over MOST_REPEATED percent of their words in repeated
    3-word windows; the others are kept when the trees say good or even. Null keys and
    repeated rows are judged like any. Other columns are ignored.
    """
    rows = documents.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            base, failed, score, kept = judge(texts_of(batch["text"]), model)
            yield pa.RecordBatch.from_arrays([batch["key"], *(pa.array(c) for c in base.T), pa.array(failed), pa.array(kept), pa.array(score)],
                                             ["key", *BASE, "base_failed", "kept", "score"])
    kinds = ", ".join(f"{c} long" for c in BASE)
    return rows.mapInArrow(run, f"key long, {kinds}, base_failed boolean, kept boolean, score double").withColumnRenamed("key", key)


def keep_good(documents: DataFrame, model: Trees, text: str = "text") -> DataFrame:
    """The rows that are kept, with all their columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            *_, kept = judge(texts_of(batch[text]), model)
            yield batch.filter(pa.array(kept))
    return documents.mapInArrow(run, documents.schema)

"""Substring dedup by words and by bytes, n-gram Jaccard groups: against brute force."""

import random
from itertools import combinations
from math import comb

import corpus
import numpy as np
import pytest

from frameflow.llm import groups, ngrams, sketch, substrings, suffixes, words


def rows_of(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


@pytest.mark.parametrize("rows", [corpus.odd_texts(1), corpus.given()], ids=["odd", "given"])
def test_windows_against_brute_force(spark, rows):
    got = rows_of(substrings.remove_repeats(corpus.frame(spark, rows)), "doc_id", "n_words", "n_removed", "kept")
    assert {r[0]: r[1:] for r in got} == corpus.windows_removed(rows)


@pytest.mark.parametrize("rows", [corpus.odd_texts(2), corpus.given(80)], ids=["odd", "given"])
def test_bytes_against_brute_force(spark, rows):
    for hot in (suffixes.HOT_RUNS, 0):  # 0: every undecided anchor goes the way of hot ones
        got = rows_of(suffixes.remove_repeated_bytes(corpus.frame(spark, rows), hot_runs=hot), "doc_id", "n_bytes", "n_removed", "n_spans", "kept")
        assert sorted((r[0], *r[1:4], bytes(r[4])) for r in got) == sorted(corpus.bytes_removed(rows))


@pytest.mark.parametrize("rows", [corpus.odd_texts(3), corpus.given()], ids=["odd", "given"])
def test_jaccard_groups_against_brute_force(spark, rows):
    got = rows_of(ngrams.jaccard_groups(corpus.frame(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert {r[0]: r[1:] for r in got} == corpus.jaccard_components(rows)


def test_small_sets_meet_by_subsets(spark, monkeypatch):
    """Sets around every size up to the largest boundary, one or two words apart."""
    rng = random.Random(5)
    rows = []
    for size in range(1, 31):
        text = [f"w{size}x{i}" for i in range(size)]
        for change in range(3):
            rows.append((len(rows), " ".join(text + [f"e{change}{j}" for j in range(change)])))
            rows.append((len(rows), " ".join([f"f{rng.random()}"] * (change > 0) + text)))
    for light in (0, 6, 14):
        monkeypatch.setattr(ngrams, "boundary", lambda *_, light=light: light)
        got = rows_of(ngrams.jaccard_groups(corpus.frame(spark, rows)), "doc_id", "n_shingles", "component_id")
        assert {r[0]: r[1:] for r in got} == corpus.jaccard_components(rows)


def test_lists_of_the_same_members_are_one(spark, monkeypatch):
    """Copies of a long text, some words apart, share most of their rare shingles."""
    rng = random.Random(8)
    text = [f"w{i}" for i in range(400)]
    rows = [(10 * i + j, " ".join(f"t{i}{w}" if rng.random() > 0.01 * j else f"x{i}{j}{w}" for w in text)) for i in range(6) for j in range(3)]
    seen = []

    def linked(postings, may_link, verify):
        seen.extend(postings.select("key", "id").collect())
        return ngrams_linked(postings, may_link, verify)
    ngrams_linked = ngrams.linked_components
    monkeypatch.setattr(ngrams, "linked_components", linked)
    got = rows_of(ngrams.jaccard_groups(corpus.frame(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert {r[0]: r[1:] for r in got} == corpus.jaccard_components(rows)
    members = {}
    for key, doc in seen:
        members.setdefault(key, set()).add(doc)
    assert members and len(members) == len({frozenset(m) for m in members.values()})


def test_nulls_repeats_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (5, text), (5, text), (None, None)]
    found = rows_of(substrings.remove_repeats(corpus.frame(spark, rows)), "doc_id", "n_removed")
    assert sorted(found, key=str) == sorted([(5, 0), (5, 0), (None, 60), (None, 0)], key=str)
    found = rows_of(suffixes.remove_repeated_bytes(corpus.frame(spark, rows)), "doc_id", "n_removed")
    assert sorted(found, key=str) == sorted([(5, len(text)), (5, len(text)), (None, len(text)), (None, 0)], key=str)
    found = rows_of(ngrams.jaccard_groups(corpus.frame(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert sorted(found, key=str) == sorted([(5, 56, 5), (5, 56, 5), (None, 56, 5), (None, 0, None)], key=str)
    for run in (substrings.remove_repeats, suffixes.remove_repeated_bytes, ngrams.jaccard_groups):
        assert run(corpus.frame(spark, [])).count() == 0
        assert run(corpus.frame(spark, [(1, None)])).count() == 1


def test_boundary_costs():
    assert ngrams.overlap(9, 9) == 8
    assert ngrams.subset_sizes(9)[9] == 8
    assert ngrams.subset_cost(4) == sum(comb(4, c) for y, c in ngrams.subset_sizes(4).items())
    assert ngrams.boundary({3: 100}, 1.0) >= 3
    assert ngrams.boundary({17: 100}, 1.0) < 17  # a thousand subsets cost more than five lists


def test_subset_keys_are_shared_exactly_when_linked():
    elements = words.mix(np.arange(40, dtype=np.uint64))
    for x, y in combinations(range(1, 13), 2):
        for common in range(min(x, y) + 1):
            if x + y - common > 40:
                continue
            a, b = elements[:x], np.concatenate([elements[:common], elements[x:x + y - common]])
            shared = set(ngrams.light_keys(a, 24, 80).tolist()) & set(ngrams.light_keys(b, 24, 80).tolist())
            assert bool(shared) == (100 * common >= 80 * (x + y - common))


def test_sketch_never_undercounts():
    rng = np.random.default_rng(0)
    parts = [words.mix(rng.integers(0, 300, 500).astype(np.uint64)) for _ in range(3)]
    import pyarrow as pa
    sent = pa.concat_tables([sketch.sent_rows(g, p, 4, 10) for g, p in enumerate(parts)])
    replies = []
    for row in range(sketch.ROWS):
        for s in range(4):
            part = sent.filter((pa.compute.field("_row") == row) & (pa.compute.field("_slice") == s))
            if len(part):
                replies.append(sketch.merge_slice(part))
    replies = pa.concat_tables(replies)
    true = np.unique(np.concatenate(parts), return_counts=True)
    for g, part in enumerate(parts):
        count = sketch.merged_counts(part, replies.filter(pa.compute.field("_g") == g), 10)
        real = true[1][np.searchsorted(true[0], part)]
        assert (np.where(count == 0, 1, count) >= np.minimum(real, 255)).all()


def test_packed_numbers_round_trip():
    rng = np.random.default_rng(1)
    for high in (3, 70_000, 1 << 40):
        values = np.unique(rng.integers(0, high, 200))
        assert (groups.unpack_gaps(groups.pack_gaps(values)) == values).all()
        assert (groups.unpack_ints(groups.pack_ints(values - 5)) == values - 5).all()
        assert (groups.unpack_planes(groups.pack_planes(values.astype(np.uint64))) == values).all()
    extremes = np.array([np.iinfo(np.int64).min, -1, 0, np.iinfo(np.int64).max])
    assert (groups.unpack_ints(groups.pack_ints(extremes)) == extremes).all()


def test_repeated_windows_in_periodic_text():
    rng = random.Random(2)
    for _ in range(60):
        size = rng.randint(2, 12)
        parts = [bytes(rng.choices(b"ab", k=rng.randint(size, 60))) for _ in range(rng.randint(1, 5))]
        text = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8)
        ends = np.cumsum([len(p) + 1 for p in parts])
        first, count = ends - 1 - [len(p) for p in parts], np.array([len(p) - size + 1 for p in parts])
        windows = [bytes(text[f + i:f + i + size]) for f, c in zip(first, count, strict=True) for i in range(c)]
        assert suffixes.repeated_windows(text, first, count, size).tolist() == [windows.count(w) > 1 for w in windows]
        order = suffixes.suffix_array(text)
        assert [bytes(text[i:]) for i in order] == sorted(bytes(text[i:]) for i in range(len(text)))


def morse(n: int) -> str:
    """A sequence of a and b that equals its mirror in every polynomial hash modulo 2**64."""
    out = "a"
    while len(out) < n:
        out += out.translate({97: "b", 98: "a"})
    return out


MIRROR = {97: "b", 98: "a"}


def test_built_collisions_remove_and_link_nothing(spark):
    """Two words of 1,024 letters, and two sequences of 1,024 words, whose sums over any odd
    radix are equal modulo 2**64."""
    one, rest = morse(1024), " ".join(f"w{i}" for i in range(12))
    spelled = " ".join(one), " ".join(one.translate(MIRROR))
    rows = [(1, f"{one} {rest}"), (2, f"{one.translate(MIRROR)} {rest}"), (3, spelled[0]), (4, spelled[1]),
            (5, f"{one} u v w x y z"), (6, f"{one.translate(MIRROR)} u v w x y z")]
    cut = {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(corpus.frame(spark, rows)).collect()}
    assert cut == {i: n for i, (_, n, _) in corpus.windows_removed(rows).items()} and cut[2] == 0
    groups = {r["doc_id"]: r["component_id"] for r in ngrams.jaccard_groups(corpus.frame(spark, rows)).collect()}
    assert groups == {i: c for i, (_, c) in corpus.jaccard_components(rows).items()} and groups[6] == 6


def test_sums_modulo_a_prime_equal_integers():
    rng = np.random.default_rng(4)
    values = rng.integers(0, 1 << 64, 5000, dtype=np.uint64)
    values[:3] = [words.P61, (1 << 64) - 1, 0]
    start = rng.integers(0, 4000, 200)
    end = start + rng.integers(0, 900, 200)
    got = words.prime_sums(values, start, end)
    for a, b, x in zip(start.tolist(), end.tolist(), got.tolist()):
        assert x == sum(int(v) * pow(words.WINDOW_RADIX, j, words.P61) for j, v in enumerate(values[a:b])) % words.P61


def test_hashes_of_words_of_any_length():
    rng = random.Random(6)
    texts = ["".join(rng.choices("ab", k=n)) for n in [*range(1, 40), 447, 448, 449, 450, 3000] for _ in range(4)]
    texts += [t[:-1] + "c" for t in texts] + ["é" * 9, "\0", "\0\0", "\0" * 8, "AbC", "abc"]
    import pyarrow as pa
    for lane in (0, 1):
        for lower in (False, True):
            part = words.texts_of(pa.array(texts))
            got = words.word_hashes(part, words.split_words(part), lane, lower).tolist()
            by_hash = dict(zip(got, (corpus.lower(t) if lower else t for t in texts)))
            assert len(by_hash) == len({corpus.lower(t) if lower else t for t in texts})
            alone = [words.word_hashes(p, words.split_words(p), lane, lower)[0] for p in (words.texts_of(pa.array([t])) for t in texts)]
            assert alone == got

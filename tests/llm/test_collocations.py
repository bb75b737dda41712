"""Collocations against brute force, in many small groups and few large ones."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from corpus import lower, odd_texts

from frameflow.llm import collocations

SCHEMA = "doc_id long, text string, lang string, n long, word string, ids string, _g int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "w", "i", 2) for i, t, lang in rows], SCHEMA)


def by_hand(rows, often, most, longest=5, absorb=100):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i:i + k]) for i in range(len(words)) for k in range(1, min(longest, len(words) - i) + 1))
    candidates = {p for p, c in f.items() if len(p) > 2 and c >= often}
    covered = {(p[0], *p[i:i + m]) for p in candidates for m in range(2, len(p) - 1) for i in range(1, len(p) - m + 1)
               if 100 * f[p] >= absorb * f[p[0], *p[i:i + m]]}
    out = []
    for p in candidates - covered:
        lang, words, a = p[0], p[1:], f[p]
        score, _, l, r = min((1000 * a * n[lang] // (f[p[:1 + k]] * f[lang, *words[k:]]), k, f[p[:1 + k]], f[lang, *words[k:]]) for k in range(1, len(words)))
        out.append((lang, -score, -a, " ".join(words).encode(), l, r))
    out.sort()
    seen, result = Counter(), []
    for lang, score, a, phrase, l, r in out:
        seen[lang] += 1
        if seen[lang] <= most:
            result.append((lang, seen[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(result)


def talk(seed=3):
    """Few words, so that phrases repeat: overlaps, one word over and over, ties, odd letters."""
    rng = random.Random(seed)
    words = "the of New york ÉTÉ été san 𝒳y don't a-b x".split()
    rows = []
    for i in range(260):
        parts = []
        for _ in range(rng.randint(1, 25)):
            parts.append(rng.choice(["new york city of light", "San Francisco", "x x x x x x x", " ".join(rng.choices(words, k=rng.randint(1, 7)))]))
            parts.append(rng.choice([". ", ", ", "\n", "\r\n", " ", "\t", "  ", "\x0b", "; "]))
        rows.append((rng.choice([None, i, 7]), "".join(parts), rng.choice(["en", "fr", None, "und"])))
    return rows + [(i, t, "en") for i, t in odd_texts()]


@pytest.mark.parametrize("often,most,group", [(100, 2000, None), (5, 30, 4096), (2, 2000, 1000)])
def test_equals_brute_force(spark, often, most, group):
    rows = talk()
    found = collocations.collocations(frame(spark, rows), often=often, most=most, **({"group_bytes": group} if group else {}))
    expected = by_hand(rows, often, most)
    assert len(expected) > 20
    assert sorted(tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == expected


@pytest.mark.parametrize("longest,absorb", [(2, 100), (3, 60)])
def test_other_parameters(spark, longest, absorb):
    rows = talk(4)
    found = collocations.collocations(frame(spark, rows), often=3, longest=longest, absorb=absorb)
    assert sorted(tuple(r) for r in found.collect()) == by_hand(rows, 3, 2000, longest, absorb)


@pytest.mark.parametrize("rows", [[], [(1, None, None), (2, "", "en")], [(1, "one two", "en")]])
def test_nothing_to_find(spark, rows):
    assert collocations.collocations(frame(spark, rows)).count() == 0


def test_scores_past_64_bits(spark):
    parts = spark.createDataFrame([([1], 3_000_000_000), ([2], 4_000_000_000), ([1, 2], 2_900_000_000)], "ids array<int>, f long")
    totals = spark.createDataFrame([(1, "en", 9_000_000_000_000), (2, "en", 9_000_000_000_000)], "id int, lang string, n long")
    row = collocations.scored(parts.where("size(ids) = 2"), parts, totals).first()
    assert row["score"] == 1000 * 2_900_000_000 * 9_000_000_000_000 // (3_000_000_000 * 4_000_000_000)


def test_the_order_of_rows_does_not_matter():
    """A group's rows may come in any order each time it is read."""
    rows = [(lang or "und", t or "") for _, t, lang in talk()] + [("en", "plumless buckeroo"), ("fr", "buckeroo plumless")]
    table = pa.table({"lang": pa.array([lang for lang, _ in rows]), "text": pa.array([t for _, t in rows])})
    told = []
    for seed in (None, 1, 2):
        order = list(range(len(rows)))
        if seed:
            random.Random(seed).shuffle(order)
        group = collocations.spoken(table.take(pa.array(order)))
        at, edge = collocations.word_order(group, 7)
        told.append(([(group.langs[i].as_py(), group.words[i].as_py()) for i in at.tolist()], edge.tolist()))
    assert told[0] == told[1] == told[2] and len(told[0][0]) > 100

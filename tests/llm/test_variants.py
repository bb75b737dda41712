"""Spelling variants against brute force, with states small enough to be halved often."""

import random
import re
import zlib
from collections import Counter

import pytest
from corpus import frame, given, lower, odd_texts
from pyspark.sql import functions as F

from frameflow.llm import variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def spoiled(key, run):
    h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
    return run if h % 31 else run[:h % len(run)] + run[h % len(run) + 1:]


def counted(rows):
    n = Counter(spoiled(k, lower(run)) for k, text in rows for run in RUN.findall(text or ""))
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def edits(word, alphabet):
    for i in range(len(word) + 1):
        for c in alphabet:
            yield word[:i] + c + word[i:]
            if i < len(word):
                yield word[:i] + c + word[i + 1:]
        if i < len(word):
            yield word[:i] + word[i + 1:]


def by_hand(n):
    alphabet = sorted({c for w in n for c in w})
    near = {w: {x for x in edits(w, alphabet) if x in n and x != w} for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, form[w], root(w), n[w], len(near[w]), form[w] and n[form[w]]) for w in n)


def result(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def spelled(seed=1):
    """Texts with frequent words, their misspellings, runs of one letter and odd letters."""
    rng = random.Random(seed)
    texts = []
    for length in (7, 7, 8, 9, 9, 12, 16, 30):
        base = "".join(rng.choices("abñé", k=length))
        words = [base] * 420 + [base + "z"] * 30 + [base + "zz"] * 2 + [base + "zzé"] * 2
        for _ in range(12):
            i = rng.randrange(length)
            words += [base[:i] + rng.choice("abcÀ") + base[i + rng.randint(0, 1):]] * rng.choice([2, 3, 12, 25]) + [base[:i] + base[i + 1:]] * 2
        words += ["a" * (length + k) for k in (0, 1, 2) for _ in range(2 + 20 * k)] + [base.upper()]
        rng.shuffle(words)
        texts += [" ".join(words[i:i + 60]) + "." for i in range(0, len(words), 60)]
    return list(enumerate(texts))


@pytest.mark.parametrize("heavy,long", [(variants.HEAVY, variants.LONG), (2, 3), (5, 64), (10_000, 2)])
def test_equals_brute_force(spark, heavy, long):
    rows = spelled() + odd_texts() + [(None, "naïveté naïveté naivete"), (4, "y" * 900 + " " + "y" * 901 + " " + "y" * 900 + " " + "y" * 901)]
    expected = by_hand(counted(rows))
    assert sum(1 for w in expected if w[1]) > 20 and any(w[1] and w[1] != w[2] for w in expected)
    assert result(variants.spelling_variants(frame(spark, rows), heavy=heavy, long=long, slice_rows=200)) == expected


def test_given_documents(spark):
    rows = given()
    assert result(variants.spelling_variants(frame(spark, rows))) == by_hand(counted(rows))


def test_empty_table(spark):
    assert variants.spelling_variants(frame(spark, []).limit(0)).count() == 0


def test_checksums_of_long_runs_and_any_key():
    rng = random.Random(2)
    runs = ["".join(rng.choices("abÿ", k=k)) for k in [*range(7, 90), 500]]
    texts = [" ".join(runs)] * 40
    keys = [str(rng.choice([7, -3, 10**18, ""])) + str(i) for i in range(40)]
    import pyarrow as pa

    from frameflow.llm.words import texts_of
    found = variants.tally(keys, texts_of(pa.array(texts)), variants.shift_tables(variants.TABLED))
    expected = Counter(w for k in keys for w in (spoiled(k, r) for r in runs) if len(w) >= 7)
    assert dict(zip(found["word"].to_pylist(), found["n"].to_pylist(), strict=True)) == expected


def test_states_stay_small(spark):
    words = spark.range(4000).select(F.concat(F.lit("internation"), F.translate(F.format_string("%04d", "id"), "0123456789", "abcdefghij")).alias("word"), F.lit(5).alias("n"))
    states = variants.state_rows(words, heavy=300)
    assert states.groupBy("state").count().agg(F.max("count")).first()[0] <= 300

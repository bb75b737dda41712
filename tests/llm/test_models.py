"""Quality trees, context-tree scores, packing, wavelet files, shards, templates, lines."""

import math
import random
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import corpus
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from frameflow.llm import contexts, curve, lines, packing, quality, templates, tokens, wavelet, worker
from frameflow.llm.words import texts_of

CLASH = "doc_id long, text string, _g int, key string, shard int, length int, curve int"


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# -- quality rules ------------------------------------------------------------------

def test_base_statistics_against_plain_python(spark):
    rows = corpus.odd_texts(4) + [(90_001, "# a *b* $5 <x>|y & 10%\n# a *b* $5 <x>|y & 10%\n\n\n"), (90_002, "z " * 80)]
    labels = spark.createDataFrame([(90_001, 0), (90_002, 1)], "doc_id long, quality int")
    docs = corpus.frame(spark, rows)
    got = by_id(quality.verdicts(docs, quality.train(docs, labels)))
    for i, text in rows:
        words, text = corpus.WORD.findall(text or ""), text or ""
        held = [x for x in text.split("\n") if corpus.WORD.search(x)]
        seen = Counter(tuple(words[j:j + 3]) for j in range(len(words) - 2))
        cover = {j + d for j in range(len(words) - 2) if seen[tuple(words[j:j + 3])] > 1 for d in range(3)}
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(held) - len(set(held)), len(cover))
        failed = len(words) < 50 or 100 * len(cover) > 50 * len(words)
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_trees_learn_and_hold_their_trends():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] + 0.3 * rng.normal(size=3000) < 0.5) & (x[:, 1] > 0.2)).astype(float)
    model = quality.fit(x, y, (-1, 0, 1))
    test = rng.random((500, 3))
    truth = (test[:, 0] < 0.5) & (test[:, 1] > 0.2)
    assert ((model.score(test) > 0) == truth).mean() > 0.85
    for feature, sign in ((0, -1), (2, 1)):
        low, high = test.copy(), test.copy()
        high[:, feature] += rng.random(500)
        assert (sign * (model.score(high) - model.score(low)) >= -1e-9).all()


def test_held_out_accuracy_on_the_given_labels(spark):
    docs = spark.read.parquet(f"{corpus.SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{corpus.SF_DIR}/labels.parquet")
    train = labels.where("doc_id % 2 = 0")
    got = by_id(quality.verdicts(docs, quality.train(docs, train)))
    rest = [(got[r["doc_id"]], r["quality"]) for r in labels.where("doc_id % 2 = 1").collect()]
    scored = [(r["kept"], q) for r, q in rest if not r["base_failed"]]
    assert sum(k == bool(q) for k, q in scored) / len(scored) > 0.9


def test_no_labels_and_filter_keeps_all_columns(spark):
    rows = corpus.odd_texts(5)
    docs = corpus.frame(spark, rows)
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(docs, none)
    verdicts = by_id(quality.verdicts(docs, model))
    assert all(r["kept"] != r["base_failed"] for r in verdicts.values())
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in verdicts.items() if r["kept"]}
    assert quality.verdicts(corpus.frame(spark, []), model).count() == 0


# -- context trees ------------------------------------------------------------------

def slow_scores(rows, depth):
    """Context-tree weighting with plain dictionaries: log10 probability per text."""
    def stream(text):
        return b"".join(w.encode() + b" " for w in corpus.WORD.findall(corpus.lower(text or ""))) + b"\n"
    counts = [defaultdict(lambda: [0, 0]) for _ in range(depth + 1)]

    def path(data, i, bit):
        before = (b"\n" * depth + data[:i])[-depth:][::-1]
        prefix = (1 << bit) | (data[i] >> (8 - bit))
        return [(before[:d], prefix) for d in range(depth + 1)]
    for key, text in rows:
        if not corpus.held_out(key):
            data = stream(text)
            for i in range(len(data)):
                for bit in range(8):
                    for d, node in enumerate(path(data, i, bit)):
                        counts[d][node][data[i] >> (7 - bit) & 1] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    weight, below = [{} for _ in counts], defaultdict(float)
    for d in range(depth, -1, -1):
        above = defaultdict(float)
        for node, (a, b) in counts[d].items():
            own = kt(a, b)
            total = own if d == depth else np.logaddexp(own, below[node]) - math.log(2)
            weight[d][node] = 1.0 if d == depth else math.exp(own - math.log(2) - total)
            above[node[0][:-1], node[1]] += total
        below = above
    out = {}
    for key, text in rows:
        data, score = stream(text), 0.0
        for i in range(len(data)):
            for bit in range(8):
                chance, reached = 0.5, False
                for d, node in reversed(list(enumerate(path(data, i, bit)))):
                    if node in counts[d]:
                        a = counts[d][node]
                        w = weight[d][node] if reached else 1.0
                        chance = w * (a[data[i] >> (7 - bit) & 1] + 0.5) / (sum(a) + 1) + (1 - w) * chance
                        reached = True
                score += math.log10(chance)
        out[key] = score
    return out


def test_scores_against_dictionaries(spark):
    rows = [(i, t[:700] if t else t) for i, t in corpus.odd_texts(6)]
    got = by_id(contexts.score(corpus.frame(spark, rows), depth=3))
    slow = slow_scores(rows, 3)
    tokens = Counter()
    for key, text in rows:
        if not corpus.held_out(key):
            tokens.update([*corpus.WORD.findall(corpus.lower(text or "")), None])
    n, v = sum(tokens.values()), len(tokens)
    for key, text in rows:
        words = [*corpus.WORD.findall(corpus.lower(text or "")), None]
        r = got[key]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (corpus.held_out(key), len(words), sum(tokens[w] > 0 for w in words), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((tokens[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words), rel=1e-5)
        assert r["score"] == pytest.approx(slow[key], rel=1e-5)


def test_chances_of_all_bytes_add_up():
    data = np.frombuffer(b"the cat sat on the mat \n" * 3, np.uint8)
    keys, counts = np.unique(contexts.grams(data, np.array([0, len(data)]), 4), return_counts=True)
    levels = contexts.subtree(keys, counts.astype(np.int64), 4)
    low = levels[contexts.TOP]
    parent, inverse = np.unique(low.node >> np.uint64(16) << np.uint64(8) | low.node & np.uint64(255), return_inverse=True)
    levels |= contexts.top_levels(parent, *(np.bincount(inverse, x).astype(np.int64) for x in (low.zeros, low.ones)), np.bincount(inverse, low.log_weighted))
    for context in (keys[0], keys[7], np.uint64(0xAABBCCDD00)):
        every = (context >> np.uint64(8) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert np.sum(10 ** contexts.log_probabilities(every, levels, 4)) == pytest.approx(1)


def test_scores_of_nothing(spark):
    assert contexts.score(corpus.frame(spark, [])).count() == 0
    only = contexts.score(corpus.frame(spark, [(None, None)])).first()  # held out, nothing to learn from
    assert only["held_out"] and only["n_tokens"] == 1 and only["n_known"] == 0 and only["train_tokens"] == 0
    assert only["score"] == pytest.approx(8 * math.log10(0.5))


# -- packing ------------------------------------------------------------------------

@pytest.mark.parametrize("counts", [{}, {5: 3}, {2048: 4}, {1: 5000}, {1025: 7, 1023: 7}, {700: 1, 699: 5, 1350: 9, 3: 2},
                                    {n: (n * 37) % 11 for n in range(1, 2049)}], ids=str)
def test_plan_places_every_piece_once(counts):
    runs = packing.plan(counts)
    ranks, fill = defaultdict(list), defaultdict(list)
    for length, first, n, at, offset in runs:
        assert n > 0
        for i in range(n):
            ranks[length].append(first + i)
            fill[at + i].append((offset, length))
    assert {x: sorted(r) for x, r in ranks.items()} == {x: list(range(n)) for x, n in counts.items() if n}
    for places in fill.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(x * n for x, n in counts.items())
    if len(counts) > 100:
        assert len(fill) <= 1.02 * total / 2048 + 2


def test_groups_have_equal_cardinality():
    tops, cards = packing.linear_groups(np.array([90, 80, 70, 60]), np.array([5, 1, 9, 5]), 4)
    assert cards.sum() == 20 and tops.tolist() == [90, 80, 70, 60][:len(tops)] or (np.diff(tops) < 0).all()


@pytest.mark.parametrize("rows", [corpus.odd_texts(7), corpus.given(60)], ids=["odd", "given"])
def test_packed_ids_round_trip(spark, rows):
    import public_tokenizers
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = rows + [(80_000, "a   b\n\n  c <|endoftext|> d's 1,000.50 "), (80_001, "word " * 5000)]
    got = packing.pack(corpus.frame(spark, rows), keep_ids=True).collect()
    pieces, places = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
    for i, text in rows:
        own = sorted(pieces[i], key=lambda r: r["piece"])
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        assert b"".join(bytes(r["ids"]) for r in own) == ids.tobytes()
        assert [r["start"] for r in own] == np.cumsum([0] + [r["length"] for r in own])[:-1].tolist()
        assert all(r["length"] == 2048 for r in own[1:]) if len(ids) > 2048 else len(own) == 1
    for spots in places.values():
        assert np.cumsum([0] + [n for _, n in sorted(spots)])[:-1].tolist() == [o for o, _ in sorted(spots)]
        assert sum(n for _, n in spots) <= 2048
    assert packing.pack(corpus.frame(spark, [])).count() == 0
    assert packing.pack(corpus.frame(spark, [(None, None), (None, None), (3, "")])).count() == 3


# -- wavelet files ------------------------------------------------------------------

def test_wavelet_reads_like_a_list():
    rng = np.random.default_rng(3)
    for n in (0, 1, 700, 3000):
        ids = rng.choice([0, 2, 5, 40_000, 49_407], n).astype(np.uint32)
        shard = wavelet.Shard(wavelet.encode_shard(ids, np.array([n]), 16))
        assert (shard.ids() == ids).all() and shard.lengths.tolist() == [n]
        for at in range(0, n, 97):
            assert shard.access(at) == ids[at]
        for token in (0, 2, 40_000, 7):
            where = np.flatnonzero(ids == token)
            assert shard.count(token) == len(where)
            assert shard.count(token, n // 3, n // 2) == ((where >= n // 3) & (where < n // 2)).sum()
            assert [shard.select(token, k) for k in range(0, len(where), 50)] == where[::50].tolist()
            with pytest.raises(IndexError):
                shard.select(token, len(where))
    with pytest.raises(ValueError):
        wavelet.encode_shard(np.array([70_000]), np.array([1]), 16)


@pytest.mark.parametrize("rows", [corpus.odd_texts(8), corpus.given()], ids=["odd", "given"])
def test_shards_round_trip(spark, rows, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wavelet.write_shards(corpus.frame(spark, rows), str(tmp_path / "shards"), shard_ids=3000)
    got = {r["key"]: r for r in wavelet.read_shards(spark, str(tmp_path / "shards"), keep_ids=True).collect()}
    start = 0
    for i, text in sorted(rows):
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], bytes(got[i]["ids"]), got[i]["ids_crc32"]) == (start, len(ids), ids.tobytes(), zlib.crc32(ids.tobytes()))
        start += len(ids)
    wavelet.write_shards(corpus.frame(spark, []), str(tmp_path / "none"))
    assert wavelet.read_shards(spark, str(tmp_path / "none")).count() == 0
    wavelet.write_shards(corpus.frame(spark, [(None, None), (4, "a b"), (4, "a b")]), str(tmp_path / "few"))
    assert [r["start"] for r in wavelet.read_shards(spark, str(tmp_path / "few")).orderBy("start").collect()] == [0, 1, 4]


# -- shards along a curve -----------------------------------------------------------

@pytest.mark.parametrize("dims,bits", [(1, 3), (2, 4), (3, 3), (4, 2)])
def test_neighbours_on_the_curve_are_neighbours_in_the_grid(spark, dims, bits):
    cells = spark.range(1 << dims * bits).selectExpr(f"transform(sequence(0, {dims - 1}), i -> cast(shiftright(id, i * {bits}) & {(1 << bits) - 1} as int)) as c")
    got = cells.select("c", curve.hilbert(cells["c"], dims, bits).alias("h")).orderBy("h").collect()
    assert [r["h"] for r in got] == list(range(1 << dims * bits))
    assert all(sum(abs(a - b) for a, b in zip(x["c"], y["c"], strict=True)) == 1 for x, y in zip(got, got[1:], strict=False))


def test_shards_are_even_and_prunable(spark, tmp_path):
    docs = spark.read.parquet(f"{corpus.SF_DIR}/documents.parquet")
    found = curve.assign(docs, ["lang", "n_chars"], carry=["lang", "n_chars"], shards=8)
    rows = found.collect()
    texts = dict(corpus.given())
    assert len(rows) == len(texts)
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(8))
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in rows)
    kinds = [len({r["lang"] for r in rows if r["shard"] == s}) for s in sizes]
    assert sum(kinds) < 0.8 * len(sizes) * len({r["lang"] for r in rows})  # a reader of one language skips files
    curve.write(found, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


def test_shards_of_odd_rows(spark):
    rows = [(None, None), (None, "a"), (3, ""), (3, ""), (4, "x" * 9)]
    docs = spark.createDataFrame([(*r, 1, "k", 2, 3, 4) for r in rows], CLASH)
    got = curve.assign(docs, ["doc_id", "key"], shards=2).collect()
    assert sorted(Counter(r["shard"] for r in got).values()) == [2, 3] and {r["law"] for r in got} == {"rows"}
    assert curve.assign(docs.limit(0), ["key"]).count() == 0
    with pytest.raises(ValueError):
        curve.assign(docs, ["key"], carry=["shard"])


# -- templates ----------------------------------------------------------------------

QUESTION = "Anna has 12 apples and gives 5 apples to Bert so how many apples has Anna now"


@pytest.mark.parametrize("limit", [templates.BROADCAST_ROWS, 0], ids=["broadcast", "shuffle"])
def test_other_names_and_numbers_are_found(spark, limit):
    docs = spark.createDataFrame([
        (1, f"Some text before. {QUESTION}? And more.", None), (2, QUESTION.replace("12", "37").replace("5", "8").replace("Anna", "Carla").replace("Bert", "Dan"), None),
        (3, QUESTION.replace("Anna now", "Zoe now").replace("12", "5"), None),  # slots that don't correspond
        (4, "how many apples are there in a basket of nine", None), (5, None, None), (6, "", None), (None, QUESTION, None), (1, "again", None)],
        "doc_id long, text string, words string")
    items = spark.createDataFrame([(10, QUESTION, "w"), (11, None, "w"), (12, "too short", "w"), (None, QUESTION, "w"), (13, "", "w")], "item_id long, text string, words string")
    got = {r["doc_id"]: r for r in templates.leaks(docs, items, broadcast_rows=limit).collect()}
    assert got[1]["exact"] and not got[2]["exact"] and got[1]["item_id"] == got[2]["item_id"] == 10
    assert got[1]["n_windows"] == got[2]["n_windows"] == got[1]["item_windows"]
    assert 4 not in got and None not in got and set(got) <= {1, 2, 3}
    assert got.get(3) is None or got[3]["n_windows"] < got[1]["n_windows"]
    assert templates.leaks(docs.limit(0), items).count() == 0
    assert templates.leaks(docs, items.limit(0)).count() == 0


def test_strings_are_cut_by_all_their_bytes(spark):
    """Sixteen sites that begin alike get sixteen cells; a null lies before them."""
    rows = [(100 * s + i, f"https://site{s:02d}.example" if i else None) for s in range(16) for i in range(11)]
    docs = spark.createDataFrame(rows, "doc_id long, site string").withColumn("text", F.lit("t"))
    found = curve.assign(docs, ["site", "doc_id"], carry=["site"], shards=16).groupBy("site").agg(F.countDistinct("curve").alias("n"), F.collect_set("shard").alias("s")).collect()
    cells = {r["site"]: set(r["s"]) for r in found}
    assert len(cells) == 17 and max(len(s) for s in cells.values()) <= 5
    cuts = curve.value_cuts(docs, "site", len(rows), [k / 16 for k in range(1, 16)])
    sites = sorted((s or "") for _, s in rows)  # a null first
    assert cuts == [next(s for j, s in enumerate(sites) if s and sum(x <= s for x in sites) > k * len(rows) / 16) for k in range(1, 16)]
    assert len(set(cuts)) >= 14


ODD = ["İ", "i̇", "I", "é", "é", "́", "ß", "ẞ", "Σ", "ς", "ﬁ", "Å", "Å", "가", "가", "中", "ا", "ـ", "١", "5", "½", "Ⅷ", "'", "'s", "’s", " ", "  ",
       "\t", "\n", "\r\n", "\u00a0", "\u2003", "\u0085", "\x0b", "\x1c", *".,;:!?-_", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "a", "B", "xy", "Ñ", "ø",
       "×", "÷", "\u200b", "\u00ad", "😀", "👨\u200d👩", "\ufeff", "\x00", "ª", "ǅ", "ŉ", "ĳ", "ſ"]


@pytest.mark.parametrize("name,make", [("byte_bpe_50k.json", tokens.byte_encoder), ("word_bpe_49k.json", tokens.word_encoder)])
def test_ids_of_odd_strings_are_the_library_s(name, make):
    import public_tokenizers
    from tokenizers import Tokenizer
    rng, whole, encode = random.Random(5), Tokenizer.from_file(public_tokenizers.path(name)), make()
    texts = ["BELGESİ, BİLGİ. son", "hello <|endoftext|> world", "a<|startoftext|>,"]
    texts += ["".join(rng.choice(ODD) if rng.random() < .8 else rng.choice("abcdeéàñABC ,.") for _ in range(rng.randint(0, 14))) for _ in range(30_000)]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


# -- fuzzy lines --------------------------------------------------------------------

def test_lines_alike_are_kept_once(spark):
    long = "the quick brown fox jumps over the lazy dog and runs far away from the old red barn before the night falls on the quiet valley below"
    rows = [(5, f"{long}\nown line of five here"), (2, f"first line of two here\n{long.upper()}!!"), (9, long.replace("quiet", "quiets") + "\nok"),
            (7, None), (8, ""), (None, f"{long}\nnull has this line too"), (11, "ok\nok\n\n"), (12, "first line of 2 here\nfirst line of 3 here")]
    docs = corpus.frame(spark, rows)
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs, removed="gone").collect()}
    assert got[2]["text"] == rows[1][1] and got[2]["gone"] == 0  # the smallest key has the first occurrence
    assert got[5]["text"] == "own line of five here" and got[9]["text"] == "ok"
    assert got[None]["text"] == "null has this line too"
    assert got[7]["text"] is None and got[8]["text"] == "" and got[11]["text"] == "ok\nok\n\n"
    assert got[12]["text"] == "first line of 2 here"  # digits are alike
    assert lines.dedup_lines(docs).columns == docs.columns
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_equal_lines_leave_one_occurrence_on_given_texts(spark):
    rows = corpus.given()
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(corpus.frame(spark, rows)).collect()}

    def normal(line):
        plain = "".join("0" if c in "0123456789" else c for c in corpus.lower(line) if c not in lines.PUNCTUATION)
        return " ".join(corpus.WORD.findall(plain))
    seen: Counter = Counter()
    for _, text in sorted(got.items()):
        seen.update(n for x in text.split("\n") if len((n := normal(x)).split()) >= lines.LEAST_WORDS)
    assert max(seen.values()) == 1
    left = {n for _, t in rows for x in t.split("\n") if len((n := normal(x)).split()) >= lines.LEAST_WORDS}
    # a line that went has one like it that stayed: none is lost without a partner
    gone = left - set(seen)
    assert all(any(alike(g, s) for s in seen) for g in gone)


def test_rows_of_one_key_keep_their_own_lines(spark):
    """Rows with a null or the same key are told apart: a repeat goes from the row that holds it."""
    alone = "a unique line found in no other document at all"
    rows = [(None, f"a line that both of them have\n{alone}"), (None, f"{alone} but this\na line that both of them have"),
            (5, "one more line of this key here\nfive has this line for itself"), (5, "another of the same key\none more line of this key here")]
    got = sorted((r["doc_id"] or 0, r["text"]) for r in lines.dedup_lines(corpus.frame(spark, rows)).collect())
    kept = [line for _, t in got for line in t.split("\n") if line]
    assert sorted(kept) == sorted({line for _, t in rows for line in t.split("\n")})


def alike(a: str, b: str, percent: int = 90) -> bool:
    most = max(len(a), len(b)) * (100 - percent) // 100
    if abs(len(a) - len(b)) > most:
        return False
    before = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row = [i]
        for j, d in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (c != d)))
        if min(row) > most:
            return False
        before = row
    return before[-1] <= most


def test_rounds_leave_the_same_lines(spark, monkeypatch):
    """Entries, texts and pairs in rounds, against all at once."""
    docs = corpus.frame(spark, corpus.given() + [(10**6 + i, t) for i, t in corpus.odd_texts(4)])
    wanted = sorted(str(tuple(r)) for r in lines.dedup_lines(docs, removed="gone").collect())
    met = []

    def group_count(*_):
        return 3

    def linked(postings, may_link, verify, *, pairs):
        met.append(pairs.count())
        return linked_components(postings, may_link, verify, pairs=pairs)
    linked_components = lines.linked_components
    for name, value in (("group_count", group_count), ("linked_components", linked), ("MOST_BROADCAST", 0), ("MOVED_PART", 1 << 50), ("GROUP_BYTES", 1 << 16)):
        monkeypatch.setattr(lines, name, value)
    assert sorted(str(tuple(r)) for r in lines.dedup_lines(docs, removed="gone").collect()) == wanted
    assert met[0] > 0


def test_entries_of_all_rounds_are_all_entries():
    both = [x.encode() for pair in changed_pairs("replaced", 15, 20) for x in (*pair, pair[0][:15], pair[0][:40])]
    size = np.array([len(x) for x in both])
    marks = lines.band_marks(np.frombuffer(b"".join(both), np.uint8), np.cumsum(size) - size, size, 90)
    whole = sorted(zip(*(x.tolist() for x in lines.band_entries(marks)), strict=True))
    parts = [list(zip(*(x.tolist() for x in lines.band_entries(marks, step, 5)), strict=True)) for step in range(5)]
    assert sorted(x for p in parts for x in p) == whole
    assert max(len(p) for p in parts) < 0.3 * len(whole)


def test_checkpoint_leaves_no_shuffle_files(spark):
    from frameflow.runtime import checkpoint
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return sum("shuffle_" in x for x in manager.getAllFiles().mkString("\n").split("\n"))
    before = files()
    kept = checkpoint(spark.range(20_000).groupBy((F.col("id") % 5_000).alias("k")).count())
    for _ in range(100):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before
    assert kept.count() == 5_000 and kept.where("count <> 4").count() == 0


def test_blocks_catch_few_differing_bits():
    rng = np.random.default_rng(4)
    bits = rng.integers(0, 256, (200, lines.WIDTH // 8), dtype=np.uint8)
    flipped = np.unpackbits(bits, axis=1)
    for row in flipped:
        row[rng.choice(lines.WIDTH, lines.BLOCKS - 1, replace=False)] ^= 1
    a, _ = lines.block_values(bits, 20)
    b, _ = lines.block_values(np.packbits(flipped, axis=1), 20)
    assert (a == b).any(axis=1).all()


def random_line(rng, words: int) -> list[str]:
    return ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 9))) for _ in range(words)]


def changed_pairs(kind: str, words: int, n: int = 200) -> list[tuple[str, str]]:
    """Pairs of lines at 90 % edit similarity or more, with one word replaced or mistyped."""
    rng, out = np.random.default_rng(7), []
    while len(out) < n:
        a = random_line(rng, words)
        b = list(a)
        k = rng.integers(words)
        b[k] = random_line(rng, 1)[0] if kind == "replaced" else b[k][:1] + "#" + b[k][2:]
        if a != b and alike(" ".join(a), " ".join(b)):
            out.append((" ".join(a), " ".join(b)))
    return out


@pytest.mark.parametrize("kind", ["replaced", "mistyped"])
@pytest.mark.parametrize("words", [4, 10, 15, 20, 60])
def test_lines_with_a_changed_word_share_an_entry(kind, words):
    both = [x.encode() for pair in changed_pairs(kind, words) for x in pair]
    size = np.array([len(x) for x in both])
    line, key, bits = lines.band_values(np.frombuffer(b"".join(both), np.uint8), np.cumsum(size) - size, size, 90)
    held = [dict() for _ in both]
    for i, k, b in zip(line.tolist(), key.tolist(), bits.tolist(), strict=True):
        held[i][k] = b
    met = 0
    for a, b in zip(held[::2], held[1::2], strict=True):
        shared = [k for k in a if k in b]
        x, y = (np.array([h[k] for k in shared], np.uint64) for h in (a, b))
        met += bool(lines.close(np.full(len(shared), lines.BAND), x, y, 90).any())
    assert met >= 0.985 * len(held[::2])


def test_single_edits_of_short_lines_always_share_a_half():
    rng = np.random.default_rng(3)
    for size in range(10, 20):
        for _ in range(40):
            a = "".join(rng.choice(list("abcdé "), size))
            k = int(rng.integers(size))
            for b in (a[:k] + "x" + a[k + 1:], a[:k] + a[k + 1:]):
                both = [a.encode(), b.encode()]
                n = np.array([len(x) for x in both])
                line, key, _ = lines.band_values(np.frombuffer(b"".join(both), np.uint8), np.cumsum(n) - n, n, 90)
                assert set(key[line == 0].tolist()) & set(key[line == 1].tolist()), (a, b)


def test_lines_14_of_64_bits_apart_are_compared():
    x = np.zeros(3, np.uint64)
    y = np.array([(1 << 11) - 1, (1 << 14) - 1, (1 << 15) - 1], np.uint64)
    assert lines.close(np.full(3, lines.BLOCK), x, y, 90).tolist() == [True, True, False]


def test_long_lines_are_measured_in_characters(spark):
    rng = random.Random(2)

    def words(n, size):
        return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=size)) for _ in range(n)]
    base, other = words(100, 5), words(100, 5)
    typos = list(base)
    for k in range(0, 99, 9):
        typos[k] = "é" + typos[k][1:]  # 11 of 100 words, 98 % alike
    wide, wider = words(10, 9), words(10, 9)  # ten of 100 words, over 10 % of the characters
    rows = [(1, " ".join(base)), (2, " ".join(typos)), (3, " ".join(other[:90] + wide)), (4, " ".join(other[:90] + wider))]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(corpus.frame(spark, rows)).collect()}
    assert got[1] and not got[2]
    assert got[3] and got[4]


def test_counted_grams_refuse_no_near_pair():
    rng = random.Random(4)
    for _ in range(50):
        a = rng.choices("abcdé ", k=rng.randint(1, 400))
        b, edits = list(a), rng.randint(0, 40)
        for _ in range(edits):
            k = rng.randrange(len(b) + 1)
            b[k:k + rng.randint(0, 1)] = rng.choices("xyz", k=rng.randint(0, 1))
        assert lines.may_be_near("".join(a), "".join(b), edits)
    assert not lines.may_be_near("".join(rng.choices("abcdefgh", k=900)), "".join(rng.choices("abcdefgh", k=900)), 90)


def test_lines_of_few_words_are_kept_once(spark):
    text = "これは改行のない長い文章でありその写しは一度だけ残るべきです"
    rows = [(1, f"Contents\n{text}\ntwo words"), (2, f"contents!\n{text}\nTwo words"), (3, text.replace("長", "短")), (4, "!!!\n\n!!!"),
            (5, "今日は晴れですから散歩に行きます"), (6, "今日は雨ですから家で本を読みます"), (7, "今日は晴れですから散歩に行きまし")]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(corpus.frame(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "", 3: "", 4: rows[3][1], 5: rows[4][1], 6: rows[5][1], 7: ""}


def test_trimmed_texts_lose_what_they_share():
    assert lines.trimmed("abcdef", "abXdef") == ("c", "X")
    assert lines.trimmed("aaaa", "aa") == ("aa", "") and lines.trimmed("", "é") == ("", "é")
    assert lines.trimmed("same", "same") == ("", "") and lines.trimmed("éab", "xab") == ("é", "x")


def test_links_are_those_of_all_pairs_on_given_texts(spark):
    rows = corpus.given()
    docs = corpus.frame(spark, rows)
    every = docs.select(F.explode(F.split("text", "\n")).alias("raw")).select(lines.normal_text(F.col("raw")).alias("x"))
    every = every.where(F.size(F.split("x", " ")) >= lines.LEAST_WORDS).distinct().cache()
    a, b = every.select(F.col("x").alias("a"), F.length("x").alias("n")), every.select(F.col("x").alias("b"), F.length("x").alias("m"))
    most = F.greatest("n", "m").cast("int")
    pairs = a.join(b, (F.col("a") < F.col("b")) & (F.abs(F.col("n") - F.col("m")) * 10 <= F.greatest("n", "m")))
    near = [tuple(r) for r in pairs.withColumn("most", F.floor(most / 10).cast("int")).where("levenshtein(a, b, most) >= 0").select("a", "b").collect()]
    assert near
    kept: Counter = Counter()
    for r in lines.dedup_lines(docs).collect():
        kept.update(normal(x) for x in (r["text"] or "").split("\n"))
    # of two lines that are alike one at least went
    assert not [p for p in near if all(kept[x] for x in p)]


def normal(line: str) -> str:
    plain = "".join("0" if c in "0123456789" else c for c in corpus.lower(line) if c not in lines.PUNCTUATION)
    return " ".join(corpus.WORD.findall(plain))


def test_line_numbers_and_hashes():
    import pyarrow as pa
    found = lines.line_table(texts_of(pa.array(["a b c\n\nA, b-c!\nx", None, "", "a  b c"])))
    assert found["text"].tolist() == [0, 0, 3][:len(found["text"])] or found["line"].tolist()[0] == 0
    assert found["hash"][0] == found["hash"][-1]


def test_judging_takes_portions_and_drops_encoders(monkeypatch):
    """A batch is judged in parts, and the words that an encoder kept go first."""
    monkeypatch.setattr(quality, "AT_ONCE", 3)
    worker.kept("byte_encoder test", dict)
    batch = pa.RecordBatch.from_pydict({"text": [str(i) for i in range(8)]})
    assert [p["text"].to_pylist() for p in quality.portions(iter([batch]))] == [["0", "1", "2"], ["3", "4", "5"], ["6", "7"]]
    made = []
    worker.kept("byte_encoder test", lambda: made.append(1))
    assert made == [1]


def test_grams_of_lines_take_bounded_memory():
    """Grams of many lines are looked at in parts, with the same values."""
    rnd = np.random.default_rng(5)
    size = rnd.integers(60, 400, 9000)
    data = rnd.integers(97, 123, int(size.sum()), dtype=np.uint8)
    start = np.cumsum(size) - size
    tracemalloc.start()
    least, places = lines.least_grams(data, start, size, lines.LONG_GRAM)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * len(start) * lines.MINIMA * 4 and least.shape == (9000, lines.MINIMA)
    for i in (0, 1, 4321, 8999):
        one = lines.least_grams(data[start[i]:start[i] + size[i]], np.zeros(1, np.int64), size[i:i + 1], lines.LONG_GRAM)
        assert (one[0][0] == least[i]).all() and (one[1][0] == places[i]).all()

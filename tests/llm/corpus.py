"""Small documents with all that can go wrong, and brute-force versions of the operators."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
from conftest import SF_DIR

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, _g int, id string, n_words string"


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def odd_texts(seed: int = 0) -> list[tuple[int | None, str | None]]:
    """(doc_id, text): nulls, empties, copies, near copies, long and short texts, ties."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgéñ", k=rng.randint(1, 7))) for _ in range(400)]

    def prose(n: int) -> str:
        return " ".join(rng.choice(vocabulary).capitalize() if rng.random() < 0.1 else rng.choice(vocabulary) for _ in range(n))
    base = prose(120)
    words = base.split(" ")
    near = []
    for i in range(12):
        changed = list(words)
        changed[7 * i + 3] = f"new{i}"
        near.append(" ".join(changed))
    passage = prose(60)
    texts = [None, "", " \n\t ", "one", "One", "a b c d", "A  b\tc D", base, base, base.upper().lower(), *near,
             prose(30) + " " + passage + " " + prose(25), passage, prose(10) + "\n" + passage + "\n" + prose(10),
             "In. " * 400, "x" * 5000, "x" * 5000 + " tail", prose(6000), "same line here ok\nsame line here ok\nother line here too",
             "Same line, here ok\n\nlast line of all", "a  b   c \n d\r\n e  ", "tab\tand\x0bvt\x0cff", "nbsp here  wide  x", *[prose(40) for _ in range(12)]]
    for size in (1, 2, 4, 5, 6, 9, 12, 20, 24):
        short = prose(size)
        texts += [short, short + " more", short.upper()]
    rows: list[tuple[int | None, str | None]] = [(100 * i + 7 if i % 3 else i, t) for i, t in enumerate(texts)]
    return rows


def frame(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, None, f"s{(i or 0) % 3}", len(t or ""), "k", 1, "id", "w") for i, t in rows], SCHEMA)


def given(n: int | None = None) -> list[tuple[int, str]]:
    rows = pq.read_table(f"{SF_DIR}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return [(r["doc_id"], r["text"]) for r in rows][:n]


def jaccard_components(rows) -> dict[int, tuple[int, int]]:
    sets, parent = {}, {}
    for i, text in rows:
        words = WORD.findall(lower(text or ""))
        sets[i] = frozenset(tuple(words[j:j + 5]) for j in range(len(words) - 4)) if len(words) > 4 else frozenset([tuple(words)] if words else [])
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    lists = defaultdict(list)
    for i in sorted(sets):
        common = Counter(j for s in sets[i] for j in lists[s])
        for s in sets[i]:
            lists[s].append(i)
        for j, k in common.items():
            if 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def windows_removed(rows, k: int = 13) -> dict[int, tuple[int, int, str]]:
    first: dict[tuple, int] = {}
    for i, text in sorted(rows):
        words = WORD.findall(text or "")
        for j in range(len(words) - k + 1):
            first.setdefault(tuple(words[j:j + k]), i)
    out = {}
    for i, text in rows:
        words = WORD.findall(text or "")
        gone = set()
        for j in range(len(words) - k + 1):
            if first[tuple(words[j:j + k])] < i:
                gone.update(range(j, j + k))
        out[i] = (len(words), len(gone), " ".join(w for j, w in enumerate(words) if j not in gone))
    return out


def bytes_removed(rows, length: int = 200) -> list[tuple[int | None, int, int, int, bytes]]:
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[j:j + length] for _, b in raw for j in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if seen[b[j:j + length]] > 1:
                gone[j:j + length] = b"\1" * length
        spans = sum(1 for j, g in enumerate(gone) if g and not (j and gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def held_out(key) -> bool:
    return zlib.crc32(("" if key is None else str(key)).encode()) % 10 == 0

"""N-gram Jaccard join: fixed-size subsets for small sets, inverted lists for large ones."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import checkpoint
from .groups import cuts, group_count, group_of, pack_ints, slices, text_bytes, unpack_ints
from .links import linked_components
from .sketch import corpus_sketch, merged_counts, width_bits
from .words import U64, Texts, mix, pieces, split_words, texts_of, window_hashes, window_starts, word_hashes

SHINGLE, PERCENT = 5, 80
#: Largest size that the boundary between small and large sets may have; a document of
#: more bytes than this a word is taken for large when the boundary is chosen.
MOST_LIGHT, SHORT_BYTES = 24, 32
#: 64-bit words of a set's parity map; two sets differ in at least as many elements as
#: their maps in bits.
MAP_WORDS = 4
ONE_ROW = 1  # rows of the sketch; it has the wider counters instead


def overlap(x: int, y: int, percent: int = PERCENT) -> int:
    """Least common elements of two linked sets of these sizes."""
    return -(-percent * (x + y) // (100 + percent))


def partner_sizes(x: int, percent: int = PERCENT) -> range:
    return range(-(-percent * x // 100), 100 * x // percent + 1)


def subset_sizes(x: int, percent: int = PERCENT) -> dict[int, int]:
    """Partner size -> size of the subsets that both share if they are linked."""
    return {y: overlap(x, y, percent) for y in partner_sizes(x, percent) if overlap(x, y, percent) <= min(x, y)}


def subset_cost(x: int, percent: int = PERCENT, most: int = MOST_LIGHT) -> int:
    return sum(math.comb(x, c) for y, c in subset_sizes(x, percent).items() if y <= most)


def scan_cost(x: int, percent: int = PERCENT) -> int:
    return x - -(-percent * x // 100) + 1


def boundary(sizes: dict[int, int], copies: float, percent: int = PERCENT) -> int:
    """The size up to which sets are small: the least total of subsets enumerated and of
    list entries posted and scanned, a list holding 1 + `copies` entries on average."""
    def total(light: int) -> float:
        few = sum(n * subset_cost(s, percent, light) for s, n in sizes.items() if s <= light)
        # small sets near the boundary stand in lists as well, for their larger partners
        return few + sum(n * scan_cost(s, percent) * (1 + copies) for s, n in sizes.items() if s * 100 >= percent * (light + 1))
    return min(range(MOST_LIGHT + 1), key=lambda x: (total(x), x))


def shingles(texts: Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of all k-word windows with A-Z in lower case; a text with fewer words
    has its whole sequence as one."""
    hashes, owners = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for first, part in pieces(texts):
        words = split_words(part)
        h, n = word_hashes(part, words, lower=True), words.counts()
        at = window_starts(words, k)
        hashes.append(window_hashes(h, at, k))
        owners.append(np.repeat(np.arange(len(n)), np.maximum(n - k + 1, 0)) + first)
        for m in range(1, k):
            few = np.flatnonzero(n == m)
            hashes.append(window_hashes(h, words.first[few], m) ^ mix(np.full(1, m, U64)))
            owners.append(few + first)
    return np.concatenate(hashes), np.concatenate(owners)


def distinct_sets(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of each distinct element, first index per text), texts in order."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    kept = order[new]
    return kept, np.searchsorted(o[new], np.arange(n + 1))


def set_ids(elements: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64 bits of a digest of each set's sorted elements."""
    view = memoryview(np.ascontiguousarray(elements, "<u8")).cast("B")
    found = [hashlib.blake2b(view[8 * a:8 * b], digest_size=8).digest() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    return np.frombuffer(b"".join(found), "<i8").astype(np.int64)


def parity_maps(elements: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each set (elements[first[i]:first[i + 1]], none empty) a map of MAP_WORDS words:
    bit b says whether an odd number of its elements fall on b."""
    spread = mix(elements ^ U64(0x7FEB352D))
    word, bit = spread >> U64(58) & U64(MAP_WORDS - 1), U64(1) << (spread & U64(63))
    out = np.zeros((len(first) - 1, MAP_WORDS), U64)
    for w in range(MAP_WORDS if len(out) else 0):
        out[:, w] = np.bitwise_xor.reduceat(np.where(word == U64(w), bit, U64(0)), first[:-1])
    return out


def light_keys(elements: np.ndarray, light: int, percent: int) -> np.ndarray:
    """A key for every subset of the elements that a linked small set would share."""
    x = len(elements)
    # an order-free hash of a subset; the two sizes are part of the key
    scrambled = mix(elements ^ U64(0x2545F4914F6CDD1D))
    out = []
    for y, c in subset_sizes(x, percent).items():
        if y > light:
            continue
        sizes = mix(np.full(1, (min(x, y) << 20) + max(x, y) + (1 << 50), U64))[0]
        picks = np.array(list(combinations(range(x), c)))
        out.append(mix(scrambled[picks].sum(axis=1, dtype=U64) + sizes))
    return np.concatenate(out) if out else np.zeros(0, U64)


def member_keys(keys: np.ndarray, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A key for each entry of lists sorted by key: equal for lists of the same members. The
    last bit tells lists of subsets from those of elements."""
    if not len(keys):
        return keys
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    subset = places < 0
    members = np.add.reduceat(mix(mix(ids.view(U64)) + subset.astype(U64)), first)
    named = (mix(members) & ~U64(1)) | np.logical_or.reduceat(subset, first).astype(U64)
    return np.repeat(named, np.diff(np.append(first, len(keys)))).view(np.int64)


def jaccard_groups(documents: DataFrame, key: str = "doc_id", text: str = "text", *, k: int = SHINGLE,
                   percent: int = PERCENT) -> DataFrame:
    """key, n_shingles and component_id of every row.

    Words are runs of other bytes than 0x20 and 0x09-0x0D, A-Z in lower case; a
    document's set are its distinct k-word shingles, the whole sequence if it has fewer
    words, and empty without words. Two documents are linked when 100 * common >=
    percent * united elements; component_id is the smallest key that links lead to, its
    own included. Null, empty and blank texts are linked with nothing. Rows with a null
    key are grouped like others and lend no name (a component of such rows alone is
    null). Rows that share a key are judged each. Other columns are ignored.

    Equal sets are one class, known by 64 bits of a digest of their elements. A merged sketch
    gives every shingle a count that is never too small: a set with less than `percent`
    shingles counted twice has no partner, and lists are ordered by it, rarest first.
    Small sets meet by equal subsets of the size that a link needs, for each pair of
    sizes. Large sets, and small ones near the boundary, stand in the inverted lists of
    so many of their rarest shingles that linked sets share one, and are compared by
    size and place before a test on the whole sets.
    """
    total = text_bytes(documents, text)
    n_groups = group_count(total)
    bits = width_bits(total // 6) + 2
    rows = documents.select(group_of(n_groups, F.col(key), F.col(text)).alias("_g"), F.col(key).cast("long").alias("key"),
                            F.col(text).cast("string").alias("text"))
    short = rows.where(F.octet_length("text") <= SHORT_BYTES * (MOST_LIGHT + k))
    counted = short.select(F.size(F.split(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), " ")).alias("n"), F.xxhash64("text").alias("t"))
    sizes = counted.groupBy(F.greatest(F.col("n") - (k - 1), F.lit(1)).alias("s")).agg(
        F.count(F.lit(1)).alias("n"), F.approx_count_distinct("t").alias("d")).where(F.col("s") <= 2 * MOST_LIGHT).collect()
    light = boundary({r["s"]: r["n"] for r in sizes}, max(sum(r["n"] for r in sizes) / max(sum(r["d"] for r in sizes), 1), 1.0), percent)

    replies = corpus_sketch(rows, lambda table: shingles(texts_of(table["text"]), k)[0], n_groups, bits, ONE_ROW)

    def post(group: tuple, table: pa.Table, reply: pa.Table) -> pa.Table:
        texts = texts_of(table["text"])
        n = len(texts)
        hashes, owner = shingles(texts, k)
        count = merged_counts(hashes, reply, bits, ONE_ROW)
        kept, first = distinct_sets(hashes, owner, n)
        hashes, owner, count = hashes[kept], owner[kept], count[kept]
        size = np.diff(first)
        ids = set_ids(hashes, first)
        often = np.concatenate([[0], np.cumsum(count > 1)])
        often = often[first[1:]] - often[first[:-1]]
        may = (size > 0) & (often * 100 >= percent * size)
        _, one = np.unique(ids, return_index=True)  # of equal sets in this group one is posted
        chosen = np.intersect1d(np.flatnonzero(may), one)
        take = np.zeros(n, bool)
        take[chosen] = True
        held = np.flatnonzero(take[owner])
        held = held[np.lexsort((hashes[held], count[held], owner[held]))]  # rarest first in each set
        own = owner[held]
        place = np.arange(len(held)) - np.searchsorted(own, own)
        heavy = (size > light) | (100 * size >= percent * (light + 1))
        prefix = size - -(-percent * size // 100) + 1
        listed = (place < prefix[own]) & heavy[own] & (count[held] > 1)
        post_key, post_own, post_place = [hashes[held][listed]], [own[listed]], [place[listed]]
        for doc in chosen[size[chosen] <= light].tolist():
            found = light_keys(hashes[first[doc]:first[doc + 1]], light, percent)
            post_key.append(found)
            post_own.append(np.full(len(found), doc))
            post_place.append(np.full(len(found), -1))
        post_key, post_own, post_place = (np.concatenate(x) for x in (post_key, post_own, post_place))
        where = slices(post_key, n_groups)
        order = np.argsort(where, kind="stable")
        post_key, post_own, post_place = post_key[order], post_own[order], post_place[order]
        edge = cuts(where[order], n_groups)
        out = defaultdict(list)

        def add(kind: int, **columns: bytes) -> None:
            out["_slice"].append(kind)
            for name in ("keys", "ids", "sizes", "places"):
                out[name].append(columns.get(name))
        for s in np.flatnonzero(np.diff(edge)):
            p = slice(edge[s], edge[s + 1])
            add(int(s), keys=pack_ints(post_key[p].view(np.int64)), ids=pack_ints(ids[post_own[p]]),
                sizes=pack_ints(size[post_own[p]]), places=pack_ints(post_place[p]))
        # the group's rows, and the whole sets of those that are posted
        add(-1, keys=pack_ints(np.asarray(table["key"].combine_chunks().fill_null(0), np.int64)), ids=pack_ints(ids), sizes=pack_ints(size),
            places=np.packbits(np.asarray(table["key"].combine_chunks().is_null())).tobytes())
        whole = take[owner]
        maps = parity_maps(hashes[whole], np.concatenate([[0], np.cumsum(size[chosen])]))
        for doc, bits_of in zip(chosen.tolist(), maps, strict=True):
            add(-2, keys=hashes[first[doc]:first[doc + 1]].tobytes(), ids=pack_ints(ids[doc:doc + 1]), sizes=bits_of.tobytes())
        return pa.table({"_slice": pa.array(out["_slice"], pa.int32()),
                         **{c: pa.array(out[c], pa.binary()) for c in ("keys", "ids", "sizes", "places")}})

    posted = checkpoint(rows.groupBy("_g").cogroup(replies.groupBy("_g")).applyInArrow(
        post, "_slice int, keys binary, ids binary, sizes binary, places binary"))

    def lists(table: pa.Table) -> pa.Table:
        """Entries of the lists that hold two classes or more, a list being named by its members."""
        keys, ids, size, place = (np.concatenate([unpack_ints(x) for x in table[c].to_pylist()]) for c in ("keys", "ids", "sizes", "places"))
        order = np.lexsort((ids, keys))
        keys, ids, size, place = keys[order], ids[order], size[order], place[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
        keys, ids, size, place = keys[new], ids[new], size[new], place[new]
        _, inverse, many = np.unique(keys, return_inverse=True, return_counts=True)
        keep = many[inverse] > 1
        return pa.table({"key": member_keys(keys[keep], ids[keep], place[keep]), "id": ids[keep], "size": size[keep], "place": place[keep]})

    def unpack_rows(batches):
        for batch in batches:
            for keys, ids, size, null in zip(*(batch[c].to_pylist() for c in ("keys", "ids", "sizes", "places")), strict=True):
                keys = unpack_ints(keys)
                none = np.unpackbits(np.frombuffer(null, np.uint8), count=len(keys)).view(bool)
                yield pa.RecordBatch.from_arrays([pa.array(keys, mask=none), pa.array(unpack_ints(ids)), pa.array(unpack_ints(size))],
                                                 ["key", "id", "n_shingles"])

    def unpack_sets(batches):
        for batch in batches:
            elements = [np.frombuffer(x, np.int64) for x in batch["keys"].to_pylist()]
            ids = [unpack_ints(x)[0] for x in batch["ids"].to_pylist()]
            ends = np.cumsum([0, *map(len, elements)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int64), *elements])
            maps = np.frombuffer(b"".join(batch["sizes"].to_pylist()), np.int64).reshape(-1, MAP_WORDS)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(flat)),
                                              *(pa.array(np.ascontiguousarray(m)) for m in maps.T)], ["id", "elements", *map_names])
    map_names = [f"map{w}" for w in range(MAP_WORDS)]
    classes = posted.where("_slice = -1").select("keys", "ids", "sizes", "places").mapInArrow(
        unpack_rows, "key long, id long, n_shingles long")
    sets = (posted.where("_slice = -2").select("keys", "ids", "sizes").mapInArrow(
        unpack_sets, "id long, elements array<long>, " + ", ".join(f"{m} long" for m in map_names)))
    maps = sets.drop("elements").dropDuplicates(["id"])
    postings = posted.where("_slice >= 0").groupBy("_slice").applyInArrow(lists, "key long, id long, size long, place long")
    # lists of the same members are one, each member at its least place, which allows all that any of them does
    postings = postings.groupBy("key", "id", "size").agg(F.min("place").alias("place"))
    postings = checkpoint(postings.join(maps, "id"))
    # only sets of classes that share a list are ever tested
    sets = checkpoint(sets.select("id", "elements").join(postings.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"]))

    def may_link(x, y):
        """Equal subsets are worth a test; so are list entries that fit by size and place."""
        small, large = F.least(x("size"), y("size")), F.greatest(x("size"), y("size"))
        need = F.ceil(F.lit(percent) * (x("size") + y("size")) / (100 + percent))
        left = F.least(x("size") - x("place"), y("size") - y("place"))
        apart = sum((F.bit_count(x(m).bitwiseXOR(y(m))) for m in map_names[1:]), F.bit_count(x(map_names[0]).bitwiseXOR(y(map_names[0]))))
        return (apart <= x("size") + y("size") - 2 * need) & (((x("place") < 0) & (y("place") < 0)) | (
            (x("place") >= 0) & (y("place") >= 0) & (100 * small >= percent * large) & (left >= need)))

    def verify(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("id").alias("a"), F.col("elements").alias("a_set"))
        b = sets.select(F.col("id").alias("b"), F.col("elements").alias("b_set"))
        both = pairs.join(a, "a").join(b, "b")
        common = F.size(F.array_intersect("a_set", "b_set"))
        return both.where(100 * common >= percent * (F.size("a_set") + F.size("b_set") - common)).select("a", "b")
    components = linked_components(postings, may_link, verify)
    first = classes.where("n_shingles > 0").groupBy("id").agg(F.min("key").alias("least"))
    if components is None:
        joined = first.withColumn("component", F.col("id"))
    else:
        joined = first.join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))
    names = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = joined.join(names, "component").select("id", "component_id")
    out = classes.join(named, "id", "left").withColumn(
        "component_id", F.when(F.col("n_shingles") == 0, F.col("key")).otherwise(F.col("component_id")))
    return out.select(F.col("key").alias(key), "n_shingles", "component_id")

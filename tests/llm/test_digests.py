"""Exact dedup: odd rows against brute force, arrivals one after the other, the plan."""

import hashlib
import re
from collections import defaultdict

import pytest
from corpus import frame, odd_texts

from frameflow.llm import digests

COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def normal(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", text or "").encode()).hexdigest()


def by_hand(rows):
    groups = defaultdict(list)
    for i, (key, text) in enumerate(rows):
        groups[normal(text)].append((-len(text or ""), key is None, key or 0, i))
    out = []
    for i, (key, text) in enumerate(rows):
        same = groups[normal(text)]
        least = min(same)
        out.append((key, rows[least[3]][0], len(same), least[3] == i, normal(text)))
    return out


def shape(rows):
    """Rows as comparable tuples; among rows alike in all of it any one may be kept."""
    return sorted((str(k), str(keep), n, str(kept), d) for k, keep, n, kept, d in rows)


@pytest.mark.parametrize("arrivals", [1, 2, 5])
def test_equals_brute_force(spark, arrivals):
    rows = odd_texts() + [(5, "a b"), (4, "ab "), (4, "ab "), (None, "a  b"), (None, "a  b"), (3, "naïve 𝒳"), (2, "naïve𝒳  "), (9, " ")]
    found = [tuple(r) for r in digests.dedup(frame(spark, rows), arrivals=arrivals).select(*COLUMNS).collect()]
    assert shape(found) == shape(by_hand(rows))


def test_empty_table_and_string_keys(spark):
    assert digests.dedup(frame(spark, []).limit(0)).count() == 0
    rows = spark.createDataFrame([("b", "x y"), ("a", "xy "), ("c", "z")], "doc_id string, text string")
    assert sorted(tuple(r)[:4] for r in digests.dedup(rows).collect()) == [("a", "a", 2, True), ("b", "a", 2, False), ("c", "c", 1, True)]


def test_arrivals_meet_a_reopened_index(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    first = spark.createDataFrame([(1, "one"), (2, "two"), (3, "o n e")], "doc_id long, text string")
    rows = digests.rows_of(first, "doc_id", "text")
    index = digests.DigestIndex(spark, path, buckets=3)
    index.add(rows)
    index.drop()
    index = digests.DigestIndex(spark, path, buckets=3)
    later = digests.rows_of(spark.createDataFrame([(4, "t w o and more"), (5, "t  w  o"), (6, "six")], "doc_id long, text string"), "doc_id", "text")
    index.add(later)
    said = {r["digest"].hex(): (r["keeper"], r["group_size"]) for r in index.groups().collect()}
    assert said[normal("one")] == (3, 2) and said[normal("two")] == (2, 2)  # what came first stays
    assert said[normal("six")] == (6, 1) and len(said) == 4


def test_the_index_is_not_shuffled(spark, tmp_path):
    index = digests.DigestIndex(spark, f"file://{tmp_path}/index", buckets=4)
    index.add(digests.rows_of(spark.createDataFrame([(1, "one")], "doc_id long, text string"), "doc_id", "text"))
    new = spark.range(100).selectExpr("unhex(sha2(cast(id as string), 256)) as digest")
    plan = new.join(index.table().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1
    assert index.groups()._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0
    index.drop()

"""Files, measurements, sidecars, merge, calibration, progress."""

import base64
import json
import struct
from xml.etree import ElementTree

import compare
import duckdb
import pytest
from pyspark.sql import functions as F

from frameflow import params as P
from frameflow.operators import agreement, calibration, ingest, lookups, progress
from frameflow.plans import tables  # noqa: F401
from frameflow.plans.registry import ORACLES, QUERIES
from frameflow.sources import listing, measurements, sidecars, sinks


def touch(folder, name, data=b"x"):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def test_listing_from_disk(spark, tmp_path):
    for name in ("s1/A.CR3", "s1/A.jpg", "s1/A.xmp", "s1/B.JPG", "s1/notes.txt", "s2/A.nef", "s2/lone.xmp", ".hid/C.cr3",
                 "s1/@eaDir/D.cr3", "x_previews.lrdata/E.jpg", "cat.lrcat-data/F.jpg", "s1/.G.jpg"):
        touch(tmp_path, name)
    files = listing.scan_files(listing.read_listing(spark, str(tmp_path)))
    assert {r.rel_path for r in files.collect()} == {"s1/A.CR3", "s1/A.jpg", "s1/A.xmp", "s1/B.JPG", "s2/A.nef", "s2/lone.xmp"}
    pairs = {r.primary_path: (r.rendered_path, r.sidecar_path) for r in listing.pair_captures(files).collect()}
    assert pairs == {"s1/A.CR3": ("s1/A.jpg", "s1/A.xmp"), "s1/B.JPG": (None, None), "s2/A.nef": (None, None)}


def test_content_id(spark):
    k = 64 * 1024
    same_ends = [b"a" * k + m + b"z" * k for m in (b"1" * 10, b"2" * 10)]
    cases = [b"short", b"a" * k, b"a" * k + b"b", *same_ends, b"a" * k + b"1" * 11 + b"z" * k]
    df = spark.createDataFrame([(i, bytearray(c), len(c)) for i, c in enumerate(cases)], "i int, c binary, n int")
    ids = [r[0] for r in df.orderBy("i").select(listing.content_id(F.col("c"), F.col("n"))).collect()]
    assert ids[3] == ids[4] and len(set(ids)) == 5


def test_collision(spark):
    rows = spark.createDataFrame([("c", 1, "h1"), ("c", 1, "h2"), ("d", 2, "h3"), ("d", 2, "h3")],
                                 "content_id string, size long, full_hash string")
    got = sorted(r.identity for r in ingest.escalate_collisions(rows).collect())
    assert got == ["d", "d", "h1", "h2"]


KNOWN = "photo_id long, rel_path string, size long, mtime double, content_id string, missing boolean"
LISTED = "rel_path string, size long, mtime double, content_id string"


def classify(spark, known, listed):
    got = ingest.classify_listing(spark.createDataFrame(known, KNOWN), spark.createDataFrame(listed, LISTED))
    return {(r["class"], r.rel_path, r.photo_id) for r in got.collect()}


def test_merge_classes(spark):
    known = [(1, "a", 1, 1.0, "A", False), (2, "b", 1, 1.0, "B", False), (3, "c", 1, 1.0, "C", False),
             (4, "d", 1, 1.0, "D", True), (5, "e", 1, 1.0, "E", False), (6, "f", 1, 1.0, "F", False)]
    listed = [("a", 1, 1.0, "A"), ("b2", 1, 2.0, "B"), ("c", 2, 2.0, "C2"), ("d", 1, 1.0, "D"), ("copy", 1, 5.0, "A"),
              ("n1", 9, 9.0, "N"), ("n2", 9, 9.0, "N"), ("f", 1, 7.0, "F")]
    assert classify(spark, known, listed) == {
        ("unchanged", "a", 1), ("moved", "b2", 2), ("modified", "c", 3), ("reappeared", "d", 4), ("missing", "e", 5),
        ("duplicate", "copy", None), ("added", "n1", None), ("duplicate", "n2", None), ("modified", "f", 6)}


def test_merge_known_path_takes_known_bytes(spark):
    known = [(1, "a", 1, 1.0, "A", False), (2, "b", 1, 1.0, "B", False)]
    assert classify(spark, known, [("b", 1, 3.0, "A")]) == {("moved", "b", 1), ("missing", "b", 2)}
    assert classify(spark, known, [("a", 1, 1.0, "A"), ("b", 1, 3.0, "A")]) == {
        ("unchanged", "a", 1), ("duplicate", "b", None), ("missing", "b", 2)}


def test_merge_is_idempotent(spark):
    listed = [("a", 1, 1.0, "A"), ("b", 2, 2.0, "B")]
    first = ingest.classify_listing(spark.createDataFrame([], KNOWN), spark.createDataFrame(listed, LISTED))
    snapshot = ingest.next_snapshot(first, F.lit(0).cast("long"))
    again = ingest.classify_listing(snapshot, spark.createDataFrame(listed, LISTED))
    assert {r["class"] for r in again.collect()} == {"unchanged"}


def measurement(path, **extra):
    eye = {"sharp_norm": .5, "open": .9}
    vec = base64.b64encode(struct.pack("<3f", 1, 2, 3)).decode()
    return {"path": path, "engine_version": "v1", "decode_mode": "raw", "frame": {"sharpness_max": .1},
            "faces": [{"idx": 0, "bbox": [.1, .2, .3, .4], "eyes": {"l": eye, "r": {}}}], "embedding": vec,
            "embedding_dim": 3, **extra}


def test_measurements(spark, tmp_path):
    lines = [json.dumps(measurement("a")), json.dumps({"path": "b", "error": "corrupt"}), '{"path": "c"', json.dumps(measurement("d", faces=[]))]
    (tmp_path / "m.jsonl").write_text("\n".join(lines))  # no newline at the end
    good, bad = measurements.split_errors(measurements.read_measurements(spark, str(tmp_path)).cache())
    assert {r.path for r in measurements.analysis_rows(good).collect()} == {"a", "d"}
    assert {r.error for r in bad.collect()} == {"corrupt", "unreadable record"}
    face = measurements.face_rows(good).collect()
    assert len(face) == 1 and face[0].open_l == .9 and face[0].open_r is None and face[0].eye_source == "unknown"
    assert face[0].bbox.w == .3
    assert {tuple(r.vec) for r in measurements.embedding_rows(good).collect()} == {(1, 2, 3)}


def test_last_label_wins(spark):
    rows = spark.createDataFrame([("k", 1, "open"), ("k", 3, "closed"), ("j", 2, "open")], "crop string, line int, label string")
    got = {(r.crop, r.label) for r in measurements.latest_per_key(rows, ["crop"], ["line"]).collect()}
    assert got == {("k", "closed"), ("j", "open")}


def test_replace_only_named_shoots(spark, tmp_path):
    out = str(tmp_path / "t")
    sinks.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "shoot_id long, v string"), out)
    sinks.replace_partitions(spark.createDataFrame([(2, "c")], "shoot_id long, v string"), out)
    assert {(r.shoot_id, r.v) for r in spark.read.parquet(out).collect()} == {(1, "a"), (2, "c")}


def test_export_list(spark, tmp_path):
    entries = spark.createDataFrame([("p1", "pick"), ("p2", "alt"), ("p3", "reject")], "file string, state string")
    sinks.write_export_list(entries, "file", str(tmp_path / "o"))
    got = spark.read.option("header", True).csv(str(tmp_path / "o"))
    assert got.columns == ["path", "state"] and {r.path for r in got.collect()} == {"p1", "p2"}


# --- sidecars ----------------------------------------------------------------------------

FULL = """<x:xmpmeta><rdf:Description rdf:about="" xmp:Rating="1" crs:Exposure2012="+0.5" my:thing="k $1 \\1">
 <dc:subject>a\u00e9</dc:subject></rdf:Description></x:xmpmeta>"""
PLAIN = '<rdf:Description rdf:about="" xmp:Rating="5" xmp:Label="Pick">\n</rdf:Description>'


def test_sidecar_state(spark):
    df = spark.createDataFrame([(FULL,), (PLAIN,), ("<a/>",)], "t string")
    got = [tuple(r) for r in df.select(*sidecars.sidecar_state(F.col("t")).values()).collect()]
    assert got == [(1, None, True), (5, "Pick", False), (None, None, False)]


def test_plan(spark):
    entries = spark.createDataFrame([("/p/a.cr3", "pick"), ("/p/b.cr3", "pick"), ("/p/c.DNG", "pick"), ("/p/d.cr3", "alt"),
                                     ("/p/e.cr3", "reject"), ("/p/f.cr3", "alt"), ("/p.q/noext", "alt")], "path string, state string")
    texts = spark.createDataFrame([("/p/a.xmp", FULL), ("/p/b.xmp", PLAIN), ("/p/f.xmp", '<x xmp:Rating="2">')],
                                  "sidecar_path string, text string")
    plan = sidecars.plan_export(entries, texts)
    assert {r.path: r.action for r in plan.collect()} == {
        "/p/a.cr3": "conflict", "/p/b.cr3": "update", "/p/c.DNG": "skipped_dng", "/p/d.cr3": "new",
        "/p/f.cr3": "unchanged", "/p.q/noext": "new"}
    assert sidecars.writable(plan).count() == 3 and sidecars.writable(plan, True).count() == 4


def test_rewrite_keeps_everything_else(spark):
    df = spark.createDataFrame([(FULL,), (PLAIN,), (sidecars.empty_sidecar(),), ("<a/>",)], "t string")
    got = [r[0] for r in df.select(sidecars.rewrite_sidecar(F.col("t"), F.lit(3), F.lit("Pick"))).collect()]
    assert got[0] == FULL.replace('xmp:Rating="1"', 'xmp:Rating="3"').replace(
        'my:thing="k $1 \\1">', 'my:thing="k $1 \\1"\n    xmp:Label="Pick">')
    assert got[1] == PLAIN.replace('"5"', '"3"')
    assert 'xmp:Rating="3"\n    xmp:Label="Pick"/>' in got[2] and got[3] is None
    odd = df.select(sidecars.rewrite_sidecar(F.col("t"), F.lit(3), F.lit('A "b" & <c'))).collect()[2][0]
    tag = ElementTree.fromstring(odd).find(".//{*}Description")
    assert tag.get("{http://ns.adobe.com/xap/1.0/}Label") == 'A "b" & <c'
    alt = df.select(sidecars.rewrite_sidecar(F.col("t"), F.lit(2), F.lit(None).cast("string"))).collect()
    assert 'xmp:Label="Pick"' in alt[1][0]


# --- calibration ---------------------------------------------------------------------------

def scored(spark, open_scores, closed_scores):
    rows = [(s, True) for s in open_scores] + [(s, False) for s in closed_scores]
    return spark.createDataFrame(rows, "s double, o boolean")


def test_evaluate(spark):
    r = calibration.evaluate(scored(spark, [.3, .9], [.1]), "s", F.col("o"), .4).first()
    assert (r.false_reject, r.false_accept) == (.5, 0)


def test_best_threshold(spark):
    gap = calibration.best_threshold(scored(spark, [.7, .8, .9], [.1, .2, .3]), "s", F.col("o")).first()
    assert .3 < gap.threshold <= .7 and gap.balanced_accuracy == 1 and gap.threshold == .31
    on_grid = calibration.sweep(scored(spark, [.29, .57, .58], [.28, .0, 1.0]), "s", F.col("o")).collect()
    for r in on_grid:
        fr = sum(x < r.threshold for x in (.29, .57, .58)) / 3
        fa = sum(x >= r.threshold for x in (.28, .0, 1.0)) / 3
        assert (r.false_reject, r.false_accept) == (pytest.approx(fr), pytest.approx(fa)), r.threshold


def test_refit_moves_from_the_prior(spark):
    rows = spark.createDataFrame([(i / 20, None, int(i > 10)) for i in range(20)], "a double, b double, y int")
    prior = {"a": .5, "b": .2}
    loose = calibration.refit_weights(rows, ("a", "b"), "y", prior, strength=.01)
    tight = calibration.refit_weights(rows, ("a", "b"), "y", prior, strength=1e4)
    assert loose["a"] > .6 and loose["b"] == pytest.approx(.2) and tight["a"] == pytest.approx(.5, abs=.01)


def test_spearman_without_variance(spark):
    r = agreement.spearman(spark.createDataFrame([(1, 1.0, 2.0)], "k long, a double, b double"), "a", "b", "k").first()
    assert r.spearman != r.spearman


def test_weighted_median(spark):
    rows = [(1, i, a, w) for i, (a, w) in enumerate([(-1.0, 1.0), (0.5, 5.0), (3.0, 1.0), (60.0, 99.0)])] + [(2, 9, 1.0, .5), (3, 8, 40.0, 9.0)]
    df = spark.createDataFrame(rows, "p long, k long, a double, w double")
    got = {r.p: r.weighted_median for r in agreement.weighted_median(df, ["p"], "a", "w", "k", min_total=2.0).collect()}
    assert got == {1: .5, 2: None, 3: None}


# --- progress --------------------------------------------------------------------------------

def test_ledger(spark):
    logs = {1: ["claim", "complete"], 2: ["claim", "fail", "claim", "fail", "claim", "fail"], 3: ["claim", "requeue"],
            4: ["requeue", "claim", "requeue", "requeue"], 5: ["claim"], 6: []}
    rows = [(item, n, e) for item, events in logs.items() for n, e in enumerate(events or ["note"])]
    got = {r.item: (r.state, r.attempts) for r in progress.attempt_ledger(
        spark.createDataFrame(rows, "item long, n long, event string"), ("item",), ("n",)).collect()}
    assert got == {1: ("done", 0), 2: ("failed", 3), 3: ("pending", 1), 4: ("pending", 1), 5: ("running", 0), 6: ("pending", 0)}


def test_rolling_rate(spark):
    rows = [("j", 0, 0, 0), ("j", 30_000, 1, 30), ("j", 60_000, 2, 30), ("j", 95_000, 3, 60), ("j", 300_000, 4, 61)]
    df = spark.createDataFrame(rows, "job string, t long, seq long, c long")
    got = {r.seq: (r.rate, r.eta_sec) for r in progress.rolling_rate(
        df, "job", "t", "seq", "c", total=F.lit(91)).collect()}
    assert got == {0: (None, None), 1: (1.0, 61), 2: (.5, 122), 3: (30 / 35, 36), 4: (None, None)}


def test_keyset_page(spark):
    last = lookups.keyset_page(spark.range(10), "id", 6, 5).collect()
    assert [r.id for r in last] == [7, 8, 9] and {r.next_cursor for r in last} == {None}
    assert {r.next_cursor for r in lookups.keyset_page(spark.range(10), "id", 2, 3).collect()} == {5}


def test_percentiles(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([5, 1, 4, 2])], "k long, v double")
    got = {r.p: r.value for r in agreement.percentiles(df, "v", "k", (0.0, .5, .9, 1.0)).collect()}
    assert got == {0.0: 1, .5: 3, .9: pytest.approx(4.7), 1.0: 5}


def test_export_texts(spark):
    entries = spark.createDataFrame([("/p/a.cr3", "pick"), ("/p/b.cr3", "alt"), ("/p/c.cr3", "pick")], "path string, state string")
    closed = '<x:x xmlns:x="u"><rdf:Description xmlns:rdf="r" xmlns:xmp="http://ns.adobe.com/xap/1.0/"/></x:x>'
    texts = spark.createDataFrame([("/p/b.xmp", closed), ("/p/c.xmp", FULL)], "sidecar_path string, text string")
    plan = sidecars.plan_export(entries, texts, pick_label='Top "1" & <2')
    got = {r.path: r for r in sidecars.export_texts(plan, True).collect()}
    assert {k: r.action for k, r in got.items()} == {"/p/a.cr3": "new", "/p/b.cr3": "update", "/p/c.cr3": "conflict"}
    for path in ("/p/a.cr3", "/p/b.cr3"):
        tag = ElementTree.fromstring(got[path].new_text).find(".//{*}Description")
        assert int(tag.get("{http://ns.adobe.com/xap/1.0/}Rating")) == got[path].new_rating
        assert tag.get("{http://ns.adobe.com/xap/1.0/}Label") == ('Top "1" & <2' if path == "/p/a.cr3" else None)
    assert sidecars.export_texts(plan).count() == 2


def test_new_ids_are_numbered(spark):
    rows = spark.createDataFrame([("added", f"p{i}", None, 1, 1.0, f"c{i % 7}", None) for i in range(50)]
                                 + [("unchanged", "old", 9, 1, 1.0, "o", None)],
                                 "class string, rel_path string, photo_id long, size long, mtime double, content_id string, previous_path string")
    got = [r.photo_id for r in ingest.next_snapshot(rows, F.lit(100).cast("long")).collect()]
    assert sorted(got) == [9, *range(100, 150)]


def test_unranked_entries_come_last(spark):
    rows = spark.createDataFrame([(1, i, i) for i in range(1, 121)] + [(1, 500, None), (1, 0, 0)], "g int, k int, rank int")
    got = lookups.compare_set(rows, ["g"], F.col("k") == 0, "k", others=120).collect()
    assert {r.k: r.slot for r in got}[120] == 120 and 500 not in {r.k for r in got}


def test_tile_lookup_meets_no_join(spark):
    rows = spark.range(40).selectExpr("id", "transform(sequence(0, 2), r -> transform(sequence(0, 1), k -> id + r * k + 0.5D)) AS tiles")
    found = lookups.tile_lookup(rows, "id")
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.id, r.row, r.col): (r.value, r.tile_max, r.tile_mean) for r in found.collect()}
    assert len(got) == 240
    assert got[7, 2, 1] == (9.5, 9.5, 8.0)


def test_capture_detail_with_many_suppliers(spark, tmp_path):
    """A cent of the balance counts as much as ten thousand supplier keys."""
    con = duckdb.connect()
    for name, sql in {
            "orders": "SELECT 1::BIGINT AS o_orderkey, 5::BIGINT AS o_custkey, 'O' AS o_orderstatus",
            "supplier": "SELECT * FROM (VALUES (7::BIGINT, 100.01::DOUBLE), (30007, 100.0)) AS s(s_suppkey, s_acctbal)",
            "lineitem": """SELECT 1::BIGINT AS l_orderkey, k AS l_suppkey, 'O' AS l_linestatus, 3.0::DOUBLE AS l_extendedprice,
              f AS l_returnflag FROM (VALUES (7::BIGINT, 'A'), (30007, 'N')) AS t(k, f)"""}.items():
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    found = QUERIES["capture_detail"](spark, str(tmp_path))
    assert [r.state for r in found.collect()] == ["N"]
    assert compare.difference(found, con, ORACLES["capture_detail"]) is None

"""Incremental merge of a listing into the known captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import checkpoint
from .ordered import row_numbers

def escalate_collisions(rows: DataFrame, cid: str = "content_id", size: str = "size",
                        full: str = "full_hash") -> DataFrame:
    """Add `identity`: the full hash where files that share a content id differ.

    A collision is a fact about the id, so it is one aggregation joined back;
    files are never compared pair by pair.
    """
    clash = rows.groupBy(cid).agg(
        F.min(size).alias("_s0"), F.max(size).alias("_s1"),
        F.min(full).alias("_h0"), F.max(full).alias("_h1")).where(
            (F.col("_s0") != F.col("_s1")) | (F.col("_h0") != F.col("_h1")))
    marked = rows.join(clash.select(cid, F.lit(True).alias("_clash")), cid, "left")
    return marked.withColumns({
        "collided": F.coalesce("_clash", F.lit(False)),
        "identity": F.when(F.col("_clash"), F.col(full)).otherwise(F.col(cid)),
    }).drop("_clash")


def classify_listing(known: DataFrame, listing: DataFrame) -> DataFrame:
    """One row per listed or lost path with its class.

    known: photo_id, rel_path, size, mtime, content_id, missing.
    listing: rel_path, size, mtime, content_id (the identity after collision
    handling).

    unchanged / reappeared: same path, size and mtime. modified: known path,
    touched or new bytes. moved: bytes of a known file whose path is gone.
    duplicate: bytes already present elsewhere, or a further copy of new bytes.
    added: new bytes. missing: known path gone and not moved, or its place
    taken by another known file. Of several candidates for the same bytes a
    known path goes first, then the lowest path. Bytes that are unknown (no content_id)
    equal nothing. Any number of paths may share one content_id (empty files, default
    sidecars): they are reduced to the first of them where they are read. The matched paths
    and the settled candidates are written once, since several classes read them.
    """
    old = known.select(*[F.col(c).alias(f"old_{c}") for c in
                         ("photo_id", "rel_path", "size", "mtime", "content_id", "missing")])
    paths = listing.join(old, listing.rel_path == F.col("old_rel_path"), "full_outer")
    same = (F.col("size") == F.col("old_size")) & (F.col("mtime") == F.col("old_mtime"))
    own = F.col("content_id") == F.col("old_content_id")
    paths = checkpoint(paths.withColumn(
        "class", F.when(F.col("rel_path").isNull(), "missing")
        .when(F.col("old_rel_path").isNull(), "candidate")
        .when(same & F.col("old_missing"), "reappeared").when(same, "unchanged")
        .when(own, "modified").otherwise("candidate")))

    owners = paths.where("old_photo_id IS NOT NULL").groupBy(
        F.col("old_content_id").alias("content_id")).agg(
            F.max(F.col("class").isin("unchanged", "reappeared", "modified")).alias("_present"),
            F.min(F.when(F.col("class") == "missing",
                         F.struct("old_photo_id", "old_rel_path"))).alias("_gone"))
    candidates = paths.where("class = 'candidate'").withColumn(
        "_turn", F.struct(F.col("old_photo_id").isNull().alias("fresh"), "rel_path"))
    # of equal bytes one path at most is more than a duplicate, so what is known of the bytes
    # goes back to that one path and never to all that share them
    firsts = candidates.where("content_id IS NOT NULL").groupBy("content_id").agg(F.min("_turn").alias("_first"))
    leads = firsts.join(owners, "content_id", "left").where(~F.coalesce("_present", F.lit(False))).select(
        F.col("_first.rel_path").alias("_lead"), "_gone")
    candidates = candidates.join(leads, F.col("rel_path") == F.col("_lead"), "left")
    kind = (F.when(F.col("content_id").isNotNull() & F.col("_lead").isNull(), "duplicate")
            .when(F.col("_gone").isNotNull(), "moved")
            .when(F.col("old_photo_id").isNotNull(), "modified").otherwise("added"))
    candidates = checkpoint(candidates.withColumn("class", kind))
    moved = F.col("class") == "moved"
    placed = candidates.select(
        "class", "rel_path",
        F.when(moved, F.col("_gone.old_photo_id"))
        .when(F.col("class") == "modified", F.col("old_photo_id")).alias("photo_id"),
        "size", "mtime", "content_id",
        F.when(moved, F.col("_gone.old_rel_path")).alias("previous_path"))

    none = F.lit(None).cast("string")
    settled = paths.where("class IN ('unchanged', 'reappeared', 'modified')").select(
        "class", "rel_path", F.col("old_photo_id").alias("photo_id"), "size", "mtime",
        "content_id", none.alias("previous_path"))
    displaced = candidates.where("old_photo_id IS NOT NULL AND class <> 'modified'")
    lost = paths.where("class = 'missing'").select(*[f"old_{c}" for c in (
        "photo_id", "rel_path", "size", "mtime", "content_id")])
    lost = lost.unionByName(displaced.select(*lost.columns)).select(
        F.lit("missing").alias("class"), F.col("old_rel_path").alias("rel_path"),
        F.col("old_photo_id").alias("photo_id"), F.col("old_size").alias("size"),
        F.col("old_mtime").alias("mtime"), F.col("old_content_id").alias("content_id"),
        none.alias("previous_path"))
    lost = lost.join(placed.where("class = 'moved'").select("photo_id"), "photo_id", "left_anti")
    return settled.unionByName(placed).unionByName(lost)


def next_snapshot(classified: DataFrame, first_new_id: Column) -> DataFrame:
    """The captures after the merge; `drop_analysis` marks modified files.

    New captures are numbered from `first_new_id` on, in the order of their content and
    path; the caller's ids must stay below it.
    """
    rows = classified.where("class <> 'duplicate'").select(
        "photo_id", "rel_path", "size", "mtime", "content_id", (F.col("class") == "missing").alias("missing"),
        (F.col("class") == "modified").alias("drop_analysis"))
    new = row_numbers(rows.where("photo_id IS NULL"), (), ("content_id", "rel_path"), "_n")
    named = new.withColumn("photo_id", first_new_id + F.col("_n") - 1).drop("_n")
    return rows.where("photo_id IS NOT NULL").unionByName(named)


def merge_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def backfill(rows: DataFrame, probed: DataFrame, key: str, fields,
             needed: Column) -> DataFrame:
    """Take non-NULL probe values for rows where `needed`; others stay as they are."""
    fields = list(fields)
    values = probed.select(key, *[F.col(f).alias(f"_new_{f}") for f in fields],
                           F.lit(True).alias("_probed"))
    joined = rows.withColumn("_needed", needed).join(values, key, "left")
    use = F.col("_needed") & F.col("_probed")
    found = F.lit(False)
    for field in fields:
        found = found | F.col(f"_new_{field}").isNotNull()
    changed = use & found
    filled = {f: F.when(use, F.coalesce(f"_new_{f}", f)).otherwise(F.col(f)) for f in fields}
    return joined.withColumn("backfilled", F.coalesce(changed, F.lit(False))).withColumns(filled).drop(
        "_needed", "_probed", *[f"_new_{f}" for f in fields])


def normalize_date(raw: Column) -> Column:
    """`Y:M:D h:m:s` to ISO form; text without a space passes through."""
    day = F.substring_index(raw, " ", 1)
    clock = F.substr(raw, F.length(day) + 2)
    return F.when(F.instr(raw, " ") > 0,
                  F.concat(F.replace(day, F.lit(":"), F.lit("-")), F.lit("T"), clock)).otherwise(raw)


def normalize_subsec(raw: Column) -> Column:
    """Milliseconds from the first three digits, padded right: '5' is 500."""
    digits = F.substring(F.trim(raw), 1, 3)
    return F.when(digits.rlike("^[0-9]+$"), F.rpad(digits, 3, "0").cast("int"))


def first_nonzero(*columns: str) -> Column:
    """First tag that is present and not 0; the last one as it is."""
    *head, last = columns
    return F.coalesce(*[F.when(F.col(c) != 0, F.col(c)) for c in head], F.col(last))


def top_level(path: str = "rel_path") -> Column:
    """First folder of a path, '.' for files at the root."""
    return F.when(F.instr(path, "/") > 0, F.substring_index(F.col(path), "/", 1)).otherwise(".")


def propose_shoots(photos: DataFrame, path: str = "rel_path", time: str = "captured_at") -> DataFrame:
    """Photos with `proposal`: one per top folder, or one for all when any
    photo lies at the root."""
    loose = photos.agg(F.coalesce(F.max(~F.col(path).contains("/")), F.lit(False)).alias("_loose"))
    return photos.join(F.broadcast(loose)).withColumn(
        "proposal", F.when(F.col("_loose"), ".").otherwise(top_level(path))).drop("_loose")


def summarize_proposals(proposed: DataFrame, path: str = "rel_path",
                        time: str = "captured_at") -> DataFrame:
    folder = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return proposed.groupBy("proposal").agg(
        F.count(F.lit(1)).alias("n_photos"), F.min(time).alias("start"), F.max(time).alias("end"),
        F.countDistinct(folder).alias("n_directories"))


def proposal_lists(proposed: DataFrame, key: str, path: str = "rel_path", time: str = "captured_at", subsec: str | None = None) -> DataFrame:
    """(proposal, kind, pos, item): the photos of each proposal in capture order (undated
    ones last, then by `subsec` and path) and its folders in their own order, from 1 on.

    Long form: a proposal may hold a whole library, so no list is gathered.
    """
    moment = [F.col(time), *([F.col(subsec)] if subsec else [])]
    photos = proposed.select("proposal", F.lit("photo").alias("kind"), F.col(key).cast("string").alias("item"),
                             F.struct(F.col(time).isNull().alias("undated"), *[m.alias(f"m{i}") for i, m in enumerate(moment)],
                                      F.col(path).alias("path"), F.col(key).alias("key")).alias("_at"))
    names = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    folders = proposed.select("proposal", F.when(names == "", ".").otherwise(names).alias("item")).distinct()
    first = row_numbers(photos, ("proposal",), ("_at",), "pos").select("proposal", "kind", "pos", "item")
    second = row_numbers(folders, ("proposal",), ("item",), "pos").select("proposal", F.lit("folder").alias("kind"), "pos", "item")
    return first.unionByName(second)

"""File listings: filtering, pairing, content identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params as P


def read_listing(spark: SparkSession, root: str) -> DataFrame:
    """rel_path, size, mtime of every file below root; contents stay unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    return files.select(
        F.substring_index(F.col("path"), base, -1).alias("rel_path"),
        F.col("length").alias("size"),
        (F.unix_millis("modificationTime") / 1000.0).alias("mtime"))


def path_columns(path: str = "rel_path") -> dict[str, Column]:
    """filename, directory, basename and lower-case extension of a path."""
    filename = F.substring_index(F.col(path), "/", -1)
    directory = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    has_ext = filename.rlike("^.+[.][^.]+$")
    return {
        "filename": filename,
        "directory": F.when(directory == "", ".").otherwise(directory),
        "basename": F.when(has_ext, F.regexp_extract(filename, "^(.+)[.][^.]+$", 1)).otherwise(filename),
        "ext": F.when(has_ext, F.lower(F.substring_index(filename, ".", -1))).otherwise(""),
    }


def scan_files(listing: DataFrame, path: str = "rel_path",
               extensions=(*P.RAW_EXTENSIONS, *P.RENDERED_EXTENSIONS, P.SIDECAR_EXTENSION)) -> DataFrame:
    """Keep files with a wanted extension outside hidden and skipped folders."""
    rows = listing.withColumns(path_columns(path))
    parts = F.split(F.col(path), "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    skipped = F.exists(folders, lambda d: d.startswith(".") | d.isin(*P.SKIP_DIRS)
                       | d.endswith(P.SKIP_DIR_SUFFIX) | d.contains(P.SKIP_DIR_PART))
    return rows.where(~F.col("filename").startswith(".") & ~skipped
                      & F.col("ext").isin(*extensions))


def pair_captures(files: DataFrame, path: str = "rel_path", raw=P.RAW_EXTENSIONS,
                  rendered=P.RENDERED_EXTENSIONS, sidecar=P.SIDECAR_EXTENSION) -> DataFrame:
    """One row per capture: primary file, rendered sibling, sidecar.

    Per folder and base name the first raw file is primary and the first
    rendered file its sibling; a rendered file alone is a capture; further raw
    files stand alone; sidecars with nothing to attach to are dropped.
    """
    keys = ["directory", "basename"]
    firsts = files.groupBy(*keys).agg(
        F.min(F.when(F.col("ext").isin(*raw), F.col(path))).alias("_raw"),
        F.min(F.when(F.col("ext").isin(*rendered), F.col(path))).alias("_rendered"),
        F.min(F.when(F.col("ext") == sidecar, F.col(path))).alias("_sidecar"))
    primary = F.coalesce("_raw", "_rendered")
    first = firsts.where(primary.isNotNull()).select(
        *keys, primary.alias("primary_path"),
        F.when(F.col("_raw").isNotNull(), F.col("_rendered")).alias("rendered_path"),
        F.col("_sidecar").alias("sidecar_path"))
    extra = (files.where(F.col("ext").isin(*raw)).select(*keys, F.col(path).alias("primary_path"))
             .join(firsts.select(*keys, F.col("_raw").alias("primary_path")),
                   [*keys, "primary_path"], "left_anti"))
    none = F.lit(None).cast("string")
    return first.unionByName(extra.select(
        *keys, "primary_path", none.alias("rendered_path"), none.alias("sidecar_path")))


def content_id(content: Column, size: Column, chunk: int = P.IDENTITY_CHUNK) -> Column:
    """Identity from size, first and last chunk; `content` is binary or text.

    The last chunk starts after the first, so short files are not read twice.
    """
    rest = F.greatest(F.lit(0), F.least(F.lit(chunk), size - chunk)).cast("int")
    head = F.substring(content, 1, chunk)
    tail = F.when(rest > 0, F.substr(content, (size - rest + 1).cast("int"), rest)).otherwise(
        F.substring(content, 1, 0))
    return F.sha2(F.concat(size.cast("string").cast("binary"), head.cast("binary"),
                           tail.cast("binary")), 256)


def full_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)

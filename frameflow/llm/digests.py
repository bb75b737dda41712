"""Exact dedup against a persistent index of digests, DataFrame functions only.

The index is a table bucketed and sorted by digest. What arrives is reduced to one entry
per digest, told from what is known by a sort-merge anti-join in which the index is
neither shuffled nor gathered, and appended in the same buckets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import checkpoint, ensure_checkpoint_dir, shuffle_partitions

BLANKS = " \t\n\x0b\f\r"
#: Arrivals that a table of documents is cut into, longest texts first.
ARRIVALS = 2
#: A digest with more than this share of all rows is joined by a broadcast of at most so many digests.
HOT_SHARE = 1000
SCHEMA = "digest binary, {key} {kind}, chars int, row long, n long, fresh boolean"


def digest_of(text: Column) -> Column:
    """SHA-256 of the text without its blanks; null counts as empty."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text.cast("string"), F.lit("")), BLANKS, "").cast("binary"), 256))


class DigestIndex:
    """Digests seen so far, at `path`, in `buckets` buckets.

    One row per digest and arrival: digest, keeper (the key of the row that stays), chars
    and row of that keeper, n (rows that arrived with it), fresh (the digest was new). An
    index is reopened by its path, also in another session; the number of buckets is part
    of it. Not safe for two writers at once.
    """

    def __init__(self, spark: SparkSession, path: str, key_type: str = "bigint", buckets: int | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = buckets or shuffle_partitions(spark)
        self.name = "digests_" + uuid.uuid4().hex
        columns = SCHEMA.format(key="keeper", kind=key_type)
        spark.sql(f"CREATE TABLE {self.name} ({columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) "
                  f"INTO {self.buckets} BUCKETS LOCATION '{self.path}'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, entries: DataFrame) -> None:
        """Add rows, one file per bucket."""
        (entries.select("digest", "keeper", "chars", "row", "n", "fresh").repartition(self.buckets, "digest")
         .sortWithinPartitions("digest").write.insertInto(self.name))

    def add(self, arrived: DataFrame) -> None:
        """Take in `arrived` (digest, key, chars, row). Of equal digests that are new, the
        row of most chars stays, then of smallest key (null last), then of smallest row;
        for known ones only the number of rows is noted."""
        best = F.min(F.struct((-F.col("chars")).alias("less"), F.col("key").isNull().alias("none"), "key", "row"))
        entries = arrived.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("n"))
        entries = checkpoint(entries.select("digest", F.col("best.key").alias("keeper"), (-F.col("best.less")).alias("chars"),
                                            F.col("best.row").alias("row"), "n"))
        known = self.table().select("digest").hint("merge")
        fresh = entries.join(known, "digest", "left_anti").withColumn("fresh", F.lit(True))
        again = entries.join(known, "digest", "left_semi").withColumn("fresh", F.lit(False))
        self.append(checkpoint(fresh.unionByName(again)))

    def groups(self) -> DataFrame:
        """digest, keeper, keeper_row, group_size of every digest; needs no shuffle."""
        first = F.max(F.when(F.col("fresh"), F.struct("keeper", "row"))).alias("kept")
        return self.table().groupBy("digest").agg(first, F.sum("n").alias("group_size")).select(
            "digest", F.col("kept.keeper").alias("keeper"), F.col("kept.row").alias("keeper_row"), "group_size")

    def drop(self, files: bool = False) -> None:
        """Forget the table's name; the files at `path` stay unless `files` is set."""
        self.spark.sql(f"DROP TABLE {self.name}")
        if files:
            context = self.spark.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(self.path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def index_folder(spark: SparkSession) -> str:
    """A new folder for an index where checkpoints are kept."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/digests-{uuid.uuid4().hex}"


def rows_of(documents: DataFrame, key: str, text: str) -> DataFrame:
    """digest, key, chars (code points) and a number of its own for every row."""
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = documents.select(digest_of(F.col(text)).alias("digest"), F.col(key).alias("key"), F.length(value).alias("chars"))
    return checkpoint(rows.withColumn("row", F.monotonically_increasing_id()))


def verdicts(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """What the index says of each row. Digests with a large share of all rows are few and
    broadcast; the others meet their rows by a join on the digest."""
    groups = groups.withColumn("_hot", F.col("group_size") * HOT_SHARE > rows.count())
    hot = F.broadcast(groups.where("_hot").select("digest", "keeper", "keeper_row", "group_size"))
    often = rows.join(hot, "digest")
    rest = rows.join(hot, "digest", "left_anti").join(groups.where("not _hot").drop("_hot"), "digest")
    return often.unionByName(rest).select(
        F.col("key").alias(key), F.col("keeper").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"),
        (F.col("row") == F.col("keeper_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def dedup(documents: DataFrame, key: str = "doc_id", text: str = "text", *, path: str | None = None,
          arrivals: int = ARRIVALS) -> DataFrame:
    """One row per document: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are without blanks (0x20, 0x09-0x0D); a null text is empty,
    and all empty texts are equal. Of equal texts the row with the most code points stays,
    then the smallest key, then any one of rows alike in all of it; a null key comes last
    and can be a keep_id. Rows with one key are rows of their own. Other columns are
    ignored, an empty table gives no rows, and the key may be of any type with an order.

    The documents go into a new index (at `path`, where it stays; else beside the
    checkpoints, and deleted after use) in `arrivals` parts, longest texts first, so that what the index knows is always what
    stays: of equal texts those in a later arrival are shorter.
    """
    spark = documents.sparkSession
    rows = rows_of(documents, key, text)
    index = DigestIndex(spark, path or index_folder(spark), dict(rows.dtypes)["key"])
    shares = [i / arrivals for i in range(1, arrivals)]
    cuts = sorted(set((shares and rows.agg(F.percentile_approx("chars", shares)).first()[0]) or []), reverse=True)
    for low, high in zip([*cuts, None], [None, *cuts], strict=True):
        part = rows if low is None else rows.where(F.col("chars") > low)
        index.add(part if high is None else part.where(F.col("chars") <= high))
    groups = checkpoint(index.groups())
    index.drop(files=path is None)
    return verdicts(rows, groups, key)

"""Session-level helpers: reliable checkpoints and bounded broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A broadcast side is used only when its row count is known to be below this.
BROADCAST_ROWS = 50_000

# With it, the files of a query's own shuffles go when its action has ended.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by spark.checkpoint.dir; a temporary one is made
    only in local mode, where driver and executors share one disk."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="frameflow-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the reliable checkpoint folder and cut its lineage there. The shuffles that
    led to it are deleted at once, not when the driver's memory is next cleaned."""
    ensure_checkpoint_dir(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(FREE_SHUFFLES, "false")
    conf.set(FREE_SHUFFLES, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a query of its own, whose shuffles no other one reads
    finally:
        conf.set(FREE_SHUFFLES, before)


def forget(*checkpoints: DataFrame | None) -> None:
    """Delete the files of checkpoints that nothing will read again, as in loops where each
    round replaces the last one's."""
    for df in checkpoints:
        if df is None:
            continue
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            context = df.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def join_same(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join on equal `keys`, NULL being equal to NULL; the keys come from the left."""
    names = {k: f"_same_{k}" for k in keys}
    on = [F.col(k).eqNullSafe(F.col(name)) for k, name in names.items()] or [F.lit(True)]
    joined = left.join(right.withColumnsRenamed(names), on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*names.values())


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast df when `rows`, a proven upper bound of its size, is small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df

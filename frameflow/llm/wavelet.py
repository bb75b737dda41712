"""Token ids in wavelet matrices: one compressed file per shard, read by rank and select.

A shard's ids become PLANES bit planes, the highest bit first; after each plane the ids
are parted stably, those with bit 0 before those with bit 1. A plane with its running
counts answers how many ones stand before a place; from plane to plane that leads to the
token at a place, to a token's count in a range, and back up to its occurrences.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import ensure_checkpoint_dir
from .tokens import word_encoder

MAGIC, VERSION = b"WVMX", 1
END_ID = 2
#: Ids per shard, but a document is never parted; ids between two stored counts of a plane.
SHARD_IDS, BLOCK = 4 << 20, 512
HEAD = "<4sHHQQ"


def encode_shard(ids: np.ndarray, lengths: np.ndarray, planes: int) -> bytes:
    """A file of `ids`, which are documents of the given lengths laid end to end."""
    if len(ids) and int(ids.max()) >> planes:
        raise ValueError(f"an id needs more than {planes} bits")
    ids = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    parts = [lengths.astype("<u4").tobytes()]
    for bit in reversed(range(planes)):
        ones = (ids >> bit & 1).astype(bool)
        parts.append(np.packbits(ones).tobytes())
        ids = np.concatenate([ids[~ones], ids[ones]])
    body = [squeeze(x) for x in parts]
    sizes = struct.pack(f"<{len(body)}Q", *map(len, body))
    return struct.pack(HEAD, MAGIC, VERSION, planes, len(ids), len(lengths)) + sizes + b"".join(body)


class Plane:
    """A bit vector with the number of ones before every BLOCK bits."""

    def __init__(self, packed: bytes, n: int) -> None:
        self.bits = np.unpackbits(np.frombuffer(packed, np.uint8), count=n)
        edges = np.arange(0, n, BLOCK)
        self.blocks = np.concatenate([[0], np.cumsum(np.add.reduceat(self.bits, edges, dtype=np.int64))]) if n else np.zeros(1, np.int64)
        self.n, self.zeros = n, n - int(self.blocks[-1])

    def rank1(self, at: int) -> int:
        """Ones before place `at`."""
        block = min(at // BLOCK, len(self.blocks) - 1)
        return int(self.blocks[block]) + int(self.bits[block * BLOCK:at].sum())

    def select(self, bit: int, k: int) -> int:
        """Place of the k-th (from 0) `bit`."""
        before = self.blocks if bit else np.minimum(np.arange(len(self.blocks)) * BLOCK, self.n) - self.blocks
        block = int(np.searchsorted(before, k, "right")) - 1
        inside = self.bits[block * BLOCK:(block + 1) * BLOCK] == bit
        return block * BLOCK + int(np.flatnonzero(inside)[k - before[block]])


class Shard:
    """Reads one file: single tokens, counts and occurrences, or whole documents."""

    def __init__(self, blob: bytes) -> None:
        magic, version, self.n_planes, self.n, n_docs = struct.unpack_from(HEAD, blob)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a shard of this format")
        sizes = struct.unpack_from(f"<{self.n_planes + 1}Q", blob, struct.calcsize(HEAD))
        ends = np.cumsum([struct.calcsize(HEAD) + 8 * len(sizes), *sizes])
        expand = zstandard.ZstdDecompressor().decompress
        self.parts = [(int(a), int(b)) for a, b in zip(ends, ends[1:], strict=False)]
        self.blob, self.expand = blob, expand
        self.lengths = np.frombuffer(self._part(0), "<u4", n_docs).astype(np.int64)
        self._planes: list[Plane | None] = [None] * self.n_planes

    def _part(self, i: int) -> bytes:
        lo, hi = self.parts[i]
        return self.expand(self.blob[lo:hi])

    def plane(self, level: int) -> Plane:
        if self._planes[level] is None:
            self._planes[level] = Plane(self._part(level + 1), self.n)
        return self._planes[level]

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for level in range(self.n_planes):
            plane = self.plane(level)
            bit = int(plane.bits[at])
            value = value << 1 | bit
            ones = plane.rank1(at)
            at = plane.zeros + ones if bit else at - ones
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(self.n_planes):
            plane = self.plane(level)
            a, b = plane.rank1(lo), plane.rank1(hi)
            lo, hi = (plane.zeros + a, plane.zeros + b) if token >> (self.n_planes - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often an id occurs in the places lo..hi."""
        if token >> self.n_planes:
            return 0
        lo, hi = self._range(token, lo, self.n if hi is None else hi)
        return hi - lo

    def select(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of an id."""
        lo, hi = self._range(token, 0, self.n) if not token >> self.n_planes else (0, 0)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for level in reversed(range(self.n_planes)):
            plane = self.plane(level)
            bit = token >> (self.n_planes - 1 - level) & 1
            at = plane.select(bit, at - plane.zeros if bit else at)
        return at

    def ids(self) -> np.ndarray:
        """All ids, by undoing the parting plane by plane from the last."""
        kind = np.uint16 if self.n_planes <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        for level in reversed(range(self.n_planes)):
            ones = np.unpackbits(np.frombuffer(self._part(level + 1), np.uint8), count=self.n).view(bool)
            zeros = self.n - int(np.count_nonzero(ones))
            before = np.empty_like(values)
            before[~ones] = values[:zeros]
            before[ones] = values[zeros:] | kind(1 << (self.n_planes - 1 - level))
            values = before
        return values.astype(np.uint32)


def write_shards(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text", *,
                 tokenizer: str | None = None, shard_ids: int = SHARD_IDS, planes: int = 16) -> None:
    """Encode all texts in ascending key order and write the shards to `path`.

    A row of the Parquet files holds one shard: _part and _shard (their order is the
    keys'), n_ids, keys (its documents' keys) and file. A null text is empty and gives
    the end id alone; rows with a null key come first; rows that share a key follow
    their text's hash. An empty table writes no shards. Other columns are ignored.
    """
    rows = documents.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    order = ["key", F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_ids = word_encoder(tokenizer)
        shard, held, keys, part = 0, [], [], 0
        end = END_ID.to_bytes(4, "little")

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            blob = encode_shard(ids, np.array([len(x) // 4 for x in held]), planes)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int64()), pa.array([len(ids)], pa.int64()),
                 pa.array([keys], pa.list_(pa.int64())), pa.array([blob], pa.binary())],
                ["_part", "_shard", "n_ids", "keys", "file"])
        size = 0
        for batch in batches:
            for name, value, part in zip(*(batch[c].to_pylist() for c in ("key", "text", "_part")), strict=True):
                ids = word_ids(value or "") + end
                held.append(ids)
                keys.append(name)
                size += len(ids) // 4
                if size >= shard_ids:
                    yield flush()
                    shard, held, keys, size = shard + 1, [], [], 0
        if held:
            yield flush()
    (ranged.mapInArrow(encode, "_part int, _shard long, n_ids long, keys array<long>, file binary")
     .write.mode("error").parquet(path))


def read_shards(spark: SparkSession, path: str, *, keep_ids: bool = False) -> DataFrame:
    """key, start (ids of all documents before it), n_tokens (with the end id), ids_crc32
    and, if asked for, ids (little-endian uint32) of every document, from the files."""
    shards = spark.read.parquet(path)
    sums = shards.groupBy("_part").agg(F.sum("n_ids").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per written partition
    parts = sums.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy("_part").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = (shards.select("_part", "_shard", "n_ids")
              .withColumn("_in", F.coalesce(F.sum("n_ids").over(own), F.lit(0)))
              .join(parts, "_part").select("_part", "_shard", (F.col("_base") + F.col("_in")).alias("_start")))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, keys, file in zip(*(batch[c] for c in ("_part", "_shard", "keys", "file")), strict=True):
                shard = Shard(file.as_py())
                raw = memoryview(shard.ids().astype("<u4").tobytes())
                ends = np.cumsum(shard.lengths)
                first = ends - shard.lengths
                spans = [raw[4 * a:4 * b] for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array([part.as_py()] * len(spans), pa.int32()), pa.array([number.as_py()] * len(spans), pa.int64()),
                           pa.array(keys.as_py(), pa.int64()), pa.array(first, pa.int64()), pa.array(shard.lengths, pa.int64()),
                           pa.array([zlib.crc32(x) for x in spans], pa.int64())]
                columns += [pa.array([bytes(x) for x in spans], pa.binary())] * keep_ids
                yield pa.RecordBatch.from_arrays(columns, ["_part", "_shard", "key", "_at", "n_tokens", "ids_crc32"] + ["ids"] * keep_ids)
    found = shards.select("_part", "_shard", "keys", "file").mapInArrow(
        decode, "_part int, _shard long, key long, _at long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids)
    return found.join(starts, ["_part", "_shard"]).select(
        "key", (F.col("_start") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * keep_ids)


def shard_folder(spark: SparkSession) -> str:
    """A new folder for files in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/shards-{uuid.uuid4().hex}"

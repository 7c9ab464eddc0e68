"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of the Arrow batches that Python workers are sent, where the session sets none: rows alone do not bound long texts.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)


def bounded(spark: SparkSession) -> None:
    if spark.conf.get(BATCH[0], None) is None:
        spark.conf.set(BATCH[0], str(BATCH[1]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir, or (only where that is unset, and
    driver and executors are one process) one of our own. On a cluster without the setting this is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = made.get() if made.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="voxloom-shared-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at


def cut(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the shared folder."""
    bounded(spark)
    shared_dir(spark)
    return df.checkpoint()


def drop_shuffles(spark: SparkSession) -> None:
    """Give back the shuffle files of frames that nothing refers to any more: Spark drops them when the driver collects garbage,
    which it may not do for long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again: cuts lineage, and is smaller than a checkpoint."""
    bounded(spark)
    at = new_path(spark, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


class Members:
    """A bit table of 64-bit keys, of at most 2**28 bits (32 MB) however many keys there are: no false negatives."""

    def __init__(self, spark: SparkSession, keys: DataFrame):
        """keys: one long column."""
        n = keys.count()
        self.size = 1 << min(28, max(15, (16 * n).bit_length()))
        at = F.col(keys.columns[0]).bitwiseAND(F.lit(self.size - 1))
        rows = keys.groupBy(F.shiftright(at, 15).alias("b")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767))).alias("bits")).collect()  # at most 8192 rows
        table = np.zeros(self.size // 8, np.uint8)
        for r in rows:
            table[r.b * 4096 : (r.b + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
        self.sent = spark.sparkContext.broadcast(table)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key may be there."""
        at = keys & (self.size - 1)
        return (self.sent.value[at >> 3] >> (at & 7)).astype(np.uint8) & 1 == 1

    def release(self) -> None:
        """Drop a worker's copy, which it would hold while idle; a later use reads the executor's file again."""
        if getattr(self.sent, "_path", None):
            vars(self.sent).pop("_value", None)


#: Rows of a key, and at most so many keys, from which `meet` broadcasts its row.
HEAVY = 10_000


def meet(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row a key. Keys with more rows in left than the HEAVY-th part of all (and HEAVY)
    are at most HEAVY keys: their rows of right are broadcast, so no task holds the rows of one key. left should be a table."""
    counted = left.groupBy(key).agg(F.count("*").alias("_vx_n"))
    limit = max(HEAVY, left.count() // HEAVY)
    hot = counted.where(F.col("_vx_n") > limit).select(key)
    if hot.isEmpty():
        return left.join(right, key, how)
    few = F.broadcast(hot)
    rest = left.join(few, key, "left_anti").join(right, key, how)
    return rest.unionByName(left.join(few, key, "left_semi").join(F.broadcast(right.join(few, key, "left_semi")), key, how))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def batches(texts, limit: int = 2 << 20):
    """Index ranges (a, b) of consecutive texts of about `limit` bytes at most; a longer text is a range of its own."""
    a, held = 0, 0
    for i, x in enumerate(texts):
        n = len(x)
        if i > a and held + n > limit:
            yield a, i
            a, held = i, 0
        held += n
    if len(texts) > a:
        yield a, len(texts)


def slices(part, column: int, limit: int = 4 << 20):
    """Parts of an Arrow batch that hold about `limit` bytes of a text column at most, so that Python objects stay few."""
    sizes = pc.fill_null(pc.binary_length(part.column(column)), 0).to_numpy(zero_copy_only=False)
    for a, b in batches([range(n) for n in sizes], limit):
        yield part.slice(a, b - a)


def give_back() -> None:
    """Return freed memory to the system: a reused worker would keep its peak otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)

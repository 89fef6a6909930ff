"""What the operators share: the shared folder, code for the workers, row keys, Bloom bits."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bits of a broadcast Bloom filter (64 MiB). Beyond it the rate of false positives grows, never the size.
BLOOM_BITS_MAX = 1 << 29
#: Rows of a side that may be broadcast; larger sides are joined by shuffle.
BROADCAST_ROWS = 20_000

#: Rows of an Arrow batch.
BATCH_ROWS = 1000

_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where that is unset and all runs on this machine, as in tests.

    On a cluster without the setting this fails: executors wouldn't see each other's files.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return configured or current.get()
    if not configured and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = configured or tempfile.mkdtemp(prefix="treeslab-")
    context.setCheckpointDir(folder)
    return folder


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def spool(frame: DataFrame) -> DataFrame:
    """Write a frame as Parquet to the shared folder and read it back: its lineage is cut, and lost executors cost no rework.

    The files go when the driver's interpreter ends.
    """
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/treeslab-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(frame.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Give this package's code to the workers, wherever the driver found it, and bound the batches that they get.

    Where the session has Spark's own batch size, texts come in batches of BATCH_ROWS, so that a few
    long ones fit in memory twice: in the executor and in its worker.
    """
    context = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="treeslab-code-"), "treeslab_code.zip")
    with zipfile.ZipFile(target, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, str(source.relative_to(root.parent)))
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)


def free_name(frame: DataFrame, name: str) -> str:
    """The name, with underscores after it until no column has it."""
    while name.lower() in {x.lower() for x in frame.columns}:
        name += "_"
    return name


def every_column(frame: DataFrame) -> list[tuple[str, Column]]:
    """The names and columns of a frame, whatever is in the names."""
    return [(x, F.col("`" + x.replace("`", "``") + "`")) for x in frame.columns]


def over_rows(frame: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """mapInArrow over whole rows, with the frame's columns again; names that hold dots are no hindrance."""
    plain = frame.toDF(*(f"c{k}" for k in range(len(frame.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*frame.columns)


def numbered(docs: DataFrame, name: str) -> tuple[DataFrame, bool]:
    """docs with a long column that is unique and orders as doc_id does, and whether it is doc_id itself.

    Where doc_id is unique and never null, it is. Otherwise the rows are numbered in the order of
    (doc_id, text hash), nulls first, so each repeated row is a document of its own.
    """
    key = F.col("doc_id").cast("long")
    clash = docs.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 or k is null").limit(1)
    if clash.isEmpty():
        return docs.withColumn(name, key), True
    return spool(docs.orderBy(key.asc_nulls_first(), F.xxhash64("text")).withColumn(name, F.monotonically_increasing_id())), False


def keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """Columns rid (see numbered), doc_id and text of docs, and whether rid is doc_id itself."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, plain = numbered(rows, "rid")
    return rows.select("rid", "doc_id", "text"), plain


class Bloom:
    """Bits of a Bloom filter over 64-bit keys that are hashes already; two probes a key."""

    def __init__(self, bits: np.ndarray, log2: int):
        self.bits, self.log2 = bits, log2

    def __getstate__(self):
        return {"bits": self.bits.tobytes(), "log2": self.log2}

    def __setstate__(self, state):
        self.bits, self.log2 = np.frombuffer(state["bits"], dtype=np.uint8), state["log2"]

    def holds(self, keys: np.ndarray) -> np.ndarray:
        mask = np.uint64((1 << self.log2) - 1)
        low, high = keys & mask, (keys >> np.uint64(64 - self.log2)) & mask
        at = lambda x: (self.bits[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8)) & np.uint8(1)
        return (at(low) & at(high)).astype(bool)


def bloom(keys: DataFrame, column: str, bits_max: int = BLOOM_BITS_MAX) -> Bloom:
    """A filter over a long column, made in pages of 4 KiB by Spark and put together on the driver (bits_max bits at most)."""
    n = max(1, keys.count())
    log2 = max(16, min(bits_max.bit_length() - 1, (16 * n).bit_length()))
    mask = (1 << log2) - 1
    key = F.col(column)
    both = F.array(key.bitwiseAND(F.lit(mask)), F.shiftrightunsigned(key, 64 - log2).bitwiseAND(F.lit(mask)))
    pages = (
        keys.select(F.explode(both).alias("bit"))
        .groupBy(F.shiftrightunsigned("bit", 15).alias("page"))
        .agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit(0x7FFF))).alias("bits"))
    )
    out = np.zeros(1 << (log2 - 3), dtype=np.uint8)
    for row in pages.toLocalIterator():
        out[row.page * 4096 : row.page * 4096 + 4096] = np.frombuffer(bytes(row.bits), dtype=np.uint8)
    return Bloom(out, log2)

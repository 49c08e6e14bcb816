"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows and bytes of one Arrow batch: a Python worker holds a batch of texts several times over.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def small_batches(spark: SparkSession) -> SparkSession:
    """Lower the session's Arrow batch limits to the above, where they are higher."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name).upper().removesuffix("B")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))
    return spark


def tidy() -> None:
    """At a task's end: give unused memory of Arrow and of the C library back, as the Python worker lives on."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's, in a session whose Arrow batches are small enough for long texts."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names; a temporary one only where everything is one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="lexigrid-checkpoint-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    sc.setCheckpointDir(shared)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def settle(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder, so that later reads neither recompute it nor depend on executors' disks."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Have the driver collect garbage now: Spark then deletes the shuffle files of settled tables that nothing else reads."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not use, in any letter case."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def col(name: str):
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


#: A filter has BITS_A_DIGEST bits for each digest, between these bounds (bytes: an eighth).
BITS_A_DIGEST, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28
_PROBES = 4


def filter_bits(digests: int) -> int:
    """The filter's size: a power of two that grows with what it will hold."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_DIGEST * digests - 1).bit_length()))


def _bit_positions(digests: list[bytes], bits: int) -> np.ndarray:
    """_PROBES positions in the filter for each digest of 8 or more bytes."""
    lanes = np.frombuffer(b"".join(d[:8] for d in digests), dtype="<u8")
    with np.errstate(over="ignore"):
        mixed = lanes * np.uint64(0x9E3779B97F4A7C15)
        step = (mixed >> np.uint64(32)) | np.uint64(1)
        return np.stack([(lanes + np.uint64(k) * step) % np.uint64(bits) for k in range(_PROBES)], axis=1)


class DigestFilter:
    """A Bloom filter: no false negatives.

    Its size follows the number of digests up to MOST_BITS (32 MB, which hold 16
    million at a few false hits in a thousand). With more it fills up, and more
    rows pass it than need be; what passes is compared exactly in any case.
    """

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def build(digests: DataFrame, column: str) -> "DigestFilter":
        """From a column of binary digests, settled first as it is read twice. The driver receives the words that have a bit, merged on the executors."""
        digests = settle(digests.select(col(column)))
        size = filter_bits(digests.count())

        def words(batches):
            import pyarrow as pa

            for batch in batches:
                own = [d for d in batch.column(0).to_pylist() if d is not None]
                if not own:
                    continue
                at = np.unique(_bit_positions(own, size).ravel())
                word, inverse = np.unique(at >> np.uint64(6), return_inverse=True)
                bits = np.zeros(len(word), dtype=np.uint64)
                np.bitwise_or.at(bits, inverse, np.uint64(1) << (at & np.uint64(63)))
                yield pa.record_batch([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], names=["word", "bits"])

        merged = digests.mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
        out = np.zeros(size // 64, dtype=np.uint64)
        got = merged.toArrow()
        out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
        return DigestFilter(out)

    def hits(self, digests: list[bytes]) -> np.ndarray:
        if not digests:
            return np.zeros(0, dtype=bool)
        at = _bit_positions(digests, 64 * len(self.words))
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)

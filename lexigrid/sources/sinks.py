"""Writers of vocabularies, co-occurrence tables, vectors, shards and text dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.operators.sentences import with_shards


def vocabulary_text(vocabulary: DataFrame, path: str, with_counts: bool = True) -> None:
    """One line a word by id, in one file: `word count`, or the word alone. The file's lines must be in one order, and a vocabulary is small beside its corpus."""
    line = F.concat_ws(" ", "word", F.col("count").cast("string")) if with_counts else F.col("word")
    vocabulary.orderBy("id").select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def cooccurrence_parquet(cooc: DataFrame, path: str) -> None:
    cooc.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("x").cast("float").alias("x")).write.mode("overwrite").parquet(path)


def cooccurrence_binary(cooc: DataFrame, path: str) -> None:
    """12-byte records (int32, int32, float32) as Hadoop-written binary rows: one Parquet column of blobs, a blob a partition batch."""

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            out = np.empty(b.num_rows, dtype=[("i", "<i4"), ("j", "<i4"), ("x", "<f4")])
            for k, c in enumerate(("i", "j", "x")):
                out[c] = b.column(k).to_numpy(zero_copy_only=False)
            yield pa.record_batch([pa.array([out.tobytes()], type=pa.binary())], names=["records"])

    cooc.select("i", "j", "x").mapInArrow(pack, "records binary").write.mode("overwrite").parquet(path)


def vectors_parquet(vectors: DataFrame, path: str) -> None:
    """word or id, and vec; also the form that text vector files are converted to."""
    vectors.write.mode("overwrite").parquet(path)


def sentence_shards(examples: DataFrame, n: int, shards: int, path: str, index: str = "row_id") -> None:
    """Contiguous shards of the index, a folder each (shard=0, shard=1, ...)."""
    sharded = with_shards(examples, n, shards, index)
    sharded.repartitionByRange(min(shards, 2000), "shard", index).sortWithinPartitions("shard", index).write.mode("overwrite").partitionBy("shard").parquet(path)


def sentences_text(frame: DataFrame, path: str, text: Column, label: Column | None = None) -> None:
    """One line a sentence, after `__label__<label> ` if labels are given."""
    line = text if label is None else F.concat(F.lit("__label__"), label.cast("string"), F.lit(" "), text)
    frame.select(line.alias("value")).write.mode("overwrite").text(path)

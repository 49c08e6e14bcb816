"""Word and feature counts, vocabularies, bags of features and frequency weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrid.functions import batches
from lexigrid.functions import text as tx
from lexigrid.operators.runtime import by_number, settle


def feature_counts(docs: DataFrame, features: Column) -> DataFrame:
    """feature, count bigint over all documents; `features` is an array column."""
    return docs.select(F.explode(features).alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("count"))


def counted_in_batches(texts: DataFrame, split) -> DataFrame:
    """feature, count of the tokens that split(), of functions/batches.py, finds in `text`; counted in Arrow batches first."""

    def count(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        from lexigrid.functions.batches import gathered

        for table in gathered(batches):
            found = pc.value_counts(split(table.column("text"))[1])
            yield pa.record_batch([found.field("values").cast(pa.string()), found.field("counts")], names=["feature", "n"])

    return texts.mapInArrow(count, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("count"))


def token_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """feature_counts() of the lower-cased tokens."""
    return counted_in_batches(docs.select(F.lower(F.col(text_col)).alias("text")), batches.tokens)


def word_counts(lines: DataFrame, text_col: str = "text", min_count: int = 1) -> DataFrame:
    """word, count of the white-space tokens of a corpus."""
    found = counted_in_batches(lines.select(F.col(text_col).alias("text")), batches.words).withColumnRenamed("feature", "word")
    return found if min_count <= 1 else found.where(F.col("count") >= min_count)


def dense_ids(keyed: DataFrame, order: list[Column], first: int = 0, name: str = "id") -> DataFrame:
    """keyed with a gapless bigint id in the given order, without moving all rows to one task.

    Rows are ordered by range; a partition's first id is the number of rows in
    the partitions before it. The driver sees one count a partition.
    """
    ranged = settle(keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()
    base, total = {}, first
    for r in sorted(sizes, key=lambda r: r["_part"]):
        base[r["_part"]] = total
        total += r["n"]
    if not base:
        return ranged.select(*keyed.columns, F.lit(first).cast("bigint").alias(name))
    own = F.col("_at") - F.shiftleft(F.col("_part"), 33)
    return ranged.select(*keyed.columns, (by_number(base, F.col("_part")) + own).cast("bigint").alias(name))


def corpus_vocabulary(lines: DataFrame, text_col: str = "text", min_count: int = 1) -> DataFrame:
    """word, count, id: ids from 0 by falling count, equal counts by word."""
    return dense_ids(word_counts(lines, text_col, min_count), [F.desc("count"), F.asc("word")])


def feature_vocabulary(docs: DataFrame, features: Column, min_count: int = 1, order: list[Column] | None = None) -> DataFrame:
    """feature, count, id: ids from 0 in the order of the features, or another."""
    found = feature_counts(docs, features).where(F.col("count") >= min_count)
    return dense_ids(found, order or [F.asc("feature")])


def top_vocabulary(lines: DataFrame, num_words: int, reserved: int, text_col: str = "text") -> DataFrame:
    """word, count, id of the most frequent num_words - 2 words, ids from `reserved`."""
    top = word_counts(lines, text_col).orderBy(F.desc("count"), "word").limit(max(0, num_words - 2))
    place = F.row_number().over(Window.orderBy(F.desc("count"), "word"))  # num_words rows at most
    return top.withColumn("id", (place - 1 + reserved).cast("bigint"))


def document_counts(docs: DataFrame, features: Column, id_col: str = "doc_id") -> DataFrame:
    """doc_id, feature, n: how often each feature occurs in each document. Rows that share an identifier are one document."""
    return docs.select(F.col(id_col), F.explode(features).alias("feature")).groupBy(id_col, "feature").agg(F.count(F.lit(1)).alias("n"))


def gram_counts(docs: DataFrame, k: int, ordered: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """document_counts() of the k-grams of lower-cased tokens as text, counted in Arrow batches; rows are shuffled only if identifiers repeat."""

    def count(parts):
        import pyarrow as pa

        for table in batches.gathered(parts):
            text, at, names, n = batches.grams(*batches.tokens(table.column("text")), k, ordered)
            ids, names = table.column(id_col).combine_chunks(), names.cast(pa.large_string())
            for low in range(0, len(n), 50_000):
                own = slice(low, low + 50_000)
                yield from pa.table({id_col: ids.take(pa.array(text[own])), "feature": names.take(pa.array(at[own])).cast(pa.string()), "n": pa.array(n[own])}).to_batches()

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("feature", T.StringType()), T.StructField("n", T.LongType())])
    found = docs.select(F.col(id_col), F.lower(F.col(text_col)).alias("text")).mapInArrow(count, schema)
    if docs.groupBy(id_col).count().where("count > 1").isEmpty():
        return found
    return found.groupBy(id_col, "feature").agg(F.sum("n").alias("n"))


def vocabulary_of(counted: DataFrame, min_count: int = 1, order: list[Column] | None = None) -> DataFrame:
    """feature_vocabulary() from document_counts()."""
    found = counted.groupBy("feature").agg(F.sum("n").alias("count")).where(F.col("count") >= min_count)
    return dense_ids(found, order or [F.asc("feature")])


def bag(counted: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", weights: DataFrame | None = None, default: float = 1.0) -> DataFrame:
    """bag_of_features() from document_counts()."""
    known = vocabulary.select("feature", F.col("id").alias("feature_id"))
    if weights is None:
        return counted.join(known, "feature").select(id_col, "feature_id", F.col("n").alias("value"))
    weighed = known.join(weights.select("feature", "weight"), "feature", "left").withColumn("weight", F.coalesce("weight", F.lit(float(default))))
    return counted.join(weighed, "feature").select(id_col, "feature_id", (F.col("n") * F.col("weight")).alias("value"))


def bag_of_features(docs: DataFrame, features: Column, vocabulary: DataFrame, id_col: str = "doc_id", weights: DataFrame | None = None, default: float = 1.0) -> DataFrame:
    """doc_id, feature_id, value in long form: counts, or counts times the feature's weight.

    vocabulary: feature, id. weights: feature, weight; features without one weigh
    `default`. Features outside the vocabulary are left out.
    """
    return bag(document_counts(docs, features, id_col), vocabulary, id_col, weights, default)


def sif_weights(counts: DataFrame, a: float = 1e-2) -> DataFrame:
    """feature, weight = a T / (a T + count), T the sum of all counts."""
    total = counts.agg((F.lit(float(a)) * F.sum("count")).alias("at"))
    return counts.crossJoin(F.broadcast(total)).select("feature", (F.col("at") / (F.col("at") + F.col("count"))).alias("weight"))

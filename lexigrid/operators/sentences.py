"""Sentence corpora: adjacent sentences, id encoding, splits and shards, batches, context scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.functions import text as tx
from lexigrid.functions import vectors as vx
from lexigrid.operators import counts
from lexigrid.operators.runtime import broadcast_if_small, require_unique, settle

EOS, UNKNOWN = 0, 1


def triples(lines: DataFrame, file_col: str = "file", line_col: str = "line_no", text_col: str = "text", max_length: int = 30) -> DataFrame:
    """file, line_no, pre, current, post (token arrays) of sentences with a sentence before and after in their file.

    None of the three may be empty or have max_length tokens or more.
    """
    return judged_triples(lines, file_col, line_col, text_col, max_length).where("status = 'output'").drop("status")


def judged_triples(lines: DataFrame, file_col: str = "file", line_col: str = "line_no", text_col: str = "text", max_length: int = 30) -> DataFrame:
    """As triples, all rows, with status: no_context, too_long or output."""
    w = Window.partitionBy(file_col).orderBy(line_col)
    own = lines.select(file_col, line_col, tx.split_words(F.col(text_col)).alias("current"))
    own = own.withColumns({"pre": F.lag("current").over(w), "post": F.lead("current").over(w)})
    three = ("pre", "current", "post")
    present, long = F.lit(True), F.lit(False)
    for c in three:
        present = present & F.coalesce(F.size(c) > 0, F.lit(False))
        long = long | (F.size(c) >= max_length)
    status = F.when(~present, "no_context").when(long, "too_long").otherwise("output")
    return own.select(file_col, line_col, *three, status.alias("status"))


def triple_stats(judged: DataFrame) -> DataFrame:
    """One row: seen, considered, too_long, output."""
    n = lambda c: F.count_if(c)
    return judged.agg(F.count(F.lit(1)).alias("seen"), n(F.col("status") != "no_context").alias("considered"), n(F.col("status") == "too_long").alias("too_long"), n(F.col("status") == "output").alias("output"))


def encode(frame: DataFrame, key: list[str], tokens: Column, vocabulary: DataFrame, unknown: int = UNKNOWN, eos: int | None = None, lower: bool = False) -> DataFrame:
    """key, ids: array<bigint> of the tokens' ids in the vocabulary (word, id), `unknown` for others, `eos` at the end if given. Keys tell rows apart."""
    require_unique(frame, *key)
    words = F.transform(tokens, F.lower) if lower else tokens
    own = frame.select(*key, F.posexplode_outer(words).alias("pos", "word"))
    found = own.join(broadcast_if_small(settle(vocabulary.select("word", "id")), "word"), "word", "left")
    marked = F.when(F.col("word").isNotNull(), F.struct("pos", F.coalesce("id", F.lit(unknown)).cast("bigint").alias("id")))
    ids = F.transform(F.array_sort(F.collect_list(marked)), lambda x: x["id"])
    if eos is not None:
        ids = F.concat(ids, F.array(F.lit(eos).cast("bigint")))
    return found.groupBy(*key).agg(ids.alias("ids"))


def truncate(tokens: Column, length: int = 30) -> Column:
    return F.slice(tokens, F.lit(1), F.lit(length))


def padded_batches(encoded: DataFrame, order: list[Column], batch_size: int = 128) -> DataFrame:
    """encoded (ids) with batch, ids padded with 0 to the longest of the batch, and a 0/1 mask."""
    placed = counts.dense_ids(encoded, order, name="row_id").withColumn("batch", F.expr(f"row_id div {batch_size}"))
    longest = F.max(F.size("ids")).over(Window.partitionBy("batch"))
    sized = placed.withColumn("longest", longest)
    return sized.withColumns({"mask": tx.mask(F.col("ids"), F.col("longest")), "ids": tx.pad(F.col("ids"), F.col("longest"))}).drop("longest")


def shard_borders(n: int, shards: int) -> list[int]:
    return [int(n * k / shards) for k in range(shards + 1)]


def with_shards(ordered: DataFrame, n: int, shards: int, index: str = "row_id") -> DataFrame:
    """shard: contiguous stretches of the index 0..n-1, as even as whole numbers allow."""
    borders = shard_borders(n, shards)
    at = F.lit(0)
    for k in range(1, shards):
        at = F.when(F.col(index) >= borders[k], F.lit(k)).otherwise(at)
    return ordered.withColumn("shard", at)


def shard_name(split: str, shard: int, shards: int) -> str:
    return f"{split}-{shard:05d}-of-{shards:05d}"


def permuted_split(frame: DataFrame, key: str, held_out: int, seed: int = 123) -> DataFrame:
    """frame with split: the held_out rows that come first in a seeded order are 'validation', the rest 'train'."""
    ordered = counts.dense_ids(frame, [F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key)], name="row_id")
    return ordered.withColumn("split", F.when(F.col("row_id") < held_out, "validation").otherwise("train"))


def head_tail_split(frame: DataFrame, order: list[Column], head: int, names: tuple[str, str] = ("validation", "train")) -> DataFrame:
    """frame with split: the first `head` rows in the given order have the first name, the rest the second."""
    ordered = counts.dense_ids(frame, order, name="row_id")
    return ordered.withColumn("split", F.when(F.col("row_id") < head, names[0]).otherwise(names[1])).drop("row_id")


def first_sentences(frame: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first `most` rows in the given order."""
    return counts.dense_ids(frame, order, name="row_id").where(F.col("row_id") < most).drop("row_id")


def context_scores(batch: DataFrame, context: int = 1, left: str = "left_vec", right: str = "right_vec", group: str = "batch", place: str = "pos") -> DataFrame:
    """batch, p, q, score, target: all pairs of rows of a batch, as the contrastive objective defines them.

    The score of a row with itself is 0; targets are pairs up to `context` places
    apart. A batch has a fixed size (the caller's), so its pairs are bounded.
    """
    a = batch.select(F.col(group).alias("batch"), F.col(place).alias("p"), F.col(left).alias("x"))
    b = batch.select(F.col(group).alias("batch"), F.col(place).alias("q"), F.col(right).alias("y"))
    score = F.when(F.col("p") == F.col("q"), 0.0).otherwise(vx.dot(F.col("x"), F.col("y")))
    apart = F.abs(F.col("p") - F.col("q"))
    return a.join(b, "batch").select("batch", "p", "q", score.alias("score"), apart.between(1, context).alias("target"))


def retrieval_accuracy(scores: DataFrame) -> DataFrame:
    """One row: forward and backward, how often a row's best score is the next (previous) row of its batch."""
    best = scores.groupBy("batch", "p").agg(F.max_by("q", F.struct("score", -F.col("q"))).alias("best"), F.max("q").alias("last"))
    share = lambda hit, among: F.avg(F.when(among, hit.cast("double")))
    return best.agg(share(F.col("best") == F.col("p") + 1, F.col("p") < F.col("last")).alias("forward"), share(F.col("best") == F.col("p") - 1, F.col("p") > 0).alias("backward"))

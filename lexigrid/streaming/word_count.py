"""An extension: vocabulary counts kept up to date over a stream of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.functions import text as tx


def word_counts(stream: DataFrame, text_col: str = "text") -> DataFrame:
    """word, count over everything seen; write it in update or complete mode."""
    return stream.select(F.explode(tx.split_words(F.col(text_col))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("count"))

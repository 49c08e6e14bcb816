"""Linear maps between vector spaces, embedding induction and vocabulary expansion.

Tables are reduced to Gram matrices (dimension squared, whatever the rows) on the
executors; the driver only solves those.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.operators import cooc as cx
from lexigrid.operators.runtime import broadcast_if_small, settle


def gram_matrices(pairs: DataFrame, x: str = "source", y: str = "target") -> dict[str, np.ndarray]:
    """n, sums of x and y, X'X and X'Y, added up partition by partition and then pairwise."""

    def partial(batches):
        total = None
        for pdf in batches:
            if not len(pdf):
                continue
            a, b = np.stack(pdf[x].to_numpy()).astype(np.float64), np.stack(pdf[y].to_numpy()).astype(np.float64)
            one = np.ones((len(a), 1))
            own = np.hstack([one, a]).T @ np.hstack([one, a, b])
            total = own if total is None else total + own
        if total is not None:
            at = np.arange(total.size)
            yield pd.DataFrame({"at": at, "cols": total.shape[1], "v": total.ravel()})

    summed = pairs.select(x, y).mapInPandas(partial, "at long, cols long, v double").groupBy("at", "cols").agg(F.sum("v").alias("v")).toPandas().sort_values("at")
    if not len(summed):
        raise ValueError("no rows to align")
    full = summed["v"].to_numpy().reshape(-1, int(summed["cols"].iloc[0]))
    d = full.shape[0] - 1
    return {"n": full[0, 0], "sx": full[0, 1 : d + 1], "sy": full[0, d + 1 :], "xx": full[1:, 1 : d + 1], "xy": full[1:, d + 1 :]}


def fit_transform(pairs: DataFrame, orthogonal: bool = True, fit_intercept: bool = False, x: str = "source", y: str = "target") -> tuple[np.ndarray, np.ndarray]:
    """(M, b) with y close to M x + b: orthogonal Procrustes, or least squares."""
    g = gram_matrices(pairs, x, y)
    xx, xy = g["xx"], g["xy"]
    if fit_intercept:
        xx = xx - np.outer(g["sx"], g["sx"]) / g["n"]
        xy = xy - np.outer(g["sx"], g["sy"]) / g["n"]
    if orthogonal:
        u, _, v = np.linalg.svd(xy.T)
        m = u @ v
    else:
        m = np.linalg.lstsq(xx, xy, rcond=None)[0].T
    b = (g["sy"] - m @ g["sx"]) / g["n"] if fit_intercept else np.zeros(len(g["sy"]))
    return m, b


def apply_transform(frame: DataFrame, m: np.ndarray, b: np.ndarray, vec: str = "vec", out: str = "vec") -> DataFrame:
    @F.pandas_udf("array<double>")
    def mapped(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(v.to_numpy()).astype(np.float64) @ m.T + b)) if len(v) else v

    return frame.withColumn(out, mapped(F.col(vec)))


def linear_alignment(source: DataFrame, target: DataFrame, orthogonal: bool = True, fit_intercept: bool = False) -> float:
    """Mean cosine of the mapped source and the target over their shared words."""
    from lexigrid.operators.doc_vectors import average_cosine, shared_vocabulary

    pairs = shared_vocabulary(source, target)
    m, b = fit_transform(pairs, orthogonal, fit_intercept)
    return average_cosine(apply_transform(pairs, m, b, "source", "source")).first()["cosine"]


def expand_vocabulary(model: DataFrame, source: DataFrame) -> DataFrame:
    """word, vec: the model's own vectors, and for other source words (none with `_`) their vectors mapped by least squares with intercept."""
    pairs = source.select("word", F.col("vec").alias("source")).join(model.select("word", F.col("vec").alias("target")), "word")
    m, b = fit_transform(pairs, orthogonal=False, fit_intercept=True)
    mapped = apply_transform(source.where(~F.col("word").contains("_")).select("word", "vec"), m, b).withColumnRenamed("vec", "mapped")
    own = model.select("word", F.col("vec").cast("array<double>").alias("own"))
    return own.join(mapped, "word", "full_outer").select("word", F.coalesce("own", "mapped").alias("vec"))


def _context_sums(cooc: DataFrame, vectors: DataFrame) -> DataFrame:
    """i, s (sum of x times the column's vector), known (sum of x): rows of the symmetric co-occurrence over columns with a vector (id, vec)."""
    from lexigrid.operators.doc_vectors import dimension_of, vector_sum

    n = dimension_of(vectors)
    own = settle(vectors.select(F.col("id").alias("j"), F.col("vec").cast("array<double>").alias("v")))
    known = cx.symmetric(cooc).join(broadcast_if_small(own, "j", 8 * n), "j")
    summed = known.groupBy("i").agg(F.sum("x").alias("known"), *vector_sum(F.col("v"), F.col("x"), n))
    return summed.select("i", F.array(*[F.col(f"_{k}") for k in range(n)]).cast("array<double>").alias("s"), "known")


def context_vectors(cooc: DataFrame, vectors: DataFrame) -> DataFrame:
    """i, vec: rows of the symmetric co-occurrence times the vectors (id, vec), over the row's sum; rows without a known context are left out."""
    return _context_sums(cooc, vectors).join(cx.row_sums(cooc), "i").select("i", F.transform("s", lambda x: x / F.col("total")).alias("vec"))


def corpus_context_vectors(lines: DataFrame, vocabulary: DataFrame, vectors: DataFrame, window: int = 10, only: DataFrame | None = None) -> DataFrame:
    """context_vectors() of the co-occurrence of a corpus, which is not made if the vocabulary and the vectors can go to all tasks; of ids in `only` (id) alone if given."""
    found = cx.context_totals(lines, vocabulary, vectors, window, only)
    if found is None:
        out = context_vectors(settle(cx.cooccurrence(lines, vocabulary, window)), vectors)
        return out if only is None else out.join(only.select(F.col("id").alias("i")), "i", "left_semi")
    return found.select("i", F.transform("s", lambda x: x / F.col("total")).alias("vec"))


def induce_embeddings(source_vocabulary: DataFrame, source_cooc: DataFrame | None, source_vectors: DataFrame, target_vocabulary: DataFrame, target_cooc: DataFrame, source_contexts: DataFrame | None = None) -> DataFrame:
    """id, vec for each word of the target vocabulary, from its contexts.

    vocabularies: word, id; source_vectors: id, vec. A map without intercept is
    fitted from context averages to the source's vectors and applied to context
    averages in the target, whose context words count only if the source has
    them. Words without such contexts get zeros. source_contexts (i, vec), from
    corpus_context_vectors(), stands for source_cooc.
    """
    fit = (context_vectors(source_cooc, source_vectors) if source_contexts is None else source_contexts).select(F.col("i").alias("id"), F.col("vec").alias("source")).join(source_vectors.select("id", F.col("vec").alias("target")), "id")
    m, b = fit_transform(fit, orthogonal=False)
    shared = target_vocabulary.select("word", F.col("id").alias("tid")).join(source_vocabulary.select("word", "id"), "word")
    reached = shared.join(source_vectors, "id").select(F.col("tid").alias("id"), "vec")
    averages = _shared_contexts(target_cooc, reached)
    mapped = apply_transform(averages, m, b).withColumnRenamed("i", "id")
    zero = F.array_repeat(F.lit(0.0), len(b))
    return target_vocabulary.select("id").join(mapped, "id", "left").select("id", F.coalesce("vec", zero).alias("vec"))


def _shared_contexts(cooc: DataFrame, vectors: DataFrame) -> DataFrame:
    """context_vectors over the entries whose column has a vector, sums included."""
    return _context_sums(cooc, vectors).select("i", F.transform("s", lambda x: x / F.col("known")).alias("vec"))

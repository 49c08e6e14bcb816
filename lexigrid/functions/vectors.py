"""Column expressions over vectors held as arrays of numbers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(x: Column, y: Column) -> Column:
    return _total(F.zip_with(doubles(x), doubles(y), lambda a, b: a * b))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """v over its length; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v))


def cosine(x: Column, y: Column) -> Column:
    """0 where either is a zero vector."""
    n = norm(x) * norm(y)
    return F.when(n > 0, dot(x, y) / n).otherwise(F.lit(0.0))


def pair_features(x: Column, y: Column) -> Column:
    """|x - y|, then x * y."""
    return F.concat(F.zip_with(doubles(x), doubles(y), lambda a, b: F.abs(a - b)), F.zip_with(doubles(x), doubles(y), lambda a, b: a * b))


def compose_mult(vectors: list[Column]) -> Column:
    """Elementwise product, times sqrt(d) for every vector after the first."""
    out = doubles(vectors[0])
    scale = F.sqrt(F.size(vectors[0]).cast("double"))
    for v in vectors[1:]:
        out = F.zip_with(out, doubles(v), lambda a, b: a * scale * b)
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _convolved(stack: pd.Series) -> pd.Series:
    if not len(stack):
        return stack
    whole = np.array([[np.asarray(v, dtype=np.float64) for v in vs] for vs in stack])
    return pd.Series(list(np.real(np.fft.ifft(np.fft.fft(whole, axis=2).prod(axis=1), axis=1))))


def compose_conv(vectors: list[Column]) -> Column:
    """Circular convolution, by fast Fourier transforms in Arrow batches."""
    return _convolved(F.array(*[doubles(v) for v in vectors]))


def random_vector(key: Column, dimension: int, kind: str | tuple[float, float] = "gaussian", seed: int = 0) -> Column:
    """A vector that depends on key and seed alone: gaussian N(0, 1/d), rademacher of 1/sqrt(d), or uniform in (low, high)."""
    draw = lambda k, salt: (F.pmod(F.xxhash64(key, k, F.lit(seed), F.lit(salt)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    at = F.sequence(F.lit(1), F.lit(dimension))
    if kind == "gaussian":
        return F.transform(at, lambda k: F.sqrt(-2.0 * F.log(draw(k, 0))) * F.cos(2.0 * math.pi * draw(k, 1)) / math.sqrt(dimension))
    if kind == "rademacher":
        return F.transform(at, lambda k: F.when(draw(k, 0) < 0.5, -1.0).otherwise(1.0) / math.sqrt(dimension))
    low, high = kind
    return F.transform(at, lambda k: F.lit(float(low)) + draw(k, 0) * float(high - low))


def nan_to_zero(v: Column) -> Column:
    """NaN to 0, infinities to the largest finite numbers."""
    big = 1.7976931348623157e308
    return F.transform(doubles(v), lambda x: F.when(F.isnan(x), 0.0).otherwise(F.greatest(F.lit(-big), F.least(F.lit(big), x))))

"""A registry of sentence encoders that run as iterator pandas functions, their model loaded once a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENCODERS: dict[str, Callable[..., Callable[[list[str]], np.ndarray]]] = {}


def register(name: str):
    """Decorate a loader: options -> function from texts to a matrix of one row a text."""

    def keep(loader):
        ENCODERS[name] = loader
        return loader

    return keep


@register("bow")
def bow(words: dict[str, list[float]], dimension: int, unit: bool = True):
    """Masked sum of word vectors, of length 1 if asked."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension))
        for k, t in enumerate(texts):
            for w in (t or "").lower().split():
                if w in words:
                    out[k] += words[w]
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1.0) if unit else out

    return encode


def encode(frame: DataFrame, name: str, text_col: str = "text", out: str = "vec", batch: int = 200, **options) -> DataFrame:
    """frame with the encoder's vector; NaN counts 0. Encoders whose weights are not at hand raise when first used."""
    if name not in ENCODERS:
        raise NotImplementedError(f"no encoder {name}: register a loader for its weights")
    loader = ENCODERS[name]

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loader(**options)
        for s in parts:
            rows = [np.nan_to_num(model(list(s.iloc[k : k + batch]))) for k in range(0, len(s), batch)]
            yield pd.Series([list(map(float, r)) for block in rows for r in block], dtype=object)

    return frame.withColumn(out, run(F.col(text_col)))

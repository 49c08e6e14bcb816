"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's subwords are its letter pairs and triples (case folded, everything that
is not a letter is a blank), hashed into buckets with an embedding each. The mean
embedding goes through a linear layer and a softmax. Stochastic gradient descent
in numpy fits embeddings and layer on a bounded sample of labelled rows; part of
the sample is set aside to fit the softmax temperature and the rejection bar.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrid.llm.common import col, free_name

BUCKETS = 1 << 15
DIM = 16
TRAIN_ROWS = 2000
UNDETERMINED = "und"
_GROUP_CHARS = 250_000
_BLANK = "    "


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def subwords(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each subword, where each text's subwords start, how many letters each text has)."""
    lowered = [_BLANK + t.lower() for t in texts]
    start = np.cumsum([0] + [len(t) for t in lowered])
    code = np.frombuffer(("".join(lowered) + _BLANK).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letters()[code]
    before = np.concatenate([[0], np.cumsum(letter)])
    count = before[start[1:]] - before[start[:-1]]
    code = np.where(letter, code, np.uint32(32))
    shift = np.uint32(32 - buckets.bit_length() + 1)
    with np.errstate(over="ignore"):
        mixed = code * np.uint32(0x9E3779B1)
        pair = (mixed[:-1] ^ (mixed[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + code[1:]
        triple = (pair[:-1] ^ (pair[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE35) + code[2:] + np.uint32(0x27D4EB2F)
        pair = (pair * np.uint32(0x9E3779B1)) >> shift
        triple = (triple * np.uint32(0x9E3779B1)) >> shift
    at = np.arange(len(code), dtype=np.int64)
    two = (letter[:-1] | letter[1:]).nonzero()[0]
    three = letter[1:-1].nonzero()[0]
    where = np.concatenate([at[two], at[three]])
    order = np.argsort(where, kind="stable")
    return np.concatenate([pair[two], triple[three]])[order].astype(np.int64), np.searchsorted(where[order], start[:-1]), count


@dataclass
class LanguageModel:
    labels: list[str]
    table: np.ndarray  # buckets x labels: embedding times layer, so that a text's logits are a mean of rows
    bias: np.ndarray
    temperature: float
    bar: float  # a lower score is rejected

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Logits, and whether a text has letters. Long batches go in groups, so memory follows the longest text."""
        out, seen, k = np.zeros((len(texts), len(self.labels))), np.zeros(len(texts), dtype=bool), 0
        while k < len(texts):
            end, size = k, 0
            while end < len(texts) and (end == k or size + len(texts[end]) <= _GROUP_CHARS):
                size += len(texts[end])
                end += 1
            bucket, start, letters = subwords(texts[k:end], len(self.table))
            size = np.diff(np.append(start, len(bucket)))
            full = size > 0
            if full.any():
                for c in range(len(self.labels)):
                    total = np.add.reduceat(self.table[:, c][bucket], start[full])
                    out[k:end, c][full] = total / size[full]
            out[k:end] += self.bias
            seen[k:end] = letters > 0
            k = end
        return out, seen

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Label and calibrated probability of each text; `und` and 0 where it is null or has no letter."""
        if not self.labels:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        logits, seen = self.logits([t or "" for t in texts])
        p = _softmax(logits / self.temperature)
        best = p.argmax(axis=1)
        return [self.labels[b] if s else UNDETERMINED for b, s in zip(best, seen)], np.where(seen, p[np.arange(len(p)), best], 0.0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(samples: list[tuple[str, np.ndarray, np.ndarray]], buckets: int = BUCKETS, dim: int = DIM, epochs: int = 12, rate: float = 4.0, tolerance: float = 0.0005, seed: int = 7) -> LanguageModel:
    """From (label, distinct buckets, counts) of each sample. Every fifth sample is for calibration only.

    tolerance: the share of calibration samples that may fall below the bar,
    which never exceeds one half.
    """
    labels = sorted({s[0] for s in samples})
    if not labels:
        return LanguageModel([], np.zeros((buckets, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 1 / dim, (buckets, dim))
    layer, bias = np.zeros((dim, len(labels))), np.zeros(len(labels))
    samples = [s for s in samples if len(s[1])]
    held, train = samples[4::5], [s for k, s in enumerate(samples) if k % 5 != 4]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in rng.permutation(len(train)):
            label, bucket, count = train[k]
            w = count / count.sum()
            mean = w @ emb[bucket]
            p = _softmax((mean @ layer + bias)[None])[0]
            p[labels.index(label)] -= 1
            back = layer @ p
            layer -= 0.1 * step * np.outer(mean, p)
            bias -= 0.01 * step * p
            emb[bucket] -= step * w[:, None] * back
    model = LanguageModel(labels, (emb @ layer).astype(np.float32), bias, 1.0, 0.0)
    judged = held or train
    if judged:
        z = np.array([(c / c.sum()) @ model.table[b] + bias for _, b, c in judged])
        y = np.array([labels.index(s[0]) for s in judged])
        loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
        best = _softmax(z / model.temperature).max(axis=1)
        model.bar = float(min(0.5, np.quantile(best, tolerance)))
    return model


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", max_rows: int = TRAIN_ROWS, buckets: int = BUCKETS, **options) -> LanguageModel:
    """Fit on max_rows rows of `labelled` at most, those with the least hashed identifiers; rows without label or text are left out.

    The sample is bounded by max_rows whatever the size of the table. Texts are
    turned into bucket counts (buckets at most a row) on the executors; the driver
    gets 8 bytes for each, half a GB if 2000 rows had texts with all 32,768
    buckets. Rows with a null identifier go by their texts. Of rows with one hash
    the least label and text counts. An empty table gives a model without labels.
    """
    usable = labelled.where(col(label_col).isNotNull() & col(text_col).isNotNull())
    order = F.when(col(id_col).isNotNull(), F.xxhash64(col(id_col), F.lit("language sample"))).otherwise(F.xxhash64(col(text_col), F.lit("language sample")))
    least = [r[0] for r in usable.select(order.alias("h")).orderBy("h").limit(max_rows).collect()]
    if not least:
        return fit([], buckets, **options)

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            rows = ([], [], [], [])
            for h, label, text in zip(*(c.to_pylist() for c in batch.columns)):
                bucket, n = np.unique(subwords([text], buckets)[0], return_counts=True)
                for held, x in zip(rows, (h, label, bucket.astype("<i4").tobytes(), n.astype("<i4").tobytes())):
                    held.append(x)
            yield pa.record_batch([pa.array(c, type=t) for c, t in zip(rows, (pa.int64(), pa.string(), pa.binary(), pa.binary()))], names=["h", "label", "bucket", "n"])

    chosen = usable.where(order <= F.lit(least[-1])).select(order.alias("h"), col(label_col).cast("string").alias("label"), col(text_col).cast("string").alias("text"))
    got = chosen.mapInArrow(count, "h long, label string, bucket binary, n binary").groupBy("h").agg(F.min(F.struct("label", "bucket", "n")).alias("s")).select("h", "s.label", "s.bucket", "s.n").collect()
    rows = sorted((r["h"], r["label"], bytes(r["bucket"]), bytes(r["n"])) for r in got)
    return fit([(lab, np.frombuffer(b, "<i4").astype(np.int64), np.frombuffer(n, "<i4").astype(np.float64)) for _, lab, b, n in rows], buckets, **options)


def identify(df: DataFrame, model: LanguageModel, text_col: str = "text", label: str = "lang_pred", score: str = "score", rejected: str = "rejected") -> DataFrame:
    """df with label string, score double and rejected boolean added.

    Only the text is looked at, all of it. A text that is null or has no letter
    gets `und`, score 0, and is rejected, as is one whose score is below the
    model's bar. A model fitted on no sample gives `und` for all.
    """
    taken = {c.lower() for c in df.columns} & {c.lower() for c in (label, score, rejected)}
    if taken:
        raise ValueError(f"df already has columns {sorted(taken)}")
    sent = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            names, p = sent.value.predict(batch.column(at).to_pylist())
            bad = [n == UNDETERMINED or s < sent.value.bar for n, s in zip(names, p)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, type=pa.string()), pa.array(p, type=pa.float64()), pa.array(bad, type=pa.bool_())], names=[*batch.schema.names, label, score, rejected])

    schema = T.StructType([*df.schema.fields, T.StructField(label, T.StringType()), T.StructField(score, T.DoubleType()), T.StructField(rejected, T.BooleanType())])
    return df.mapInArrow(run, schema)


def keep_identified(df: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of df that the model does not reject, with the columns of df, whatever their names. Null texts and those without a letter go; repeated rows are judged alike; an empty table gives no rows."""
    names = [free_name(df, s) for s in ("_language", "_score", "_rejected")]
    return identify(df, model, text_col, *names).where(~F.col(names[2])).select(*[col(c) for c in df.columns])


def may_train(id_col: str = "doc_id"):
    """Rows outside the held-out fold: crc32 of the identifier as text, modulo 4, is not 2."""
    return F.coalesce(F.pmod(F.crc32(col(id_col).cast("string").cast("binary")), F.lit(4)) != 2, F.lit(True))

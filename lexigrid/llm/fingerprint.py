"""Canonical exact fingerprints: equal after Unicode, case and white-space folding.

A text is normalised to NFKC, case folded, normalised again, and its white space
folded to single blanks. The 128-bit xxHash of the result groups texts; where
two rows have one hash their canonical bytes are compared, and different texts
in one bucket get different suffixes.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.llm.common import DigestFilter, col, settle


def canonical(text: str | None) -> str:
    if not text:
        return ""
    if text.isascii():
        return " ".join(text.lower().split())
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()).split())


def wide_hash(canon: str, width: int = 16) -> bytes:
    """xxh3-128 of the UTF-8 bytes; width below 16 exists to force collisions in tests."""
    import xxhash

    return xxhash.xxh3_128_digest(canon.encode("utf-8", "surrogatepass"))[:width].ljust(8, b"\0")


def _hashed(df: DataFrame, id_col: str, text_col: str, width: int, keep: DigestFilter | None = None) -> DataFrame:
    """id, digest binary; with `keep` only rows that pass it, and their canonical text."""
    sent = df.sparkSession.sparkContext.broadcast(keep) if keep is not None else None

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0)
            canon = [canonical(t) for t in batch.column(1).to_pylist()]
            own = [wide_hash(c, width) for c in canon]
            if sent is None:
                yield pa.record_batch([ids, pa.array(own, type=pa.binary())], names=["id", "digest"])
            elif (hit := sent.value.hits(own)).any():
                at = hit.nonzero()[0]
                yield pa.record_batch([ids.take(pa.array(at)), pa.array([own[k] for k in at], type=pa.binary()), pa.array([canon[k] for k in at], type=pa.string())], names=["id", "digest", "canon"])

    schema = "id long, digest binary" + (", canon string" if keep is not None else "")
    return df.select(col(id_col).cast("long"), col(text_col).cast("string")).mapInArrow(run, schema)


def suffixes(texts: DataFrame, by: str) -> DataFrame | None:
    """digest, `by`, suffix long of the distinct rows (digest, by) whose digest goes with several of `by`, which tells texts apart; None if there are none."""
    several = settle(texts.groupBy("digest").agg(F.min(by).alias("least"), F.max(by).alias("most")).where("least <> most").select("digest"))
    if several.isEmpty():
        return None
    rank = F.row_number().over(Window.partitionBy("digest").orderBy(by)) - 1
    return settle(texts.join(several, "digest").select("digest", by).distinct().select("digest", by, rank.cast("long").alias("suffix")))


def suffix_text(suffix):
    return F.when(suffix > 0, F.concat(F.lit("-"), suffix)).otherwise(F.lit(""))


def collisions(df: DataFrame, digests: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 16) -> DataFrame | None:
    """digest, canon, suffix of the different canonical texts that share a digest; None if no two do.

    digests: one row of `digest` for each row of df. Only texts whose digest
    another row has leave their partition, equal ones combined first.
    """
    shared = digests.groupBy("digest").count().where("count > 1")
    hits = _hashed(df, id_col, text_col, width, DigestFilter.build(shared, "digest"))
    return suffixes(hits.select("digest", "canon").distinct(), "canon")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 16) -> DataFrame:
    """One row for each row of df: doc_id, fingerprint string.

    32 hexadecimal digits, and -1, -2, ... where different canonical texts share
    them. Null and empty texts, and those of white space, have one fingerprint.
    Texts of any length count whole. Repeated rows and null identifiers keep
    their rows; other columns are not read; an empty table gives no rows.
    """
    digests = settle(_hashed(df, id_col, text_col, width))
    clash = collisions(df, digests, id_col, text_col, width)
    plain = F.lower(F.hex("digest"))
    if clash is None:
        return digests.select(F.col("id").alias("doc_id"), plain.alias("fingerprint"))
    whole = _hashed(df, id_col, text_col, width, _Everything())
    return whole.join(clash, ["digest", "canon"], "left").select(F.col("id").alias("doc_id"), F.concat(plain, suffix_text(F.col("suffix"))).alias("fingerprint"))


class _Everything(DigestFilter):
    def __init__(self):
        pass

    def hits(self, digests):
        import numpy as np

        return np.ones(len(digests), dtype=bool)

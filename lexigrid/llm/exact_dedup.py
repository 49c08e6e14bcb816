"""Exact deduplication with a log-structured merge index of text digests.

Each task keeps a memtable of digests and flushes it, when full, as a sorted
run in which a digest occurs once. The shuffle merges the runs of a digest
range; compaction keeps one identifier and the row count of each digest. The
digests of two or more rows ("hits") go into a filter sized by them. A second
scan sends only rows that pass the filter, and their texts are compared byte by
byte. Rows the filter rules out are unique and never move.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import DigestFilter, col, free_name, settle, shuffle_partitions

MEMTABLE_ROWS = 200_000
LOWEST = -(1 << 63)


def text_digest(raw: bytes | None, width: int = 32) -> bytes:
    """SHA-256 of the UTF-8 bytes; width below 32 exists to force collisions in tests. Null counts as empty."""
    own = hashlib.sha256(raw or b"").digest()
    return own if width >= 32 else own[:width].ljust(8, b"\0")


class Memtable:
    """digest -> [kept identifier, rows]; a full table leaves as one sorted run."""

    def __init__(self, limit: int, largest: bool):
        self.limit, self.largest, self.held = limit, largest, {}

    def add(self, digest: bytes, ident: int, rows: int = 1) -> bool:
        old = self.held.get(digest)
        if old is None:
            self.held[digest] = [ident, rows]
        else:
            old[0] = max(old[0], ident) if self.largest else min(old[0], ident)
            old[1] += rows
        return len(self.held) >= self.limit

    def flush(self) -> list[tuple[bytes, int, int]]:
        run = sorted((d, i, n) for d, (i, n) in self.held.items())
        self.held = {}
        return run


def compact(stream, largest: bool):
    """Merge (digest, identifier, rows) that arrive sorted by digest: one entry a digest."""
    last = None
    for digest, ident, rows in stream:
        if last is not None and last[0] == digest:
            last[1] = max(last[1], ident) if largest else min(last[1], ident)
            last[2] += rows
        else:
            if last is not None:
                yield tuple(last)
            last = [digest, ident, rows]
    if last is not None:
        yield tuple(last)


def _batches(entries, names, size: int = 50_000):
    import pyarrow as pa

    types = [pa.binary(), pa.int64(), pa.int64()]
    held = []
    for e in entries:
        held.append(e)
        if len(held) >= size:
            yield pa.record_batch([pa.array(c, type=t) for c, t in zip(zip(*held), types)], names=names)
            held = []
    if held:
        yield pa.record_batch([pa.array(c, type=t) for c, t in zip(zip(*held), types)], names=names)


def merge_index(df: DataFrame, id_col: str, text_col: str, keep: str = "smallest", digest_bytes: int = 32, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """The compacted index: digest binary, keep_id long, n long (rows). A null identifier counts as the lowest long."""
    largest = _largest(keep)
    names = ["digest", "keep_id", "n"]

    def flush_runs(batches):
        table = Memtable(memtable_rows, largest)

        def entries():
            for batch in batches:
                for ident, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if table.add(text_digest(raw, digest_bytes), LOWEST if ident is None else ident):
                        yield from table.flush()
            yield from table.flush()

        yield from _batches(entries(), names)

    def merge_runs(batches):
        rows = ((d, i, n) for b in batches for d, i, n in zip(*(b.column(k).to_pylist() for k in range(3))))
        yield from _batches(compact(rows, largest), names)

    schema = "digest binary, keep_id long, n long"
    runs = df.select(col(id_col).cast("long"), col(text_col).cast("binary")).mapInArrow(flush_runs, schema)
    return runs.repartition(shuffle_partitions(df.sparkSession), "digest").sortWithinPartitions("digest").mapInArrow(merge_runs, schema)


def _largest(keep: str) -> bool:
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    return keep == "largest"


def _probed(df: DataFrame, text_col: str, index_filter: DigestFilter, digest_bytes: int, digest: str, hit: str) -> DataFrame:
    """df with the digest of its text, and whether other rows may have that digest."""
    from pyspark.sql import types as T

    sent = df.sparkSession.sparkContext.broadcast(index_filter)
    at = df.columns.index(text_col)

    def probe(batches):
        import pyarrow as pa

        for batch in batches:
            own = [text_digest(raw, digest_bytes) for raw in batch.column(at).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, type=pa.binary()), pa.array(sent.value.hits(own))], names=[*batch.schema.names, digest, hit])

    schema = T.StructType([*df.schema.fields, T.StructField(digest, T.BinaryType()), T.StructField(hit, T.BooleanType())])
    return df.mapInArrow(probe, schema)


def _hit_filter(df: DataFrame, id_col: str, text_col: str, keep: str, digest_bytes: int, memtable_rows: int) -> DigestFilter:
    return DigestFilter.build(merge_index(df, id_col, text_col, keep, digest_bytes, memtable_rows).where("n > 1"), "digest")


def duplicate_labels(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest_bytes: int = 32, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """One row for each row of df: <id_col>, keep_id, group_size long, kept boolean, text_sha256.

    Texts are equal when their bytes are; a null text counts as empty. Of a
    group the row with the smallest (or largest) identifier stays. A null
    identifier is the lowest of all, and keep_id is null where it stays. Rows
    repeated with the same identifier and text get the same label. An empty
    table gives no rows. Other columns of df are not read.
    """
    largest = _largest(keep)
    own = df.select(col(id_col).cast("long").alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    hits = _probed(own, "text", _hit_filter(own, "id", "text", keep, digest_bytes, memtable_rows), digest_bytes, "digest", "hit").where("hit")
    best = (F.max if largest else F.min)(F.coalesce("id", F.lit(LOWEST)))
    texts = hits.groupBy("digest", "text").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("n"))
    groups = settle(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("variants"), F.first("keep_id").alias("keep_id"), F.first("n").alias("n")).where("n > 1 or variants > 1"))
    sha = F.sha2(F.col("text").cast("binary"), 256)
    if groups.where("variants > 1").isEmpty():
        digest = F.unhex("text_sha256")
        if digest_bytes < 32:
            digest = F.rpad(F.substring(digest, 1, digest_bytes), 8, F.lit(b"\0"))
        members = own.select("id", sha.alias("text_sha256")).withColumn("digest", digest)
        joined = members.join(groups.select("digest", "keep_id", "n"), "digest", "left")
    else:  # different texts share a digest: the bytes decide
        joined = own.join(texts, "text", "left").withColumn("text_sha256", sha)
    kept_id = F.coalesce("keep_id", "id")
    return joined.select(
        F.col("id").alias(id_col),
        F.when(kept_id != LOWEST, kept_id).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.coalesce("id", F.lit(LOWEST)) == F.coalesce(kept_id, F.lit(LOWEST))).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest_bytes: int = 32, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """The rows of df that stay, with all their columns; of rows that tie in text and identifier one stays. Null texts count as empty."""
    digest, hit, row = (free_name(df, s) for s in ("_digest", "_hit", "_row"))
    probed = _probed(df, text_col, _hit_filter(df, id_col, text_col, keep, digest_bytes, memtable_rows), digest_bytes, digest, hit)
    single = probed.where(~F.col(hit)).select(*[col(c) for c in df.columns])
    by = F.max_by if _largest(keep) else F.min_by
    some = probed.where(F.col(hit)).groupBy(F.col(digest), F.coalesce(col(text_col), F.lit("")).alias(free_name(df, "_bytes")))
    chosen = some.agg(by(F.struct(*[col(c) for c in df.columns]), F.coalesce(col(id_col), F.lit(LOWEST))).alias(row))
    return single.unionByName(chosen.select(*[F.col(row).getField(c).alias(c) for c in df.columns]))

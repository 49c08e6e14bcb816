"""Near-duplicates by SimHash fingerprints at a Hamming distance of at most 4 in 64 bits.

Candidates come from fuzzy keys of the binary Golay code (23, 12, 7). It is
perfect: every 23-bit word lies within 3 bits of one codeword. Decode a word and
its one-bit neighbours, and two words that differ in at most 2 bits share a
codeword index (of a word between them). A fingerprint is split into segments of
21, 21 and 22 bits. With at most 4 differing bits

* some segment is equal, and of the other two one differs in at most 2 bits: key
  (equal segment, codeword index of another segment), 33 or 34 bits; or
* all three differ; then two of them differ in one bit each, so each of these has
  an equal half, and the third differs in at most 2 bits: key (codeword index of
  the third, a half of each of the others), 33 or 34 bits.

So no link is missed. Distinct fingerprints meet at their shared keys, are
verified there, and leave a spanning forest of the links of each key, never all
its pairs. Components come from alternating large-star and small-star steps.
"""

from __future__ import annotations

from functools import cache
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import col, settle, shuffle_partitions

DISTANCE = 4
SEGMENTS = ((0, 21), (21, 21), (42, 22))
SHINGLE = 4
SEED = 42
LOWEST = -(1 << 63)


@cache
def golay_index() -> np.ndarray:
    """For each 23-bit word the 12-bit index of the codeword within 3 bits of it."""
    generator = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
    words = np.zeros(1, dtype=np.uint32)
    for k in range(12):
        words = np.concatenate([words, words ^ np.uint32(generator << k)])
    one = np.uint32(1) << np.arange(23, dtype=np.uint32)
    errors = [np.zeros(1, dtype=np.uint32), one]
    a, b = np.triu_indices(23, 1)
    errors.append(one[a] ^ one[b])
    errors.append(np.array([one[i] ^ one[j] ^ one[k] for i in range(23) for j in range(i) for k in range(j)], dtype=np.uint32))
    out = np.full(1 << 23, 0xFFFF, dtype=np.uint16)
    index = np.arange(4096, dtype=np.uint16)
    for e in np.concatenate(errors):
        out[words ^ e] = index
    return out


def near_indices(segment: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword index) of each word and its one-bit neighbours, each pair once."""
    flips = np.concatenate([np.zeros(1, dtype=np.uint32), np.uint32(1) << np.arange(bits, dtype=np.uint32)])
    got = np.sort(golay_index()[segment[:, None] ^ flips[None, :]], axis=1)
    fresh = np.ones(got.shape, dtype=bool)
    fresh[:, 1:] = got[:, 1:] != got[:, :-1]
    return np.nonzero(fresh)[0], got[fresh].astype(np.uint64)


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for uint64 fingerprints."""
    part = [((prints >> np.uint64(at)) & np.uint64((1 << n) - 1)) for at, n in SEGMENTS]
    rows, keys = [], []
    kind = 0
    for fuzzy in range(3):
        row, index = near_indices(part[fuzzy].astype(np.uint32), SEGMENTS[fuzzy][1])
        others = [k for k in range(3) if k != fuzzy]
        for k in others:
            rows.append(row)
            keys.append(np.uint64(kind << 40) | (index << np.uint64(22)) | part[k][row])
            kind += 1
        a, b = others
        for half_a in (0, 1):
            for half_b in (0, 1):
                x, y = (((part[k] >> np.uint64(11 * half)) & np.uint64(0x7FF))[row] for k, half in ((a, half_a), (b, half_b)))
                rows.append(row)
                keys.append(np.uint64(kind << 40) | (index << np.uint64(22)) | (x << np.uint64(11)) | y)
                kind += 1
    return np.concatenate(rows), np.concatenate(keys)


def simhash(raw: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text in UTF-8; no words (or null) give 0."""
    import xxhash

    words = (raw or b"").lower().split()  # of bytes: A-Z, and \x20 \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        return digest(joined, seed)
    ends = list(accumulate([len(w) + 1 for w in words]))
    starts = [0, *ends[: n - 1]]
    hashes = np.array([digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[shingle - 1 :])], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def spanning_links(prints: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints that share a key."""
    left, out = prints, []
    while len(left) > 1:
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            p = stack.pop()
            near = np.bitwise_count(left ^ p) <= distance
            if near.any():
                found = left[near]
                out += [(int(p), int(q)) for q in found]
                stack += list(found)
                left = left[~near]
    return out


def text_digest(text_col: str) -> Column:
    """16 bytes that tell texts apart; null counts as empty, as it does for fingerprints."""
    return F.unhex(F.md5(F.coalesce(col(text_col).cast("binary"), F.lit(b""))))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id long, fp long (the fingerprint's bits as a signed number), digest binary, one row for each row of df."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            own = np.array([simhash(raw, shingle, seed) for raw in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(own.view(np.int64)), batch.column(2)], names=["doc_id", "fp", "digest"])

    return df.select(col(id_col).cast("long"), col(text_col).cast("binary"), text_digest(text_col)).mapInArrow(run, "doc_id long, fp long, digest binary")


def near_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) among distinct fingerprints `fp` long: a spanning forest of all links, with some links more than once."""

    def emit(batches):
        import pyarrow as pa

        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(prints), 2000):
                own = prints[at : at + 2000]
                row, key = fuzzy_keys(own)
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(own[row].view(np.int64))], names=["key", "fp"])

    def meet(batches):
        import pyarrow as pa

        found: set[tuple[int, int]] = set()
        held_key, held = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)

        def out():
            a, b = zip(*found)
            both = np.array([a, b], dtype=np.uint64).view(np.int64)
            found.clear()
            return pa.record_batch([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

        def groups(key, prints):
            cut = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1, [len(key)]])
            size = np.diff(cut)
            two = cut[:-1][size == 2]
            x, y = prints[two], prints[two + 1]
            near = np.bitwise_count(x ^ y) <= DISTANCE
            found.update(zip(x[near].tolist(), y[near].tolist()))
            for k in np.nonzero(size > 2)[0]:
                found.update(spanning_links(np.sort(prints[cut[k] : cut[k + 1]])))

        for batch in batches:
            key = np.concatenate([held_key, batch.column(0).to_numpy(zero_copy_only=False)])
            prints = np.concatenate([held, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            if last:
                groups(key[:last], prints[:last])
            held_key, held = key[last:], prints[last:]
            if len(found) > 200_000:
                yield out()
        if len(held_key):
            groups(held_key, held)
        if found:
            yield out()

    parts = shuffle_partitions(distinct.sparkSession)
    keyed = distinct.select("fp").mapInArrow(emit, "key long, fp long")
    return keyed.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(meet, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, root: every node of links (a, b) with the least node of its component. Nodes without links have no row."""
    edges = settle(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = None
    while True:
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = tuple(seen)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.greatest("b", "m").alias("x"), F.least("b", "m").alias("y"), "a", "m")
        moved = small.where("x > y").select(F.col("x").alias("a"), F.col("y").alias("b"))
        edges = settle(moved.unionByName(small.select("a", F.col("m").alias("b"))).distinct())


def label_members(prints: DataFrame, distinct: DataFrame, member: DataFrame) -> DataFrame:
    """prints (doc_id, fp, digest) with component_id and root (a fingerprint that names the component).

    distinct: fp, first_id (the least identifier, null counting as the lowest
    long). member: node, root, as components() has them.
    """
    rooted = distinct.join(member.withColumnRenamed("node", "fp"), "fp", "inner")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component"))
    named = rooted.join(least, "root").select("fp", "component", "root")
    whole = distinct.join(named, "fp", "left").select("fp", F.coalesce("component", "first_id").alias("component"), F.coalesce("root", "fp").alias("root"))
    return prints.join(whole, "fp").select("doc_id", "fp", F.when(F.col("component") != LOWEST, F.col("component")).alias("component_id"), "digest", "root")


def keep_least(df: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of df, with all their columns, that are the least of their component in labels, by identifier, then text; of rows equal in both one stays.

    Components are told apart by root, not by identifier: unlike texts with null
    or repeated identifiers each stay.
    """
    lowest = F.lit(LOWEST)
    least = labels.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = least.select(F.coalesce("doc_id", lowest).alias("_kept"), F.col("digest").alias("_digest"), F.col("root").alias("_root")).distinct()
    rows = df.select(F.coalesce(col(id_col).cast("long"), lowest).alias("_kept"), text_digest(text_col).alias("_digest"), F.coalesce(col(text_col), F.lit("")).alias("_text"), F.struct(*[col(c) for c in df.columns]).alias("_row"))
    ones = rows.join(kept, ["_kept", "_digest"]).groupBy("_root").agg(F.min_by("_row", "_text").alias("_row"))
    return ones.select(*[F.col("_row").getField(c).alias(c) for c in df.columns])


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row for each row of df: doc_id, fp long, component_id (the least identifier that links lead to).

    Texts without words, null ones included, have fingerprint 0 and link like
    any other. A null identifier counts as the lowest long while components are
    formed, and component_id is null where it is the least. Rows repeated with
    one identifier each get a row. Other columns are not read. An empty table
    gives no rows.
    """
    return near_labels(df, id_col, text_col, shingle, seed).select("doc_id", "fp", "component_id")


def near_labels(df: DataFrame, id_col: str, text_col: str, shingle: int, seed: int) -> DataFrame:
    """near_duplicates() with digest and root, as label_members() has them."""
    prints = settle(fingerprints(df, id_col, text_col, shingle, seed))
    distinct = settle(prints.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(LOWEST))).alias("first_id")))
    return label_members(prints, distinct, settle(components(near_links(distinct))))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """The rows of df, with all their columns, of the least document of each component, by identifier (null first), then text; of rows equal in both one stays. An empty table gives no rows."""
    return keep_least(df, near_labels(df, id_col, text_col, shingle, seed), id_col, text_col)

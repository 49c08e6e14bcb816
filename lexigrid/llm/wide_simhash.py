"""Near-duplicates by similarity: wide SimHash fingerprints, found by keys of decoded Golay segments and MinHash bands, verified on shingles.

Four bits of 64, which simhash.py searches exactly, are a Jaccard similarity of
about 0.97. At 0.8, shingle sets as different as that give SimHash bits that
differ in one place of seven, too many for one pigeonhole argument. So

* the fingerprint that is compared first has 256 bits, of the set of a text's
  shingles; pairs within allowed_distance() bits are candidates;
* the one that is searched by is of its set of word pairs, which edits change
  less. It has SEGMENTS segments of 23 bits. Of each, the bits with the narrowest
  majority are the likeliest to differ; the segment and what flipping WEAK of them
  gives are decoded to indices of the Golay code's nearest codewords. A key is a
  pair of segments with an index of each; texts that share one are compared;
* edits in one place change word pairs as much as longer runs. So the shingle set
  itself gives BANDS more keys, each of BAND_ROWS least hashes (MinHash): at a
  Jaccard similarity of 0.8 sets share one with a chance of 0.998, whatever was
  edited;
* candidates are joined with their shingle sets, and the Jaccard similarity of
  the sets decides.

Texts of a key that pairs in reach join are a cluster. Of one with up to ALL_PAIRS
texts every pair in reach is a candidate; of larger ones the edges of the tree of
least distances are tried first, and marked as open. Where these leave texts of a
cluster apart, it is dealt as pairs of blocks, and open_links() verifies every
pair in reach that no verified links join yet. A key's texts come sorted by
fingerprint and no task holds more than TREE_BLOCK of them; of a key with more, the
clusters of each block are tied to one hub, so that all go on to that step
together. So no pair of a key in reach is left out. The bands' keys meet first.
Texts of clusters that these leave open carry a label of what open pairs join, and
all pairs of it in reach are verified in any case; so the other keys, ten times as
many, give no pairs of one label, and a large group not a tree for each key. Whether
two texts meet is a matter of chance; at a similarity of 0.8 it is the reach of the fingerprint that
loses most, 1 in 100 (README: measured recall).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import col, release, settle, shuffle_partitions, tidy
from lexigrid.llm.simhash import LOWEST, components, golay_index, keep_least, label_members, text_digest

LANES = 4
SEGMENTS = 5
SEGMENT_BITS = 23
WEAK = 2
BANDS, BAND_ROWS = 16, 5
SEARCH_SHINGLE = 2
SHINGLE = 5
SIMILARITY = 0.8
ALL_PAIRS = 8
TREE_BLOCK = 4096
SAMPLE = 64
BLOCK = 256
NO_LABEL = -1
_KEEP = 50_000
#: Pairs of segments.
_LEFT, _RIGHT = np.triu_indices(SEGMENTS, 1)


def allowed_distance(similarity: float = SIMILARITY, bits: int = 64 * LANES, spread: float = 2.3) -> int:
    """Bits by which candidates may differ: the mean for sets of that Jaccard similarity and equal size, and `spread` standard deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * p + spread * math.sqrt(bits * p * (1 - p)))


def _mix(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of the runs of k words, given the words' hashes; of the whole if there are fewer."""
    k = min(k, len(words))
    n = len(words) - k + 1
    out = words[:n].copy()
    for j in range(1, k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += words[j : j + n]
    out.sort()
    fresh = np.ones(n, dtype=bool)
    np.not_equal(out[1:], out[:-1], out=fresh[1:])
    return out[fresh]


def majorities(hashes: np.ndarray, lanes: range) -> np.ndarray:
    """For each bit of the lanes: how many more hashes have it set than not."""
    salt = _mix(np.array(lanes, dtype=np.uint64) + np.uint64(1))
    ones = np.zeros(64 * len(lanes), dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        z = _mix(hashes[at : at + (1 << 14), None] ^ salt)
        bits = np.unpackbits(z.view(np.uint8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # a byte holds sums of 255 bits
            ones += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return 2 * ones - len(hashes)


_TIMES, _PLUS = _mix(np.arange(1, 2 * BANDS * BAND_ROWS + 1, dtype=np.uint64) << np.uint64(32)).reshape(2, -1) | np.uint64(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys below 0, int64, of a set of hashes: of the least values of BAND_ROWS functions each."""
    least = np.full(BANDS * BAND_ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), 1 << 11):
        np.minimum(least, (_mix(hashes[at : at + (1 << 11), None]) * _TIMES + _PLUS).min(axis=0), out=least)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for own in least.reshape(BANDS, BAND_ROWS).T:
        out = _mix(out ^ own)
    return (out | np.uint64(1 << 63)).view(np.int64)


class Sketcher:
    """Texts in UTF-8 to fingerprints and the codeword indices that they are searched by."""

    def __init__(self, shingle: int = SHINGLE):
        self.shingle = shingle
        self.golay = golay_index()
        self.known: dict[bytes, int] = {}
        self.place = np.uint32(1) << np.arange(SEGMENT_BITS, dtype=np.uint32)

    def _hash(self, word: bytes) -> int:
        import xxhash

        if len(self.known) >= _KEEP:
            self.known.clear()
        own = self.known[word] = xxhash.xxh64_intdigest(word)
        return own

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        return np.array([known.get(w) or self._hash(w) for w in words], dtype=np.uint64)

    def shingles(self, raw: bytes | None) -> np.ndarray:
        """Distinct hashes of a text's shingles, sorted; none without words."""
        words = (raw or b"").lower().split()
        return shingle_set(self._hashes(words), self.shingle) if words else np.zeros(0, dtype=np.uint64)

    def sketch(self, raw: bytes | None) -> tuple[bytes, bytes]:
        """(fingerprint of 8 * LANES bytes, SEGMENTS * 2^WEAK indices of 16 bits). Without words all are zero."""
        return self.sketch_bands(raw)[:2]

    def sketch_bands(self, raw: bytes | None) -> tuple[bytes, bytes, bytes]:
        """sketch() and the BANDS keys of 64 bits."""
        words = (raw or b"").lower().split()
        if not words:
            return bytes(8 * LANES), bytes(2 * SEGMENTS << WEAK), band_keys(np.zeros(0, dtype=np.uint64)).astype("<i8").tobytes()
        hashed = self._hashes(words)
        runs = shingle_set(hashed, self.shingle)
        fp = np.packbits(majorities(runs, range(LANES)) > 0, bitorder="little").tobytes()
        lead = majorities(shingle_set(hashed, SEARCH_SHINGLE), range(LANES, LANES + -(-SEGMENTS * SEGMENT_BITS // 64)))
        lead = lead[: SEGMENTS * SEGMENT_BITS].reshape(SEGMENTS, SEGMENT_BITS)
        near = ((lead > 0) * self.place).sum(axis=1, dtype=np.uint32)[:, None]
        weak = self.place[np.argsort(np.abs(lead), axis=1, kind="stable")[:, :WEAK]]
        for k in range(WEAK):
            near = np.concatenate([near, near ^ weak[:, k : k + 1]], axis=1)
        return fp, self.golay[near].astype("<u2").tobytes(), band_keys(runs).astype("<i8").tobytes()


def search_keys(indices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of indices of shape (rows, SEGMENTS, 2^WEAK), each pair once."""
    wide = indices.astype(np.int64)
    pair = np.arange(len(_LEFT), dtype=np.int64)[None, :, None, None] << 24
    keys = (pair | wide[:, _LEFT, :, None] << 12 | wide[:, _RIGHT, None, :]).reshape(len(wide), -1)
    keys.sort(axis=1)
    fresh = np.ones(keys.shape, dtype=bool)
    fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return np.nonzero(fresh)[0], keys[fresh]


def least_tree(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """The edges up to `distance` of a tree of least total distance (Prim, 1957)."""
    best = np.bitwise_count(prints ^ prints[0]).sum(axis=1, dtype=np.int64)
    via, far, out = np.zeros(len(prints), dtype=np.int64), 64 * LANES + 1, []
    done = np.zeros(len(prints), dtype=bool)
    done[0], best[0] = True, far
    for _ in range(len(prints) - 1):
        at = int(best.argmin())
        if best[at] <= distance:
            out.append((int(via[at]), at))
        done[at] = True
        own = np.bitwise_count(prints ^ prints[at]).sum(axis=1, dtype=np.int64)
        nearer = (own < best) & ~done
        best[nearer], via[nearer] = own[nearer], at
        best[at] = far
    return out


def clusters(pairs: list[tuple[int, int]]) -> list[list[int]]:
    """The rows that pairs join, sorted, a list for each component."""
    near: dict[int, list[int]] = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    out, seen = [], set()
    for start in near:
        if start in seen:
            continue
        seen.add(start)
        own = [start]
        for at in own:
            fresh = [x for x in near[at] if x not in seen]
            seen.update(fresh)
            own += fresh
        out.append(sorted(own))
    return out


def all_pairs(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    near = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2, dtype=np.int64) <= distance
    return list(zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1)))))


def candidates(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Pairs of rows up to `distance` apart: all of clusters of up to ALL_PAIRS rows, of larger ones the tree of least distances."""
    if len(prints) <= ALL_PAIRS:
        return all_pairs(prints, distance)
    tree, out, large = least_tree(prints, distance), [], set()
    for own in clusters(tree):
        if len(own) > ALL_PAIRS:
            large.update(own)
        else:
            out += [(own[a], own[b]) for a, b in all_pairs(prints[own], distance)]
    return out + [(a, b) for a, b in tree if a in large]


def open_edges(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs of candidates() of clusters of which it gives a tree only."""
    large = {k for own in clusters(pairs) if len(own) > ALL_PAIRS for k in own}
    return [p for p in pairs if p[0] in large]


def sketches(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """doc_id long, fp, indices, bands and digest binary, one row for each row of df."""

    def run(batches):
        import pyarrow as pa

        sketcher = Sketcher(shingle)
        for batch in batches:
            own = [sketcher.sketch_bands(raw) for raw in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), *(pa.array([x[k] for x in own], type=pa.binary()) for k in range(3)), batch.column(2)], names=["doc_id", "fp", "indices", "bands", "digest"])
        tidy()

    return df.select(col(id_col).cast("long"), col(text_col).cast("binary"), text_digest(text_col)).mapInArrow(run, "doc_id long, fp binary, indices binary, bands binary, digest binary")


def similar_pairs(distinct: DataFrame, distance: int) -> DataFrame:
    """Candidates (a, b, open, link) as met() has them, of the keys of all kinds among distinct fingerprints (fp, indices, bands); what open pairs of bands join is tied to its least text."""
    first = settle(met(distinct.select(F.col("bands").alias("source"), "fp", F.lit(NO_LABEL).cast("long").alias("label")), distance, band_rows))
    release(distinct.sparkSession)
    whole = settle(components(first.where("open").select("a", "b")))
    release(distinct.sparkSession)  # the rounds of components()
    names = settle(whole.select("root").distinct().select("root", F.monotonically_increasing_id().alias("label")))
    labels = whole.join(names, "root").select(F.col("node").alias("fp"), "label")
    rest = distinct.join(labels, "fp", "left").select(F.col("indices").alias("source"), "fp", F.coalesce("label", F.lit(NO_LABEL)).alias("label"))
    known = first.where("link").select("a", "b", F.lit(False).alias("open"), "link")
    tied = whole.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"), F.lit(True).alias("open"), F.lit(False).alias("link"))
    return known.unionByName(tied).unionByName(met(rest, distance, search_rows))


def band_rows(sources: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, key) of the keys of bands of texts."""
    bands = np.frombuffer(b"".join(sources), "<i8")
    yield np.arange(len(bands)) // BANDS, bands


def search_rows(sources: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, key) of search_keys() of indices of texts."""
    indices = np.frombuffer(b"".join(sources), "<u2").reshape(-1, SEGMENTS, 1 << WEAK)
    for at in range(0, len(indices), 1000):
        row, key = search_keys(indices[at : at + 1000])
        yield row + at, key


def unlike(pairs: list[tuple[int, int]], label: np.ndarray) -> list[tuple[int, int]]:
    """The pairs of rows that have no label or different ones."""
    return [(a, b) for a, b in pairs if label[a] == NO_LABEL or label[a] != label[b]]


def met(texts: DataFrame, distance: int, rows: Callable[[list[bytes]], Iterable[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """Candidates (a, b), a below b, among distinct fingerprints (source, fp, label): candidates() of each key that `rows` finds in the sources, some more than once, none of one label.

    open: the two are of a cluster with pairs in reach that are no candidates;
    open pairs and labels join all of it. With link false a pair only ties
    clusters together that different blocks of a key may have pairs in reach between.
    """

    def emit(batches):
        import pyarrow as pa

        for batch in batches:
            for row, key in rows(batch.column(0).to_pylist()):
                at = pa.array(row)
                yield pa.record_batch([pa.array(key), batch.column(1).take(at), batch.column(2).take(at)], names=["key", "fp", "label"])

    def meet(batches):
        import pyarrow as pa

        found: set[tuple[bytes, bytes]] = set()
        opened: set[tuple[bytes, bytes]] = set()
        tied: set[tuple[bytes, bytes]] = set()
        none = np.zeros((0, LANES), dtype=np.uint64), np.zeros(0, dtype=np.int64)
        ahead = none  # of the held key: a sample of its blocks so far, with labels
        held_key, (held, held_label) = np.zeros(0, dtype=np.int64), none

        def out():
            rows = [(a, b, (a, b) in opened, True) for a, b in found] + [(a, b, True, False) for a, b in tied - found]
            found.clear()
            opened.clear()
            tied.clear()
            return pa.record_batch([pa.array(c, type=t) for c, t in zip(zip(*rows), (pa.binary(), pa.binary(), pa.bool_(), pa.bool_()))], names=["a", "b", "open", "link"])

        def add(to, pairs):
            to.update((a, b) if a < b else (b, a) for a, b in pairs if a != b)

        def one_label(label):
            return label[0] != NO_LABEL and bool((label == label[0]).all())

        def block(prints, label):
            """One of several blocks of a key: its candidates, with those before it by their sample, and a tie from each of its clusters to the first text of all."""
            both, label = np.concatenate([ahead[0], prints]), np.concatenate([ahead[1], label])
            if not one_label(label):
                some = candidates(both, distance)
                raw = [p.tobytes() for p in both]
                for to in (found, opened):
                    add(to, ((raw[a], raw[b]) for a, b in unlike(some, label)))
                joined = clusters(some)
                alone = set(range(len(both))).difference(*joined)
                add(tied, ((raw[a], raw[b]) for a, b in unlike([(own[0], 0) for own in joined] + [(k, 0) for k in alone], label)))
            step = -(-len(both) // SAMPLE)
            return both[::step], label[::step]  # with the first, which is the hub

        def groups(key, prints, label):
            if len(ahead[0]):
                first = int(np.searchsorted(key, key[0], "right"))
                block(prints[:first], label[:first])
                key, prints, label = key[first:], prints[first:], label[first:]
                if not len(key):
                    return
            cut = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1, [len(key)]])
            size = np.diff(cut)
            two = cut[:-1][size == 2]
            near = np.bitwise_count(prints[two] ^ prints[two + 1]).sum(axis=1, dtype=np.int64) <= distance
            near &= (label[two] == NO_LABEL) | (label[two] != label[two + 1])
            add(found, ((prints[k].tobytes(), prints[k + 1].tobytes()) for k in two[near].tolist()))
            for k in np.nonzero(size > 2)[0].tolist():
                own, named = prints[cut[k] : cut[k + 1]], label[cut[k] : cut[k + 1]]
                if one_label(named):
                    continue
                some = candidates(own, distance)
                add(found, ((own[a].tobytes(), own[b].tobytes()) for a, b in unlike(some, named)))
                if len(own) > ALL_PAIRS:
                    add(opened, ((own[a].tobytes(), own[b].tobytes()) for a, b in unlike(open_edges(some), named)))

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.concatenate([held_key, batch.column(0).to_numpy(zero_copy_only=False)])
            prints = np.concatenate([held, np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<u8").reshape(-1, LANES)])
            label = np.concatenate([held_label, batch.column(2).to_numpy(zero_copy_only=False)])
            last = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            if last:
                groups(key[:last], prints[:last], label[:last])
                ahead = none
            held_key, held, held_label = key[last:], prints[last:], label[last:]
            while len(held) > TREE_BLOCK:
                ahead = block(held[:TREE_BLOCK], held_label[:TREE_BLOCK])
                held_key, held, held_label = held_key[TREE_BLOCK:], held[TREE_BLOCK:], held_label[TREE_BLOCK:]
            if len(found) + len(tied) > 100_000:
                yield out()
        if len(held_key):
            groups(held_key, held, held_label)
        if found or tied:
            yield out()
        tidy()

    parts = shuffle_partitions(texts.sparkSession)
    keyed = texts.select("source", "fp", "label").mapInArrow(emit, "key long, fp binary, label long")
    return keyed.repartition(parts, "key").sortWithinPartitions("key", "fp").mapInArrow(meet, "a binary, b binary, open boolean, link boolean")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets (fp, shingles) are alike by `similarity` or more."""

    def judge(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared + 1e-9 >= similarity * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(np.array(keep, dtype=bool))
        tidy()

    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(judge, "a binary, b binary")


def tried_apart(fps: list[bytes], roots: list[bytes], sets: list[bytes], distance: int, similarity: float) -> list[tuple[int, int]]:
    """Links, as row numbers, that join whatever links among the rows in reach join; rows with equal roots are joined already."""
    prints = np.frombuffer(b"".join(fps), "<u8").reshape(-1, LANES)
    label = np.unique(np.array([r.hex() for r in roots]), return_inverse=True)[1]
    size = np.array([len(x) // 8 for x in sets])
    place, out = np.unique(np.frombuffer(b"".join(sets), "<u8"), return_inverse=True)[1], []
    starts = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(len(place), dtype=bool)
    for a in range(len(fps) - 1):
        near = np.bitwise_count(prints[a + 1 :] ^ prints[a]).sum(axis=1, dtype=np.int64) <= distance
        if not (near & (label[a + 1 :] != label[a])).any():
            continue
        own = place[starts[a] : starts[a + 1]]
        mark[own] = True
        sums = np.concatenate([[0], np.cumsum(mark[place[starts[a + 1] :]])])
        mark[own] = False
        shared = np.diff(sums[starts[a + 1 :] - starts[a + 1]])
        for b in (np.nonzero(near & (shared + 1e-9 >= similarity * (size[a] + size[a + 1 :] - shared)))[0] + a + 1).tolist():
            if label[a] != label[b]:
                out.append((a, b))
                label[label == label[b]] = label[a]
    return out


def open_links(hot: DataFrame, member: DataFrame, sets: DataFrame, distance: int, similarity: float) -> DataFrame:
    """Links (a, b) that, with those behind member (node, root), join whatever links of the clusters that the pairs of hot (a, b) make join.

    Clusters of different keys that share texts are taken as one, so that a text
    comes once. Those of which all texts have one root are done. Others are dealt
    by a hash of the fingerprint into blocks of about BLOCK texts, and each pair of
    blocks is a group of its own; of it the texts in reach of one with another
    root are verified.
    """
    whole = components(hot).select(F.col("node").alias("fp"), F.col("root").alias("cluster"))
    known = settle(whole.join(member.withColumnRenamed("node", "fp"), "fp", "left").select("cluster", "fp", F.coalesce("root", "fp").alias("root")))
    release(hot.sparkSession)
    left = known.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    own = known.join(left.select("cluster", F.ceil(F.col("n") / BLOCK).alias("blocks")), "cluster").withColumn("own", F.pmod(F.xxhash64("fp"), "blocks"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "root")

    def by_group(batches, width):
        held, at = [[] for _ in range(width)], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != at:
                    if at is not None:
                        yield at, held
                    held, at = [[] for _ in range(width)], row[:3]
                for k in range(width):
                    held[k].append(row[3 + k])
        if at is not None:
            yield at, held

    def reach(batches):
        import pyarrow as pa

        for (cluster, i, j), (fps, roots) in by_group(batches, 2):
            prints = np.frombuffer(b"".join(fps), "<u8").reshape(-1, LANES)
            label = np.unique(np.array([r.hex() for r in roots]), return_inverse=True)[1]
            near = [bool(((np.bitwise_count(prints ^ p).sum(axis=1, dtype=np.int64) <= distance) & (label != l)).any()) for p, l in zip(prints, label)]
            fp, root = ([x for x, y in zip(c, near) if y] for c in (fps, roots))
            if fp:
                yield pa.record_batch([pa.array([v] * len(fp), type=t) for v, t in ((cluster, pa.binary()), (i, pa.int64()), (j, pa.int64()))] + [pa.array(fp, type=pa.binary()), pa.array(root, type=pa.binary())], names=["cluster", "i", "j", "fp", "root"])
        tidy()

    def judge(batches):
        import pyarrow as pa

        for _, (fps, roots, texts) in by_group(batches, 3):
            links = tried_apart(fps, roots, texts, distance, similarity)
            if links:
                yield pa.record_batch([pa.array([fps[x[k]] for x in links], type=pa.binary()) for k in (0, 1)], names=["a", "b"])
        tidy()

    parts, group = shuffle_partitions(hot.sparkSession), ["cluster", "i", "j"]
    some = dealt.repartition(parts, *group).sortWithinPartitions(*group, "fp").mapInArrow(reach, "cluster binary, i long, j long, fp binary, root binary")
    whole = settle(some).join(sets, "fp").select(*group, "fp", "root", "shingles")
    return whole.repartition(parts, *group).sortWithinPartitions(*group, "fp").mapInArrow(judge, "a binary, b binary")


def shingle_sets(df: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """fp binary, shingles binary (sorted 64-bit hashes), one row for each fingerprint of df."""

    def run(batches):
        import pyarrow as pa

        sketcher = Sketcher(shingle)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            yield pa.record_batch([pa.array([sketcher.sketch(t)[0] for t in texts], type=pa.binary()), pa.array([sketcher.shingles(t).tobytes() for t in texts], type=pa.binary())], names=["fp", "shingles"])

    found = df.select(col(text_col).cast("binary")).mapInArrow(run, "fp binary, shingles binary")
    return found.groupBy("fp").agg(F.min("shingles").alias("shingles"))


def similar_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each row of df: doc_id, fp binary, component_id (the least identifier that links lead to).

    Texts link if their sets of `shingle`-word runs, A-Z lower-cased, have a
    Jaccard similarity of `similarity` or more. Texts with equal sets always
    link; those without words, null ones included, have equal sets. A null
    identifier counts as the lowest long while components are formed, and
    component_id is null where it is the least. Repeated rows each get a row.
    Other columns are not read. An empty table gives no rows.
    """
    return similar_labels(df, id_col, text_col, shingle, similarity).select("doc_id", "fp", "component_id")


def similar_labels(df: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """similar_documents() with digest and root, as label_members() has them."""
    lowest = F.lit(LOWEST)
    prints = settle(sketches(df, id_col, text_col, shingle))
    distinct = settle(prints.groupBy("fp").agg(F.min(F.struct(F.coalesce("doc_id", lowest).alias("first_id"), "digest")).alias("first"), F.min("indices").alias("indices"), F.min("bands").alias("bands")).select("fp", "first.first_id", F.col("first.digest").alias("first_digest"), "indices", "bands"))
    distance = allowed_distance(similarity)
    found = settle(similar_pairs(distinct, distance).groupBy("a", "b").agg(F.bool_or("open").alias("open"), F.bool_or("link").alias("link")))
    release(df.sparkSession)  # the keys, by far the largest shuffle
    pairs, hot = found.where("link").select("a", "b"), found.where("open").select("a", "b")
    nodes = found.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(distinct, "fp").select(F.col("first_id").alias("_id"), F.col("first_digest").alias("_digest")).distinct()
    texts = df.select(F.coalesce(col(id_col).cast("long"), lowest).alias("_id"), text_digest(text_col).alias("_digest"), col(text_col).alias("_text"))
    sets = settle(shingle_sets(texts.join(nodes, ["_id", "_digest"], "left_semi"), "_text", shingle))
    links = settle(verified(pairs, sets, similarity))
    release(df.sparkSession)  # a set for each pair
    member = settle(components(links))
    release(df.sparkSession)
    more = settle(open_links(hot, member, sets, distance, similarity).distinct())
    release(df.sparkSession)
    if not more.isEmpty():
        member = settle(components(member.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)))
    return label_members(prints.select("doc_id", "fp", "digest"), distinct.select("fp", "first_id"), member)


def drop_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of df, with all their columns, of the least document of each component, by identifier, then text; of repeated rows one stays."""
    return keep_least(df, similar_labels(df, id_col, text_col, shingle, similarity), id_col, text_col)

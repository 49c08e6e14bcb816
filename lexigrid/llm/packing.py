"""Packing token sequences into windows by best-fit decreasing.

Documents become little-endian 32-bit token ids and are cut into full windows
and one shorter rest. Pieces are placed longest first, each into the open window
with the least room that still holds it, which a segment tree over remaining
room finds in log(window) steps. Pieces are dealt into shards that pack on their
own; a task streams its shards and holds one block of pieces at a time.
"""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrid.llm.common import col, shuffle_partitions, tidy

WINDOW = 2048
SHARD_ROWS = 8192
#: Words, and runs of characters, whose ids a Python worker keeps: about 200 MB. Fewer take less memory and more time.
KEEP = 400_000
#: Bytes of ids in a batch that a Python worker hands over.
_BATCH_BYTES = 4 << 20


class RoomTree:
    """Stacks of open windows by remaining room 0..capacity, under a segment tree that knows which stacks hold any."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.open = defaultdict(list)

    def put(self, room: int, window: int) -> None:
        self.open[room].append(window)
        at = room + self.leaves
        while at and not self.any[at]:
            self.any[at] = 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The tightest (room, window) with room >= need, removed from the tree."""
        at = need + self.leaves
        if not self.any[at]:
            while at > 1 and (at & 1 or not self.any[at ^ 1]):
                at >>= 1
            if at <= 1:
                return None
            at ^= 1
            while at < self.leaves:
                at = 2 * at if self.any[2 * at] else 2 * at + 1
        room = at - self.leaves
        window = self.open[room].pop()
        if not self.open[room]:
            self.any[at] = 0
            at >>= 1
            while at and not (self.any[2 * at] or self.any[2 * at + 1]):
                self.any[at] = 0
                at >>= 1
        return room, window


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(window, offset) of each length, windows numbered from 0. Equal lengths go in their given order."""
    tree, out, windows = RoomTree(capacity), [(0, 0)] * len(lengths), 0
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        need = lengths[k]
        if not 0 < need <= capacity:
            raise ValueError("a piece has 1 to capacity tokens")
        found = tree.take(need)
        if found is None:
            found, windows = (capacity, windows), windows + 1
        room, window = found
        out[k] = window, capacity - room
        if room > need:
            tree.put(room - need, window)
    return out


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordBpe:
    """UTF-8 text -> little-endian 32-bit ids, as the `tokenizers` library gives them with add_special_tokens=False.

    The file's pre-tokenizer never joins across white space, so each blank-free
    run is encoded once and kept, and a document is a join of kept bytes. Runs
    of Latin-1 characters go through the same merges in a byte-pair engine that
    takes the end-of-word mark as a byte that UTF-8 never has; all others go
    through the library itself, as do runs with the name of a special token. Such
    a name in a text becomes the special token's id, as in the library; with
    plain_names it is ordinary text.
    """

    _SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_\xb2\xb3\xb9\xbc\xbd\xbe]+|[\d\xb2\xb3\xb9\xbc\xbd\xbe]|(?:[^\s\w]|_)+")
    _ODD = re.compile("[\x1c-\x1f\x85\xa0\u0100-\U0010ffff]")

    def __init__(self, path: str, keep: int = KEEP, plain_names: bool = False):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain_names
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab, names = model["model"]["vocab"], [] if plain_names else [t["content"] for t in model["added_tokens"]]
        if any(re.search(r"\s", n) for n in names):
            raise ValueError("a special token's name holds white space")
        self.names = names
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {}
        for token, rank in vocab.items():
            end = token.endswith("</w>") and len(token) > 4
            body = token[:-4] if end else token
            if all(c in byte_of for c in body):
                ranks[bytes(byte_of[c] for c in body) + b"\xff" * end] = rank
        self.engine = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.keep = keep
        self.words: dict[str, bytes] = {}
        self.runs: dict[bytes, bytes] = {}

    def forget(self) -> None:
        """Drop what was kept; a Python worker lives on after its task."""
        self.words, self.runs = {}, {}

    def _word(self, word: str) -> bytes:
        import numpy as np

        if len(self.words) >= self.keep:
            self.words.clear()
        own = self.words[word] = np.array(self.engine(word.encode() + b"\xff"), dtype="<u4").tobytes()
        return own

    def _run(self, raw: bytes) -> bytes:
        import numpy as np

        text = raw.decode("utf-8", "replace")
        if self._ODD.search(text) or any(n in text for n in self.names):
            own = np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        else:
            words = self.words
            own = b"".join([words.get(w) or self._word(w) for w in self._SPLIT.findall(text.lower())])
        if len(self.runs) >= self.keep:
            self.runs.clear()
        if len(raw) <= 64:
            self.runs[raw] = own
        return own

    def encode(self, raw: bytes) -> bytes:
        runs = self.runs
        return b"".join([runs.get(r) or self._run(r) for r in raw.split()])


_LOADED: dict[tuple[str, int, bool], WordBpe] = {}


def tokenize_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, window: int = WINDOW, end_id: int = 1, keep: int = KEEP, plain_names: bool = False) -> DataFrame:
    """Pieces of each row of df: doc_id, start long, length long, doc_tokens long, ids binary (little-endian 32-bit).

    The row's text is encoded whole, however long, end_id follows, and the ids
    are cut every window ids. A null or empty text is the end_id alone. A null
    identifier stays null; repeated rows each give their own pieces. Other
    columns of df are not read, whatever their names. An empty table gives no
    rows. plain_names: names of special tokens are ordinary text.
    """
    path = tokenizer_path or vocabulary("word_bpe_49k.json")
    step = 4 * window

    def cut(batches):
        import pyarrow as pa

        own = path, keep, plain_names
        bpe = _LOADED.get(own) or _LOADED.setdefault(own, WordBpe(*own))
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            out = ([], [], [], [], [])
            size = 0

            def full():
                return pa.record_batch([pa.array(c, type=t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "start", "length", "doc_tokens", "ids"])

            for ident, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = bpe.encode(raw.as_py() or b"") + end
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    for held, x in zip(out, (ident, at // 4, len(part) // 4, len(ids) // 4, part)):
                        held.append(x)
                size += len(ids)
                if size > _BATCH_BYTES:
                    yield full()
                    out, size = ([], [], [], [], []), 0
            if out[0]:
                yield full()
        bpe.forget()
        tidy()

    return df.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("binary").alias("text")).mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, ids binary")


def pack_pieces(pieces: DataFrame, window: int = WINDOW, shard_rows: int = SHARD_ROWS, rows: int | None = None) -> DataFrame:
    """pieces with sequence_id, offset, sequence_tokens and padded_tokens long added; every other column stays.

    `length` is 1 to window. Pieces are dealt into about rows / shard_rows
    shards, which go to spark.sql.shuffle.partitions tasks at most. Each row is
    dealt by its own number, so neither null nor repeated identifiers make a
    shard large; a shard of more than twice shard_rows is packed in blocks. In a
    shard pieces of equal length go by doc_id (null last) and start; rows equal in
    all of these stand for each other, in any order. A sequence is padded to the
    window unless its own length is a power of two. rows: about how many pieces
    there are, counted here if not given; it only sets the number of shards. An
    empty table gives no rows.
    """
    own = pieces.columns
    clash = {"sequence_id", "offset", "sequence_tokens", "padded_tokens", "_shard"} & {c.lower() for c in own}
    if clash:
        raise ValueError(f"these columns are made here: {sorted(clash)}")
    shards = max(1, -(-(pieces.count() if rows is None else rows) // shard_rows))
    doc_at, start_at, length_at = (own.index(c) for c in ("doc_id", "start", "length"))

    def placed(shard: int, base: int, held: list):
        """The batches of one block with their places; ids stay where they are."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        keys = pa.table([pa.chunked_array([b.column(k) for b in held]) for k in (doc_at, start_at, length_at)], names=["doc", "start", "length"])
        order = pc.sort_indices(keys, sort_keys=[(c, "ascending") for c in keys.column_names]).to_numpy()
        lengths = keys.column("length").to_numpy()
        put = np.zeros((len(lengths), 2), dtype=np.int64)
        put[order] = best_fit_decreasing(lengths[order].tolist(), window)
        used = np.zeros(put[:, 0].max() + 1, dtype=np.int64)
        np.add.at(used, put[:, 0], lengths)
        total = used[put[:, 0]]
        padded = np.where(total & (total - 1) == 0, total, window)
        at = 0
        for batch in held:
            rows = slice(at, at + batch.num_rows)
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], *(pa.array(v[rows]) for v in ((shard << 32) + base + put[:, 0], put[:, 1], total, padded))], names=[*own, "sequence_id", "offset", "sequence_tokens", "padded_tokens"])

    def place(batches):
        import numpy as np

        now, base, held, rows = None, 0, [], 0
        for batch in batches:
            shard = batch.column(len(own)).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.nonzero(np.diff(shard))[0] + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and (shard[a] != now or rows >= 2 * shard_rows):
                    yield from placed(now, base, held)
                    base = base + rows if shard[a] == now else 0
                    held, rows = [], 0
                now = int(shard[a])
                held.append(batch.slice(a, b - a))
                rows += b - a
        if held:
            yield from placed(now, base, held)
        tidy()

    added = [T.StructField(c, T.LongType()) for c in ("sequence_id", "offset", "sequence_tokens", "padded_tokens")]
    shard = F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    dealt = pieces.withColumn("_shard", shard).repartition(min(shards, shuffle_partitions(pieces.sparkSession)), "_shard").sortWithinPartitions("_shard")
    return dealt.mapInArrow(place, T.StructType([*pieces.schema.fields, *added]))


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, window: int = WINDOW, end_id: int = 1, shard_rows: int = SHARD_ROWS, keep: int = KEEP, plain_names: bool = False) -> DataFrame:
    """tokenize_pieces, then pack_pieces, with the ids of every piece."""
    size = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(col(text_col))), F.lit(0)).alias("bytes")).first()
    rows = size["n"] + size["bytes"] // (3 * window)
    return pack_pieces(tokenize_pieces(df, id_col, text_col, tokenizer_path, window, end_id, keep, plain_names), window, shard_rows, rows)


def sequences(packed: DataFrame) -> DataFrame:
    """One row for each sequence: sequence_id, ids binary (pieces in order), sequence_tokens, padded_tokens, doc_ids array."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts"), F.first("sequence_tokens").alias("sequence_tokens"), F.first("padded_tokens").alias("padded_tokens")).select(
        "sequence_id", F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.ids))").alias("ids"), "sequence_tokens", "padded_tokens", F.col("parts.doc_id").alias("doc_ids")
    )

"""SentencePiece encoding and decoding, with giant documents encoded in parallel chunks.

A piece sequence is the BPE encoding of a text exactly if each piece alone, and
each adjacent pair of pieces alone, encodes to itself. So the encoding is the one
path of weight 0 through a lattice whose edges weigh 0 (a compatible pair) or
minus infinity. The state at a chunk boundary is the piece that covers the
character before it. Each chunk gives a matrix, in the max-plus semiring, from
the states at its left boundary to those at its right; as all weights are 0 or
minus infinity a row is kept as a set of bits. Matrices are combined
associatively, the states on the best path follow, and then each chunk is
backtraced on its own.

Words meet at a blank that follows another character, and no piece spans that.
There every state collapses into one, so only the broken words at a chunk's ends
need the lattice.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import col, settle

CHUNK = 16_384
GIANT = 32_768
#: Chunks whose matrices are combined in one group.
BLOCK = 256
BLANK = "▁"


class PieceBpe:
    """The BPE of a SentencePiece model file: whole words by the library, boundary words by the lattice."""

    KEEP = 400_000

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import sentencepiece

        sp = self.library = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.id_of = {sp.id_to_piece(i): i for i in plain}
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.byte_id = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.longest = max(map(len, self.id_of))
        self.spans_blank = any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.id_of)
        self.raw = {i: sp.id_to_piece(i).replace(BLANK, " ").encode() for i in plain} | {i: bytes([b]) for b, i in self.byte_id.items()}
        self.words: dict[bytes, bytes] = {}
        self.merged: dict[str, tuple[str, ...]] = {}

    # whole words

    def _ids(self, ids) -> bytes:
        import numpy as np

        return np.array(ids, dtype="<u4").tobytes()

    def _word(self, raw: bytes) -> bytes:
        """Ids of a blank and then raw, which the library puts first by itself."""
        own = self._ids(self.library.encode(raw.decode("utf-8", "replace"))) if raw else self._ids(self.pieces(BLANK))
        if len(self.words) >= self.KEEP:
            self.words.clear()
        if len(raw) <= 64:
            self.words[raw] = own
        return own

    def encode(self, raw: bytes) -> bytes:
        """Ids, little-endian 32-bit, of a whole text in UTF-8."""
        if not raw:
            return b""
        return self.encode_words(raw.replace(BLANK.encode(), b" "))

    def encode_words(self, raw: bytes) -> bytes:
        """Ids of a blank and then raw: what starts at a word's beginning and ends at a word's end."""
        words = self.words
        if b"  " in raw or raw[:1] == b" " or raw[-1:] == b" ":
            parts = [p[1:] for p in re.findall(rb" +[^ ]+| +$", b" " + raw)]
        else:
            parts = raw.split(b" ")
        return b"".join([words.get(p) or self._word(p) for p in parts])

    # the lattice

    def symbols(self, text: str) -> tuple[str, ...]:
        """The pieces (or unknown characters) that merging makes of a short text, leftmost first among equal scores."""
        own = self.merged.get(text)
        if own is None:
            parts = list(text)
            while True:
                best = max(((self.score[p], -k) for k in range(len(parts) - 1) if (p := parts[k] + parts[k + 1]) in self.score), default=None)
                if best is None:
                    break
                k = -best[1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            own = tuple(parts)
            if len(self.merged) >= self.KEEP:
                self.merged.clear()
            self.merged[text] = own
        return own

    def pieces(self, text: str) -> list[int]:
        return [i for s in self.symbols(text) for i in self.symbol_ids(s)]

    def symbol_ids(self, symbol: str) -> list[int]:
        own = self.id_of.get(symbol)
        return [own] if own is not None else [self.byte_id[b] for b in symbol.encode("utf-8", "replace")]

    def follows(self, left: str, right: str) -> bool:
        return self.symbols(left + right) == (left, right)

    def starting(self, text: str, at: int) -> list[str]:
        """The symbols that can start at a place of text."""
        own = [text[at]]
        for n in range(2, min(self.longest, len(text) - at) + 1):
            p = text[at : at + n]
            if p in self.score and self.symbols(p) == (p,):
                own.append(p)
        return own

    def cuts(self, text: str, start: int, stop: int) -> tuple[int, int] | None:
        """First and last place in start..stop-1 where a word begins after another character; None if there is none."""
        if self.spans_blank:
            return None
        places = [m.start() + 1 for m in re.finditer(f"[^{BLANK}](?={BLANK})", text[max(0, start - 1) : stop])]
        base = max(0, start - 1)
        places = [base + p for p in places if start <= base + p < stop]
        return (places[0], places[-1]) if places else None

    def walk(self, text: str, start: int, stop: int, entry: dict[tuple[int, str], int]):
        """Masks of the entry states that reach (end, symbol), for symbols that start before stop.

        entry: (end of the symbol, symbol) -> mask; the empty symbol goes with
        anything. Returns end -> {symbol: mask}.
        """
        at: dict[int, dict[str, int]] = {}
        for (end, s), mask in entry.items():
            at.setdefault(end, {})[s] = at.get(end, {}).get(s, 0) | mask
        for k in range(start, stop):
            before = at.get(k)
            if not before:
                continue
            for s in self.starting(text, k):
                mask = 0
                for t, m in before.items():
                    if (m | mask) != mask and (not t or self.follows(t, s)):
                        mask |= m
                if mask:
                    own = at.setdefault(k + len(s), {})
                    own[s] = own.get(s, 0) | mask
        return at

    def covering(self, text: str, place: int) -> list[tuple[int, str]]:
        """(end, symbol) of the symbols that cover the character before place."""
        out = []
        for k in range(max(0, place - self.longest), place):
            out += [(k + len(s), s) for s in self.starting(text, k) if k + len(s) >= place]
        return out

    def transfer(self, text: str, start: int, stop: int, first: bool) -> list[tuple[tuple[int, str], tuple[int, str]]]:
        """The pairs (left state, right state) of weight 0 of the chunk start..stop of text, which has context on both sides.

        A state is (how far the symbol reaches beyond the boundary, symbol).
        """
        entry = [(start, "")] if first else self.covering(text, start)
        masks = {s: 1 << k for k, s in enumerate(entry)}
        cut = self.cuts(text, start, stop)
        if cut is None:
            at, reach = self.walk(text, start, stop, masks), None
        else:
            at = self.walk(text, start, cut[0], masks)
            reach = 0
            for m in at.get(cut[0], {}).values():
                reach |= m
            at = self.walk(text, cut[1], stop, {(cut[1], ""): reach})
        out = []
        for end, own in at.items():
            if end >= stop:
                for s, mask in own.items():
                    if s and end - len(s) < stop:
                        out += [((e - start, t), (end - stop, s)) for k, (e, t) in enumerate(entry) if mask >> k & 1]
        return out

    def backtrace(self, text: str, start: int, stop: int, left: tuple[int, str], right: tuple[int, str]) -> bytes:
        """Ids of the symbols that start in the chunk, on the one path between two states."""
        cut = self.cuts(text, start, stop)
        if cut is None:
            return self._path(text, start, stop, (start + left[0], left[1]), (stop + right[0], right[1]))
        head = self._path(text, start, cut[0], (start + left[0], left[1]), None)
        middle = self.encode_words(text[cut[0] + 1 : cut[1]].replace(BLANK, " ").encode()) if cut[1] > cut[0] else b""
        return head + middle + self._path(text, cut[1], stop, (cut[1], ""), (stop + right[0], right[1]))

    def _path(self, text: str, start: int, stop: int, left: tuple[int, str], right: tuple[int, str] | None) -> bytes:
        at = self.walk(text, start, stop, {left: 1})
        if right is None:
            if left[0] == stop:
                return b""
            ends = [(stop, s) for s in at.get(stop, {}) if s and (stop, s) != left]
        else:
            ends = [right]
        for end, s in ends:
            out, ok = [], True
            while (end, s) != left:
                out.append(s)
                end -= len(s)
                before = [t for t in at.get(end, {}) if not t or self.follows(t, s)]
                if not before:
                    ok = False
                    break
                s = before[0]
            if ok:
                return self._ids([i for s in reversed(out) for i in self.symbol_ids(s)])
        raise ValueError("no path between the states of a chunk")

    def decode(self, ids: bytes) -> str:
        import numpy as np

        raw = b"".join([self.raw[i] for i in np.frombuffer(ids, "<u4").tolist()])
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


@cache
def _bpe(path: str | None) -> PieceBpe:
    return PieceBpe(path)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, chunk: int = CHUNK, giant: int = GIANT) -> DataFrame:
    """doc_id, ids binary (little-endian 32-bit), one row for each row of df.

    The ids are those of the SentencePiece library. Texts of more than `giant`
    code points are cut every `chunk` of them, and their chunks are encoded in
    parallel. Null and empty texts have no ids. Repeated rows and null
    identifiers keep their rows; other columns are not read; an empty table
    gives no rows.
    """
    if chunk < 64:
        raise ValueError("a chunk has 64 code points at least")
    own = df.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))

    def small(batches):
        import pyarrow as pa

        bpe = _bpe(model_path)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([bpe.encode(t) for t in batch.column(1).to_pylist()], type=pa.binary())], names=["doc_id", "ids"])

    plain = own.where(F.length("text") <= giant).select("doc_id", F.col("text").cast("binary")).mapInArrow(small, "doc_id long, ids binary")
    return plain.unionByName(_encode_giants(own.where(F.length("text") > giant), model_path, chunk))


def _encode_giants(giants: DataFrame, model_path: str | None, chunk: int) -> DataFrame:
    """Rows are told apart by identifier and text; repeated rows are encoded once and joined back."""
    margin = 64

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            for ident, key, n, text in zip(*(c.to_pylist() for c in batch.columns)):
                whole = BLANK + text.replace(" ", BLANK)
                places = list(range(0, len(whole), chunk))
                if len(places) > 1 and len(whole) - places[-1] < margin:
                    places.pop()
                for k, a in enumerate(places):
                    b = places[k + 1] if k + 1 < len(places) else len(whole)
                    lo = max(0, a - margin)
                    yield pa.record_batch(
                        [pa.array([v], type=t) for v, t in ((ident, pa.int64()), (key, pa.string()), (n, pa.int64()), (k, pa.int64()), (k == len(places) - 1, pa.bool_()), (a - lo, pa.int64()), (b - lo, pa.int64()), (whole[lo : b + margin], pa.string()))],
                        names=["doc_id", "key", "n", "k", "last", "a", "b", "part"],
                    )

    chunk_schema = "doc_id long, key string, n long, k long, last boolean, a long, b long, part string"
    keyed = giants.groupBy("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.first("text").alias("text"))
    chunks = keyed.select("doc_id", "key", "n", "text").mapInArrow(cut, chunk_schema)
    chunks = settle(chunks.repartition(F.coalesce("doc_id", F.lit(0)), "key", "k"))

    edge = "le long, ls string, re long, rs string"

    def matrices(batches):
        import pyarrow as pa

        bpe = _bpe(model_path)
        for batch in batches:
            out = ([], [], [], [], [], [], [])
            for ident, key, _, k, last, a, b, part in zip(*(c.to_pylist() for c in batch.columns)):
                for (le, ls), (re_, rs) in bpe.transfer(part, a, b, k == 0):
                    if not last or re_ == 0:
                        for held, x in zip(out, (ident, key, k, le, ls, re_, rs)):
                            held.append(x)
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
            yield pa.record_batch([pa.array(c, type=t) for c, t in zip(out, types)], names=["doc_id", "key", "k", "le", "ls", "re", "rs"])

    def whole_block(pdf):
        """A block of chunks as one matrix."""
        return _edge_rows(pdf, [("block", pdf["block"].iloc[0])], _scan(_matrices(pdf, "k")[1])[-1])

    def block_route(pdf):
        """The states at both boundaries of each block, of the path from the text's start to its end."""
        blocks, steps = _matrices(pdf, "block")
        (end,) = _scan(steps)[-1][0, ""]
        return _route_rows(pdf, "block", blocks, steps, (0, ""), end)

    def chunk_route(pdf, ends):
        """The same of each chunk of a block, given the block's."""
        chunks, steps = _matrices(pdf, "k")
        first = ends.iloc[0]
        return _route_rows(pdf, "k", chunks, steps, (int(first["le"]), first["ls"]), (int(first["re"]), first["rs"]))

    # a scan in two levels: no task has more than BLOCK matrices of a text, or one for each block of it
    steps = settle(chunks.mapInArrow(matrices, f"doc_id long, key string, k long, {edge}").withColumn("block", F.expr(f"k div {BLOCK}")))
    whole = steps.groupBy("doc_id", "key", "block").applyInPandas(whole_block, f"doc_id long, key string, block long, {edge}")
    ends = whole.groupBy("doc_id", "key").applyInPandas(block_route, f"doc_id long, key string, block long, {edge}")
    routes = steps.groupBy("doc_id", "key", "block").cogroup(ends.groupBy("doc_id", "key", "block")).applyInPandas(chunk_route, f"doc_id long, key string, k long, {edge}")
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["key"] == b["key"]) & (a["k"] == b["k"])
    ready = chunks.join(routes, same(chunks, routes)).select(chunks["doc_id"], chunks["key"], "n", chunks["k"], "a", "b", "part", "le", "ls", "re", "rs")

    def trace(batches):
        import pyarrow as pa

        bpe = _bpe(model_path)
        for batch in batches:
            ids = [bpe.backtrace(part, a, b, (le, ls), (re_, rs)) for a, b, part, le, ls, re_, rs in zip(*(batch.column(k).to_pylist() for k in range(4, 11)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ids, type=pa.binary())], names=["doc_id", "key", "n", "k", "ids"])

    def join_parts(batches):
        import pyarrow as pa

        for batch in batches:
            for at, (ident, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                ids = b"".join(p["ids"] for p in batch.column(2)[at].as_py())
                for _ in range(n):
                    yield pa.record_batch([pa.array([ident], type=pa.int64()), pa.array([ids], type=pa.binary())], names=["doc_id", "ids"])

    traced = ready.mapInArrow(trace, "doc_id long, key string, n long, k long, ids binary")
    joined = traced.groupBy("doc_id", "key", "n").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    return joined.select("doc_id", "n", "parts").mapInArrow(join_parts, "doc_id long, ids binary")


def _matrices(pdf, number: str) -> tuple[list[int], list[dict]]:
    """The numbers in order, and the matrix of each: state -> set of states."""
    steps: dict[int, dict] = {}
    for k, le, ls, re_, rs in zip(pdf[number], pdf["le"], pdf["ls"], pdf["re"], pdf["rs"]):
        steps.setdefault(int(k), {}).setdefault((int(le), ls), set()).add((int(re_), rs))
    return sorted(steps), [steps[k] for k in sorted(steps)]


def _edge_rows(pdf, more: list[tuple], matrix: dict):
    import pandas as pd

    rows = [(*left, *right) for left, to in matrix.items() for right in to]
    out = pd.DataFrame(rows, columns=["le", "ls", "re", "rs"])
    for name, value in (*more, ("key", pdf["key"].iloc[0]), ("doc_id", pdf["doc_id"].iloc[0])):
        out.insert(0, name, value)
    return out


def _route_rows(pdf, number: str, numbers: list[int], steps: list[dict], start: tuple[int, str], state: tuple[int, str]):
    """For each matrix the states before and after it, on the one path from start to state: prefix products, then backwards."""
    import pandas as pd

    reach = [{start}, *(total.get(start, set()) for total in _scan(steps))]
    rows = []
    for at in range(len(steps) - 1, -1, -1):
        (before,) = [s for s, to in steps[at].items() if s in reach[at] and state in to]
        rows.append((pdf["doc_id"].iloc[0], pdf["key"].iloc[0], numbers[at], *before, *state))
        state = before
    return pd.DataFrame(rows, columns=["doc_id", "key", number, "le", "ls", "re", "rs"])


def _product(left: dict, right: dict) -> dict:
    """Max-plus product of matrices whose weights are 0 where a pair is held and minus infinity elsewhere."""
    return {a: set().union(*(right.get(m, set()) for m in mids)) for a, mids in left.items()}


def _scan(matrices: list[dict]) -> list[dict]:
    """All prefix products, combined pairwise as in a parallel scan."""
    if len(matrices) <= 1:
        return matrices
    pairs = [_product(matrices[k], matrices[k + 1]) for k in range(0, len(matrices) - 1, 2)]
    even = _scan(pairs)
    out = []
    for k in range(len(matrices)):
        out.append(matrices[0] if k == 0 else even[k // 2] if k % 2 else _product(even[k // 2 - 1], matrices[k]))
    return out


def decode(df: DataFrame, ids_col: str = "ids", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """doc_id and the decoded text of df (doc_id, ids). Null ids give null. A blank mark U+2581 in the original comes back as a blank."""

    def run(batches):
        import pyarrow as pa

        bpe = _bpe(model_path)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([None if i is None else bpe.decode(i) for i in batch.column(1).to_pylist()], type=pa.string())], names=["doc_id", text_col])

    return df.select("doc_id", col(ids_col)).mapInArrow(run, f"doc_id long, `{text_col}` string")

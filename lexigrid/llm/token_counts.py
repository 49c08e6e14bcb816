"""Token counts by greedy longest match, in time linear in the text.

The vocabulary becomes a trie whose nodes carry failure links and the number of
tokens popped on the way (Song et al., Fast WordPiece Tokenization, 2021). A
count then needs one pass over the characters and no pieces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: A word is a run of letters and digits; every other character but white space stands alone.
WORDS = re.compile(r"\w+|[^\w\s]")
START = "▁"


class LongestMatch:
    """Counts the greedy longest-match pieces of `start + word`.

    The first piece of a word begins with the start mark; later pieces are those
    without it. A word that cannot be covered counts as one unknown token, as a
    word-piece tokenizer has it.
    """

    KEEP = 500_000

    def __init__(self, pieces: list[str], start: str = START):
        self.start = start
        later = {p for p in pieces if p and not p.startswith(start)}
        first = {p for p in pieces if p.startswith(start)}
        # node 0: the root for later pieces; node 1: the word's start mark
        self.next: list[dict[str, int]] = [{}, {}]
        text, final = ["", start], [False, start in first]
        for root, own, skip in ((0, later, 0), (1, first, len(start))):
            for piece in own:
                at = root
                for c in piece[skip:]:
                    if c not in self.next[at]:
                        self.next[at][c] = len(self.next)
                        self.next.append({})
                        text.append(text[at] + c)
                        final.append(False)
                    at = self.next[at][c]
                final[at] = True
        n = len(self.next)
        self.fail: list[int] = [-1] * n
        self.pops = [0] * n
        if final[1]:
            self.fail[1], self.pops[1] = 0, 1
        queue = [0, 1]
        while queue:
            after = []
            for u in queue:
                for c, v in self.next[u].items():
                    if final[v]:
                        self.fail[v], self.pops[v] = 0, 1
                    else:
                        z, popped = self.fail[u], self.pops[u]
                        while z >= 0 and c not in self.next[z]:
                            popped += self.pops[z]
                            z = self.fail[z]
                        if z >= 0:
                            self.fail[v], self.pops[v] = self.next[z][c], popped
                    after.append(v)
            queue = after
        self.kept: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Tokens of one word, 1 if it cannot be covered, 0 if it is empty."""
        if not word:
            return 0
        at, total = 1, 0
        step, fail, pops = self.next, self.fail, self.pops
        for c in word:
            while c not in step[at]:
                if fail[at] < 0:
                    return 1
                total += pops[at]
                at = fail[at]
            at = step[at][c]
        while at:
            if fail[at] < 0:
                return 1
            total += pops[at]
            at = fail[at]
        return total

    def total(self, text: str) -> int:
        """Tokens of a whole text."""
        kept, count, out = self.kept, self.count, 0
        for w in WORDS.findall(text):
            n = kept.get(w)
            if n is None:
                n = count(w)
                if len(w) <= 64:
                    if len(kept) >= self.KEEP:
                        kept.clear()
                    kept[w] = n
            out += n
        return out


def piece_vocabulary(path: str | None = None) -> list[str]:
    """The ordinary pieces of a SentencePiece model file."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


_LOADED: dict[str | None, LongestMatch] = {}


def count_tokens(df: DataFrame, text_col: str = "text", out: str = "n_tokens", model_path: str | None = None) -> DataFrame:
    """df with the number of longest-match tokens of its text added as a long.

    Null and empty texts, and texts of white space, count 0. Other columns pass
    through; `out` must be a new name. Rows are counted one by one, whole, so
    repeated rows get equal counts and an empty table gives no rows.
    """
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"df already has a column {out}")
    at = df.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        match = _LOADED.get(model_path) or _LOADED.setdefault(model_path, LongestMatch(piece_vocabulary(model_path)))
        for batch in batches:
            n = [match.total(t) if t else 0 for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, type=pa.int64())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.LongType())]))

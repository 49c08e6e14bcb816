"""Words, tokens and grams of Arrow batches of text, for counts that would else make a row for each word in the JVM."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of texts that are handled in one go, as each has hash tables of its own.
CHARACTERS = 32 << 20
#: Rows after which the characters are counted.
ROWS = 1000

#: Symbols since Unicode 15.1, which Arrow's expressions know and Java's and DuckDB's do not.
_LATE = "\u2ffc\u2ffd\u2ffe\u2fff\u31ef"
_MARKS = r"([\p{M}\p{P}\p{S}]+)"


def gathered(batches, most: int | None = None, text: str = "text"):
    """The rows of batches as tables of about `most` characters of `text` each."""
    held, size = [], 0
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            held.append(batch.slice(k, ROWS))
            size += pc.sum(pc.binary_length(held[-1].column(text))).as_py() or 0
            if size >= (CHARACTERS if most is None else most):
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def words(texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many white-space tokens each text has, and the tokens. The same code points part them as in text.split_words()."""
    whole = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.utf8_split_whitespace(whole.combine_chunks() if isinstance(whole, pa.ChunkedArray) else whole)
    flat, length = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    some = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # white space at an end of a text leaves an empty string there
    if some.all():
        return length, flat
    row = np.repeat(np.arange(len(length)), length)
    return np.bincount(row[some], minlength=len(length)).astype(np.int64), flat.filter(pa.array(some))


def _spaced(text: str) -> str:
    out, last = [], None
    for c in text:
        mark = c not in _LATE and unicodedata.category(c)[0] in "MPS"
        out += [" ", c] if mark is not last else [c]
        last = mark
    return "".join(out)


def tokens(texts: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """How many tokens of text.tokenize() each text has, and the tokens. Lower-case the texts before."""
    whole = pc.fill_null(texts.cast(pa.large_string()), "").combine_chunks()
    spaced = pc.replace_substring_regex(whole, pattern=_MARKS, replacement=r" \1 ")
    late = pc.match_substring_regex(whole, f"[{_LATE}]")
    if pc.any(late).as_py():
        spaced = pc.replace_with_mask(spaced, late, pa.array([_spaced(t) for t in whole.filter(late).to_pylist()], type=pa.large_string()))
    return words(spaced)


def grams(length: np.ndarray, flat: pa.Array, k: int, ordered: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """The text, the gram's place among the distinct ones, the distinct grams (tokens joined by blanks) and how often that text has it.

    ordered=False sorts each gram's tokens by their bytes first.
    """
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(length)), length)
    first = np.nonzero(owner[: len(owner) - k + 1] == owner[k - 1 :])[0] if len(owner) >= k else np.empty(0, dtype=np.int64)
    if not len(first):
        return first, first, pa.array([], type=flat.type), first
    own = np.stack([codes[first + m] for m in range(k)], axis=1)
    if not ordered and k > 1:
        rising = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(rising), dtype=np.int64)
        rank[rising] = np.arange(len(rising))
        own = rising[np.sort(rank[own], axis=1)].astype(np.int64)
    made, base = own[:, 0], len(coded.dictionary)
    for m in range(1, k):  # each pair of a gram's number and its next token is a number of its own
        both, made = np.unique(made * base + own[:, m], return_inverse=True)
    if k == 1:
        both, made = np.unique(made, return_inverse=True)
    spot = np.empty(len(both), dtype=np.int64)
    spot[made] = np.arange(len(made))
    names = [coded.dictionary.take(pa.array(own[spot, m])) for m in range(k)]
    key, n = np.unique(owner[first] * len(both) + made, return_counts=True)
    return key // len(both), key % len(both), pc.binary_join_element_wise(*names, pa.scalar(" ", type=names[0].type)) if k > 1 else names[0], n

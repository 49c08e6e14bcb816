"""Column expressions over text and token arrays. All stay inside the JVM but html_unescape, utf8_bytes and ascii_fold."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The 29 code points that Python's str.split() breaks at; `\s` lacks some of them in Java's and DuckDB's expressions.
WS = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
TOKEN_RX = rf"[\p{{M}}\p{{P}}\p{{S}}]+|[^\p{{M}}\p{{P}}\p{{S}}{WS}]+"
SPLIT_RX = rf"[^{WS}]+"

#: The bracket codes of treebanks, and what starts a link or a user name.
UNESCAPES = {"-LRB-": "(", "-RRB-": ")", "-LSB-": "[", "-RSB-": "]", "-LCB-": "{", "-RCB-": "}"}
URL_RX = rf"(?:www\.|htt(?:ps?)?://)[^{WS}]+"
USER_RX = rf"@[^{WS}]+"


def tokenize(text: Column) -> Column:
    """Runs of marks, punctuation and symbols, and runs of everything else but white space."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN_RX), F.lit(0))


def split_words(text: Column) -> Column:
    """White-space tokens, no empty ones."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SPLIT_RX), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{WS}]+|[{WS}]+$", "")


def let(value: Column, body) -> Column:
    """body(value), with value worked out once a row even where body uses it in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ngrams(tokens: Column, k: int) -> Column:
    """All runs of k tokens; empty if there are fewer."""
    none = F.array().cast("array<array<string>>")
    return let(tokens, lambda t: F.when(F.size(t) >= k, F.transform(F.sequence(F.lit(1), F.size(t) - (k - 1)), lambda i: F.slice(t, i, F.lit(k)))).otherwise(none))


def sorted_ngrams(tokens: Column, k: int) -> Column:
    """n-grams without their order: each gram's tokens sorted, repeats kept."""
    return F.transform(ngrams(tokens, k), lambda g: F.array_sort(g))


def gram_text(gram: Column) -> Column:
    """A gram as one string; tokens hold no blank, so no two grams share it."""
    return F.array_join(gram, " ")


def label_prefix(label: Column) -> Column:
    return F.split_part(label, F.lit(":"), F.lit(1))


def mask_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL_RX, "<url>")


def mask_users(text: Column) -> Column:
    return F.regexp_replace(text, USER_RX, "<user>")


def unescape_bracket(token: Column) -> Column:
    """The bracket that a whole token is the code of; other tokens as they are."""
    out = token
    for code, plain in UNESCAPES.items():
        out = F.when(token == code, F.lit(plain)).otherwise(out)
    return out


def normalize_sentence(text: Column, to_lower: bool = True) -> Column:
    """White-space tokens joined by blanks, bracket codes undone, lower-cased if asked, links and user names masked."""
    out = F.array_join(F.transform(split_words(text), unescape_bracket), " ")
    return mask_users(mask_urls(F.lower(out) if to_lower else out))


def pad(ids: Column, length: Column | int, value: int = 0) -> Column:
    """ids and then value up to length."""
    length = F.lit(length) if isinstance(length, int) else length
    return F.concat(ids, F.array_repeat(F.lit(value).cast("bigint"), F.greatest(F.lit(0), length - F.size(ids)).cast("int")))


def pad_left(ids: Column, length: Column | int, value: int = 0) -> Column:
    length = F.lit(length) if isinstance(length, int) else length
    return F.concat(F.array_repeat(F.lit(value).cast("bigint"), F.greatest(F.lit(0), length - F.size(ids)).cast("int")), ids)


def mask(ids: Column, length: Column | int) -> Column:
    """1 for each id, then 0 up to length."""
    return pad(F.transform(ids, lambda x: F.lit(1).cast("bigint")), length)


def ceil_to_step(n: Column, step: int) -> Column:
    return (F.ceil(n / F.lit(step)) * step).cast("bigint")


@F.pandas_udf(T.StringType())
def ascii_fold(text: pd.Series) -> pd.Series:
    """Decompose (NFKD), then drop what is not ASCII; the one fold that SQL has no function for."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


@F.pandas_udf(T.StringType())
def html_unescape(text: pd.Series) -> pd.Series:
    import html

    return text.map(lambda t: None if t is None else html.unescape(t))


def utf8_bytes(text: Column, front: str = "\n ", end: str = " ") -> Column:
    """Entities undone, line breaks to blanks, stripped, padded, as UTF-8."""
    flat = strip(F.replace(html_unescape(text), F.lit("\n"), F.lit(" ")))
    return F.encode(F.concat(F.lit(front), flat, F.lit(end)), "UTF-8")

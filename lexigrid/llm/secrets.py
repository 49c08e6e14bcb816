"""Secret scans with column expressions only: patterns, and character Markov models.

Three patterns find assignments, access keys and long hexadecimal runs. Beyond
these, every run of 20 or more key characters is scored by two first-order
Markov models of characters, one fitted on random strings and one on ordinary
identifiers, numbers, paths and words. A run is a secret as well if its
log-likelihood ratio, and that over its pairs of characters, pass bars set on
held-out samples, or if a stretch of it between separators does, by bars of its own.

MarkovRatio.train() fits the models on labelled rows; default_model() on samples
that this module makes, SAMPLES of each kind.

Offsets are code points, end exclusive. A text is never shuffled: splitting by a
pattern gives the gaps, extracting gives the matches, and running sums of their
lengths give offsets.
"""

from __future__ import annotations

import math
import random
import re
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import col, free_name

_WORD = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = rf"""({_WORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: For these two, runs that fail the length hold no shorter match, so the length can stand in the pattern.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
RUN = "[A-Za-z0-9+/_=-]{20,}"
#: What runs are cut at, and how long a stretch is judged on its own.
SEPARATORS, STRETCH = "[+/_=-]", 16
KINDS = ("assign", "access", "hex", "random")
SAMPLES = 3000
_UNIT = 64  # scores are whole numbers of 1/64 nat
_BLOCK = 256

#: Frequent English words, words of programs, and words and word parts of German, French and Spanish, for the made samples.
_COMMON = (
    "the of and to in is that for with was this from have are not but all any can had her one our out day get has him his how man new now old see two way who boy did its let put say she too use "
    "time year people work first even good look world life over think also back after well because most where right being there should could would their which about other than then them these some into only "
    "data user name value type index list file path load save read write open close start stop count total size length width height color state status error message request response server client config default option "
    "service account address version update delete create insert select table column row key map node tree graph queue stack buffer cache thread process system manager handler factory builder helper util test main module "
    "package class object method function variable string number integer boolean array vector matrix image video audio text document page session connection database network host port domain email phone order product price "
    "customer supplier country region language english german french spanish national international information communication development government organization understanding responsibility administration environment "
    "nicht eine einer eines und der die das mit auf ist von dem den des sich auch werden haben schaft heit keit ung lich sch verein bericht arbeit gesellschaft entwicklung geschichte wissenschaft verantwortung "
    "que les des une dans pour par sur avec est qui plus mais elle tion ment eau eux aux ier oire que quelle mentation gouvernement developpement connaissance organisation "
    "los las del una por para como este esta cion mente dad ando iendo llo rra bueno pueblo ciudad desarrollo gobierno informacion comunicacion"
).split()


def _ordinary(rng: random.Random) -> str:
    """An identifier, path, number, rule or long word of 20 characters or more."""
    kind, out = rng.randrange(10), ""
    words = lambda: [rng.choice(_COMMON) for _ in range(rng.randint(3, 7))]
    while len(out) < 20:
        w = words()
        out += {
            0: "_".join(w),
            1: "".join(x.capitalize() for x in w),
            2: "-".join(w),
            3: "/".join(w) + "/",
            4: "".join(w),
            5: "".join(w).upper(),
            6: "_".join(w).upper(),
            7: rng.choice("-=_+/") * rng.randint(20, 60),
            8: "-".join(str(rng.randint(1, 2030)) for _ in range(6)),
            9: "".join(w) + str(rng.randint(1, 99)) + "-" + rng.choice(_COMMON),
        }[kind]
    return out


def _random(rng: random.Random) -> str:
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabet = rng.choice((lower + lower.upper() + digits + "+/", lower + lower.upper() + digits, lower + lower.upper() + digits + "-_", lower.upper() + digits, lower + digits, digits + "abcdef"))
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(20, 64)))


class MarkovRatio:
    """Log-likelihood ratio, random against ordinary, of each pair of ASCII characters.

    ordinary, chance: labelled samples, runs of key characters. Every second one
    is held out to set the bars: `tolerance` of the ordinary ones may pass each.
    """

    def __init__(self, ordinary: list[str], chance: list[str], tolerance: float = 0.001):
        logs = self._logs(ordinary[::2]), self._logs(chance[::2])
        self.table = [round(_UNIT * (c - o)) for o, c in zip(*logs)]
        held = ordinary[1::2]
        self.bar, self.mean = self._bars(held, tolerance)
        self.part_bar, self.part_mean = self._bars([p for s in held for p in re.split(SEPARATORS, s) if len(p) >= STRETCH], tolerance)

    @staticmethod
    def train(labelled: DataFrame, text_col: str = "text", label_col: str = "secret", max_rows: int = 20_000, tolerance: float = 0.001) -> "MarkovRatio":
        """Fitted on max_rows labelled strings at most (label true or 1: random), those with the least hashes; nulls in either column are left out."""
        rows = labelled.where(col(text_col).isNotNull() & col(label_col).isNotNull()).select(col(text_col).cast("string").alias("t"), col(label_col).cast("boolean").alias("y"))
        some = rows.orderBy(F.xxhash64("t"), "t", "y").limit(max_rows).collect()
        return MarkovRatio([r["t"] for r in some if not r["y"]], [r["t"] for r in some if r["y"]], tolerance)

    def _bars(self, held: list[str], tolerance: float) -> tuple[int, int]:
        """The score, and the score over the pairs, that all but `tolerance` of the held-out strings stay at or below."""
        scored = [(self.score(s), len(s) - 1) for s in held if len(s) > 1]
        if not scored:
            return 0, _UNIT // 2
        rank = int((1 - tolerance) * (len(scored) - 1))
        return max(0, sorted(s for s, _ in scored)[rank]), max(_UNIT // 2, sorted(s // n for s, n in scored)[rank])

    @staticmethod
    def _logs(samples: list[str]) -> list[float]:
        """log p(next | this) over the characters of RUN, smoothed by half a count."""
        used = sorted({c for c in map(chr, range(128)) if c.isalnum() or c in "+/_=-"})
        n = {}
        for s in samples:
            for a, b in zip(s, s[1:]):
                n[a, b] = n.get((a, b), 0) + 1
        out = [0.0] * (128 * 128)
        for a in used:
            whole = sum(n.get((a, b), 0) + 0.5 for b in used)
            for b in used:
                out[128 * ord(a) + ord(b)] = math.log((n.get((a, b), 0) + 0.5) / whole)
        return out

    def score(self, run: str) -> int:
        return sum(self.table[128 * ord(a) + ord(b)] for a, b in zip(run, run[1:]) if ord(a) < 128 and ord(b) < 128)

    def is_secret(self, run: str) -> bool:
        over = lambda s, bar, mean: self.score(s) > max(bar, mean * (len(s) - 1))
        return over(run, self.bar, self.mean) or any(over(p, self.part_bar, self.part_mean) for p in re.split(SEPARATORS, run) if len(p) >= STRETCH)


def made_samples(samples: int = SAMPLES, seed: int = 11) -> tuple[list[str], list[str]]:
    """Ordinary and random strings, 2 * samples of each."""
    rng = random.Random(seed)
    return [_ordinary(rng) for _ in range(2 * samples)], [_random(rng) for _ in range(2 * samples)]


@cache
def default_model() -> MarkovRatio:
    return MarkovRatio(*made_samples())


def _running(values: Column, step, zero: int) -> Column:
    """Running sum or maximum of an array of whole numbers, in blocks so that long arrays cost little more than their length."""
    z = F.lit(zero).cast("bigint")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int"))), lambda b: F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)))

    def grow(block: Column) -> Column:
        start = F.struct(z.alias("s"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(block, start, lambda a, x: F.struct(step(a["s"], x.cast("bigint")).alias("s"), F.array_append(a["out"], step(a["s"], x.cast("bigint"))).alias("out")))

    grown = F.transform(blocks, grow)
    start = F.struct(z.alias("s"), F.array().cast("array<bigint>").alias("out"))
    bases = F.aggregate(grown, start, lambda a, g: F.struct(step(a["s"], g["s"]).alias("s"), F.array_append(a["out"], a["s"]).alias("out")))["out"]
    return F.flatten(F.zip_with(grown, bases, lambda g, base: F.transform(g["out"], lambda x: step(base, x))))


def _matched(text: Column, pattern: str, rank: int, keep) -> Column:
    """Array of (start, rank, end, body) of the matches that keep() likes."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    ends = _running(F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), F.transform(found, F.length), lambda g, m: g + m), lambda a, b: a + b, 0)
    spans = F.zip_with(ends, found, lambda e, m: F.struct((e - F.length(m)).alias("start"), F.lit(rank).alias("rank"), e.alias("end"), m.alias("body")))
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,body:string>>")
    return F.when(F.size(found) == 0, none).otherwise(F.filter(spans, lambda s: keep(s["body"])))


def _is_random(model: MarkovRatio):
    # a literal array once constants are folded
    table = F.split(F.lit(",".join(map(str, model.table))), ",").cast("array<int>")

    def over(body: Column, bar: int, mean: int) -> Column:
        codes = F.transform(F.split(body, ""), F.ascii)
        n = F.length(body) - 1
        steps = F.zip_with(F.slice(codes, F.lit(1), n), F.slice(codes, F.lit(2), n), lambda a, b: F.element_at(table, a * 128 + b + 1).cast("bigint"))
        score = F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)
        return (score > bar) & (score > n * mean)

    def keep(body: Column) -> Column:
        parts = F.filter(F.split(body, SEPARATORS), lambda p: F.length(p) >= STRETCH)
        return over(body, model.bar, model.mean) | F.exists(parts, lambda p: over(p, model.part_bar, model.part_mean))

    return keep


def _all_spans(text: Column, model: MarkovRatio) -> Column:
    every = F.lit(True)
    runs = [
        _matched(text, ACCESS, 1, lambda b: every),
        _matched(text, HEX, 2, lambda b: every),
        _matched(text, RUN, 3, _is_random(model)),
    ]
    assigned = _matched(text, ASSIGN, 0, lambda b: b.rlike(f"^({_WORD})" + r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}$"""))
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,body:string>>")
    # what these three match lies in a run, which most texts have none of
    found = F.concat(F.when(text.rlike(ASSIGN), assigned).otherwise(none), F.when(text.rlike(RUN), F.concat(*runs)).otherwise(none))
    return F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))))


def find_secrets(df: DataFrame, text_col: str = "text", spans: str = "secrets", model: MarkovRatio | None = None) -> DataFrame:
    """df with an array of struct(start, rank, end) added, by start, then rank; KINDS[rank] names the kind.

    A null or empty text has an empty array. The other columns pass through,
    whatever their names; `spans` must be a new one. Rows are judged one by one,
    so repeated rows get equal arrays and an empty table gives no rows.
    """
    if spans.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"df already has a column {spans}")
    return df.withColumn(spans, _all_spans(F.coalesce(col(text_col).cast("string"), F.lit("")), model or default_model()))


def named_spans(spans: Column, ranks: tuple[int, ...] = (0, 1, 2, 3)) -> Column:
    """kind:start:end, comma-joined, of the spans of these ranks."""
    kind = lambda r: F.element_at(F.array(*[F.lit(k) for k in KINDS]), r + 1)
    some = F.filter(spans, lambda s: s["rank"].isin(*ranks))
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", kind(s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact_secrets(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]", model: MarkovRatio | None = None) -> DataFrame:
    """df with every secret in its text replaced by `mark`; touching or overlapping secrets become one.

    All rows stay, repeated ones too, and texts without secrets, null and empty
    ones among them, stay as they are. Texts of any length are scanned whole. The
    other columns pass through, whatever their names. An empty table gives no rows.
    """
    name = free_name(df, "_secrets")
    found = find_secrets(df, text_col, name, model)
    text, spans = F.coalesce(col(text_col), F.lit("")), F.col(name)
    top = _running(F.transform(spans, lambda s: s["end"]), F.greatest, 0)
    # before each span: the text since the furthest end so far, and the mark unless it goes on from there
    before = F.concat(F.array(F.lit(-1).cast("bigint")), top)
    parts = F.zip_with(
        spans,
        F.slice(before, F.lit(1), F.size(spans)),
        lambda s, e: F.when(s["start"] > e, F.concat(F.substring(text, F.greatest(e, F.lit(0)).cast("int") + 1, (s["start"] - F.greatest(e, F.lit(0))).cast("int")), F.lit(mark))).otherwise(F.lit("")),
    )
    tail = F.substring(text, F.element_at(top, -1).cast("int") + 1, F.length(text))
    clean = F.when(F.size(spans) == 0, col(text_col)).otherwise(F.concat(F.array_join(parts, ""), tail))
    return found.select(*[clean.alias(c) if c == text_col else col(c) for c in df.columns])

"""URL filters: host and pattern rules, all found through their rarest literal token.

A rule has literal tokens (runs of letters and digits) that any url it fits must
hold as whole tokens: a host rule those of its host and of its path, a pattern
rule those it names. The one that fewest rules hold is the rule's key. A url's
own tokens look up candidate rules, and only those are tried: host rules on host
and path, pattern rules by running their regular expression.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import types as T

TOKEN = re.compile("[a-z0-9]+")
MAX_RULES = 200_000


def _lower(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


@dataclass(frozen=True)
class HostRule:
    """allow or block a host and its subdomains below a path; written host + path."""

    verdict: str
    host: str
    path: str

    @property
    def tokens(self) -> tuple[str, ...]:
        """Those of the host; and of the path those that something in it ends, as a url's path may go on."""
        inside = re.match("(?:.*[^A-Za-z0-9])?", self.path, re.DOTALL)[0]
        return tuple(TOKEN.findall(self.host) + TOKEN.findall(_lower(inside)))

    def fits(self, host: str, path: str) -> bool:
        return path.startswith(self.path) and (host == self.host or host.endswith("." + self.host))


@dataclass(frozen=True)
class PatternRule:
    """allow or block by a regular expression on the lower-cased url; tokens: what every match has as whole tokens, one at least."""

    verdict: str
    pattern: str
    tokens: tuple[str, ...]

    @cached_property
    def search(self):
        return re.compile(self.pattern).search


DEFAULT_PATTERNS = (
    *(PatternRule("block", rf"^[a-z]+://(?:[^/?#]*[.-])?{w}(?:[.-][^/?#]*)?(?:[/?#]|$)", (w,)) for w in ("casino", "poker")),
    *(PatternRule("block", rf"^[a-z]+://(?:[^/?#]*[.-])?{w}-[a-z]+[.-][^/?#]*(?:[/?#]|$)", (w,)) for w in ("adult", "porn", "xxx")),
    *(PatternRule("block", rf"^[a-z]+://(?:[^/?#]*\.)?{w}\.[^/?#]*(?:[/?#]|$)", (w,)) for w in ("ads", "adserver", "doubleclick")),
    PatternRule("block", r"/click/track/", ("click", "track")),
    PatternRule("block", r"/wp-login\.php(?:[?#]|$)", ("wp", "login", "php")),
    PatternRule("allow", r"^[a-z]+://help\.(?:[^/?#]*\.)?poker\.", ("help", "poker")),
)


def url_parts(url: str | None) -> tuple[str, str]:
    """(host with A-Z lower-cased, path); both empty for null or without ://."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((k for k in map(tail.find, "?#") if k >= 0), default=len(tail))
    return _lower(rest[:end]), tail[:stop]


class UrlFilter:
    """Judges urls. The rules are held whole in memory, so MAX_RULES bounds them."""

    def __init__(self, hosts: tuple[HostRule, ...], patterns: tuple[PatternRule, ...] = DEFAULT_PATTERNS):
        rules = [*hosts, *patterns]
        if len(rules) > MAX_RULES:
            raise ValueError(f"at most {MAX_RULES} rules")
        held_by = Counter(t for r in rules for t in set(r.tokens))
        self.keyed = defaultdict(list)
        for r in rules:
            if not r.tokens:
                raise ValueError(f"{r} has no literal token")
            self.keyed[min(r.tokens, key=lambda t: (held_by[t], t))].append(r)

    def candidates(self, url: str | None) -> list[HostRule | PatternRule]:
        """The rules whose key is among the url's tokens: all that can fit it."""
        return [r for t in set(TOKEN.findall(_lower(url or ""))) & self.keyed.keys() for r in self.keyed[t]]

    def judge(self, url: str | None) -> tuple[str, str, str | None, str]:
        """(host, path, host rule, verdict): the longest host rule (host and path together, then host) that fits; else block if a block pattern matches and no allow pattern does."""
        host, path = url_parts(url)
        some = self.candidates(url)
        fit = [r for r in some if isinstance(r, HostRule) and r.fits(host, path)] if host else []
        if fit:
            best = max(fit, key=lambda r: (len(r.host) + len(r.path), len(r.host)))
            return host, path, best.host + best.path, best.verdict
        low = _lower(url or "")
        found = {r.verdict for r in some if isinstance(r, PatternRule) and r.search(low)}
        return host, path, None, "block" if found == {"block"} else "allow"


def judge_urls(df: DataFrame, url_filter: UrlFilter, url_col: str = "url", names: tuple[str, str, str, str] = ("host", "path", "rule", "verdict")) -> DataFrame:
    """df with host, path, rule (null if no host rule fits) and verdict (allow or block) added.

    A null url, or one without ://, has an empty host and path, fits no host rule
    and is judged by the patterns alone (a null one is allowed). A url of any
    length is judged whole. The other columns pass through; `names` must be new.
    Each row is judged on its own, so repeated rows are judged alike and an empty
    table gives no rows.
    """
    if taken := {c.lower() for c in df.columns} & {n.lower() for n in names}:
        raise ValueError(f"df already has columns {sorted(taken)}")
    at = df.columns.index(url_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = [url_filter.judge(u) for u in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([g[k] for g in got], type=pa.string()) for k in range(4))], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *(T.StructField(n, T.StringType()) for n in names)]))

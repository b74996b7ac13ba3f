"""URL filters: rules indexed by their rarest literal token (operator 7).

Two kinds of rules, compiled to regular expressions:

* host rules (allow or block): a host and a path prefix; a rule fits its host
  and all subdomains where the path starts with the rule's path, and the
  longest fitting rule decides;
* pattern rules, which decide the other urls: ``||`` anchors at the start of a
  host label, ``|`` at either end of the url, ``*`` matches anything, ``^`` a
  separator or the end; ``@@`` in front makes an exception. A url that a block
  pattern matches and no exception does is blocked, any other is allowed.

Every rule is filed under one literal token that each matching url must hold
whole: the one rarest among the tokens of the urls at hand (counted over all
urls). A url's tokens fetch its candidate rules, and only those run their
regular expression; rules without a sure token are always candidates.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; path: from there up to ``?``, ``#`` or the end. A null url and one
without ``://`` have both empty; pattern rules still see the url's text. Equally
long host rules: the longer host, then block. Ids may repeat or be null; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import map_arrow

TOKEN = re.compile("[a-z0-9]+")
MARK = "\x00"               # between host and path; cannot end a host label

# The host rules (verdict, host, path).
HOST_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
# The pattern rules.
PATTERN_RULES = (
    "||ads-track.", "||adult-x.", "||casino-win.", "||cheap-pills.", "||free-bets.", "||spam-farm.",
    "||doubleclick.net^", "/adserver/", "/banner/*/img^", "/popunder.", "^affiliate_id=", "^clickid=*^sub=",
    ".exe|", "@@||spam-farm.*/appeal^", "@@/robots.txt|",
)


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str            # allow or block
    regex: str
    tokens: tuple[str, ...]  # literal tokens that every match holds whole
    kind: str               # host or pattern
    rank: tuple = ()        # order among fitting host rules


def host_rule(verdict: str, host: str, path: str) -> Rule:
    tokens = TOKEN.findall(host)
    inner = path if not path or not TOKEN.fullmatch(path[-1].lower()) else re.sub("[A-Za-z0-9]+$", "", path)
    tokens += TOKEN.findall(inner.lower())
    return Rule(host + path, verdict, rf"(?s)(?:[^{MARK}]*\.)?{re.escape(host)}{MARK}{re.escape(path)}",
                tuple(tokens), "host", (len(host + path), len(host), verdict == "block"))


def pattern_rule(text: str) -> Rule:
    verdict, body = ("allow", text[2:]) if text.startswith("@@") else ("block", text)
    rest, regex = body.lower(), ""
    if rest.startswith("||"):
        regex, rest, left_sure = r"\A[^:/?#]*://(?:[^/?#]*\.)?", rest[2:], True
    elif rest.startswith("|"):
        regex, rest, left_sure = r"\A", rest[1:], True
    else:
        left_sure = False
    right_sure = rest.endswith("|")
    rest = rest[:-1] if right_sure else rest
    for ch in rest:
        regex += {"*": ".*", "^": r"(?:[^a-z0-9_.%-]|\Z)"}.get(ch) or re.escape(ch)
    sure = []
    for m in TOKEN.finditer(rest):
        before, after = rest[m.start() - 1:m.start()], rest[m.end():m.end() + 1]
        if (before != "*" and (before or left_sure)) and (after != "*" and (after or right_sure)):
            sure.append(m.group())
    return Rule(text, verdict, "(?s)" + regex + (r"\Z" if right_sure else ""), tuple(sure), "pattern")


def default_rules() -> list[Rule]:
    return [host_rule(*r) for r in HOST_RULES] + [pattern_rule(p) for p in PATTERN_RULES]


class RuleIndex:
    def __init__(self, rules: Iterable[Rule], counts: dict[str, int]):
        self.by_token: dict[str, list] = {}
        self.always: list = []
        for r in rules:
            entry = (r, re.compile(r.regex))
            if r.tokens:
                rarest = min(r.tokens, key=lambda t: (counts.get(t, 0), -len(t), t))
                self.by_token.setdefault(rarest, []).append(entry)
            else:
                self.always.append(entry)

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, str | None]:
        """``(host, path, rule, verdict, pattern)`` of one url."""
        url = url or ""
        host, path = split_url(url)
        lower = url.lower()
        best, blocked, excepted = None, None, None
        place = f"{host}{MARK}{path}" if "://" in url else None
        found = [e for t in set(TOKEN.findall(lower)) for e in self.by_token.get(t, ())]
        for rule, regex in [*found, *self.always]:
            if rule.kind == "host":
                if place is not None and regex.match(place) and (best is None or rule.rank > best.rank):
                    best = rule
            elif regex.search(lower):
                if rule.verdict == "block":
                    blocked = min(blocked or rule.name, rule.name)
                else:
                    excepted = min(excepted or rule.name, rule.name)
        pattern = excepted or blocked
        if best:
            return host, path, best.name, best.verdict, pattern
        return host, path, None, "block" if blocked and not excepted else "allow", pattern


_UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def split_url(url: str) -> tuple[str, str]:
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    rest = re.split("[?#]", rest, maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_UPPER), slash + path


def token_counts(pages: DataFrame, rules: list[Rule], url_col: str) -> dict[str, int]:
    """How many urls hold each token of the rules (one row per rule token)."""
    wanted = sorted({t for r in rules for t in r.tokens})
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(url_col), F.lit("([a-z0-9]+)"), 1))
    held = F.array_intersect(tokens, F.array(*map(F.lit, wanted)))
    rows = pages.select(F.explode(held).alias("t")).groupBy("t").count().collect()
    return {r["t"]: r["count"] for r in rows}


def filter_urls(pages: DataFrame, rules: list[Rule] | None = None, id_col: str = "page_id",
                url_col: str = "url") -> DataFrame:
    """One row per input row: ``page_id, host, path, rule, verdict, pattern``."""
    rules = rules or default_rules()
    counts = token_counts(pages, rules, url_col)
    kind = dict(pages.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(rules, counts)
        for b in batches:
            got = [index.judge(u) for u in b.column(1).to_pylist()]
            cols = [pa.array([g[i] for g in got], pa.string()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=[
                "page_id", "host", "path", "rule", "verdict", "pattern"])

    return map_arrow(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")), run,
                     f"page_id {kind}, host string, path string, rule string, verdict string, pattern string")

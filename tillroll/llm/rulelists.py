"""Rule lists of any length for the URL filter (operator 7).

``read_list`` reads text files of rules, one a line; ``filter_by_list`` judges
urls by them as ``urlrules.filter_urls`` does by rules given in code.

A line ``allow HOST/PATH`` or ``block HOST/PATH`` is a host rule, any other a
pattern rule in the syntax of ``urlrules``. Blank lines and those that begin
with ``!`` are comments; a line that occurs twice counts once.

* A list of at most ``INDEXED_RULES`` rules and ``INDEXED_BYTES`` bytes becomes
  an index in every task.
* A longer one stays a table. Each distinct url is judged once: its tokens are
  joined to the rules filed under their rarest token (counted over all distinct
  urls), and only these run their regular expression. Adaptive execution splits
  a token that very many urls hold. Rules without a sure token concern every
  url; they go over the urls in blocks of about ``LOOSE_BLOCK``.

Both ways give the same rows, one per input row: ``page_id, host, path, rule,
verdict, pattern``; of several patterns that match, the smallest exception, else
the smallest block pattern, is named. A null url counts as an empty one. Ids may
repeat or be null; very long urls and extra columns are fine; an empty list
allows every url; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.common import map_arrow, stage, text_or_empty
from tillroll.llm.urlrules import MARK, TOKEN, Rule, filter_urls, host_rule, pattern_rule, split_url

INDEXED_RULES = 2_000
INDEXED_BYTES = 4 << 20
LOOSE_BLOCK = 1_000
RULE_FIELDS = ("name string, verdict string, regex string, tokens array<string>, kind string, "
               "length int, host_length int")
HIT_FIELDS = "url string, name string, verdict string, kind string, length int, host_length int"


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a rule list (a file or a folder of them), column ``value``."""
    return spark.read.text(path)


def parse_rule(line: str | None) -> Rule | None:
    line = (line or "").strip()
    if not line or line.startswith("!"):
        return None
    verdict, _, place = line.partition(" ")
    if verdict in ("allow", "block") and place.strip():
        host, slash, path = place.strip().partition("/")
        return host_rule(verdict, host.lower(), slash + path)
    return pattern_rule(line)


def rule_table(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """The parsed rules, each once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rules = [r for r in map(parse_rule, b.column(0).to_pylist()) if r]
            ranks = [r.rank or (0, 0, False) for r in rules]
            yield pa.RecordBatch.from_arrays([
                pa.array([r.name for r in rules], pa.string()), pa.array([r.verdict for r in rules], pa.string()),
                pa.array([r.regex for r in rules], pa.string()),
                pa.array([sorted(set(r.tokens)) for r in rules], pa.list_(pa.string())),
                pa.array([r.kind for r in rules], pa.string()), pa.array([x[0] for x in ranks], pa.int32()),
                pa.array([x[1] for x in ranks], pa.int32())],
                names=["name", "verdict", "regex", "tokens", "kind", "length", "host_length"])

    return map_arrow(lines.select(F.col(line_col).cast("string").alias("line")), run, RULE_FIELDS).distinct()


def url_table(pages: DataFrame, url_col: str) -> DataFrame:
    """``url, host, path, tokens`` of every distinct url."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            urls = b.column(0).to_pylist()
            places = [split_url(u) for u in urls]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([h for h, _ in places], pa.string()),
                pa.array([p for _, p in places], pa.string()),
                pa.array([sorted(set(TOKEN.findall(u.lower()))) for u in urls], pa.list_(pa.string()))],
                names=["url", "host", "path", "tokens"])

    return map_arrow(pages.select(text_or_empty(url_col).alias("url")).distinct(), run,
                     "url string, host string, path string, tokens array<string>")


def filed(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """The rules with sure tokens, each under its rarest one (``token``)."""
    counts = urls.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("urls"))
    key = ["name", "verdict", "regex", "kind", "length", "host_length"]
    each = rules.select(*key, F.explode("tokens").alias("token"))
    order = F.struct(F.coalesce("urls", F.lit(0)), -F.length("token"), F.col("token"))
    return (each.join(counts, F.col("token") == F.col("t"), "left")
            .groupBy(*key).agg(F.min_by("token", order).alias("token")))


compiled = lru_cache(4096)(re.compile)


def fits(kind: str, regex: str, url: str, host: str, path: str) -> bool:
    if kind == "host":
        return "://" in url and compiled(regex).match(f"{host}{MARK}{path}") is not None
    return compiled(regex).search(url.lower()) is not None


def token_hits(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """The rules that fit a url, among those its tokens fetch."""
    probes = urls.select("url", "host", "path", F.explode("tokens").alias("t"))
    found = probes.join(filed(rules, urls), F.col("t") == F.col("token"))
    rows = found.select("url", "name", "verdict", "kind", "length", "host_length",
                        F.col("host"), F.col("path"), F.col("regex"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.to_pydict()
            held = [fits(*x) for x in zip(c["kind"], c["regex"], c["url"], c["host"], c["path"], strict=True)]
            yield b.select(range(6)).filter(pa.array(held, pa.bool_()))

    return map_arrow(rows, run, HIT_FIELDS)


def loose_hits(rules: list, urls: DataFrame) -> DataFrame:
    """The fits of one block of rules without a sure token; of the patterns only
    the ones that count: the least of either verdict."""
    block = [tuple(r) for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = []
            for u, h, p in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                least = {}
                for name, verdict, regex, kind, n, m in block:
                    key = (verdict, name if kind == "host" else None)
                    if (key not in least or name < least[key][1]) and fits(kind, regex, u, h, p):
                        least[key] = (u, name, verdict, kind, n, m)
                hits += least.values()
            cols = list(zip(*hits, strict=True)) or [()] * 6
            kinds = [pa.string()] * 4 + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                             names=["url", "name", "verdict", "kind", "length", "host_length"])

    return map_arrow(urls.select("url", "host", "path"), run, HIT_FIELDS)


def filter_by_join(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The verdicts by rules that stay a table (``rule_table``), of any length."""
    urls = stage(url_table(pages, url_col), "urls")
    loose = rules.where(F.size("tokens") == 0).select("name", "verdict", "regex", "kind", "length", "host_length")
    blocks = -(-loose.count() // LOOSE_BLOCK)
    parts = [token_hits(rules.where(F.size("tokens") > 0), urls)]
    for i in range(blocks):
        mine = loose.where(F.pmod(F.xxhash64("name", "verdict"), F.lit(blocks)) == i)
        parts.append(loose_hits(mine.collect(), urls))
    hits = reduce(DataFrame.unionByName, parts)
    block = F.col("verdict") == "block"
    pattern = F.col("kind") == "pattern"
    best = F.struct("length", "host_length", block.alias("blocks"), "name", "verdict")
    judged = hits.groupBy(F.col("url").alias("u")).agg(
        F.max(F.when(~pattern, best)).alias("best"),
        F.min(F.when(pattern & block, F.col("name"))).alias("blocked"),
        F.min(F.when(pattern & ~block, F.col("name"))).alias("excepted"))
    known = (urls.select("url", "host", "path").join(judged, F.col("url") == F.col("u"), "left")
             .select("url", "host", "path", F.col("best")["name"].alias("rule"),
                     F.coalesce(F.col("best")["verdict"],
                                F.when(F.col("blocked").isNotNull() & F.col("excepted").isNull(), "block"),
                                F.lit("allow")).alias("verdict"),
                     F.coalesce("excepted", "blocked").alias("pattern")))
    rows = pages.select(F.col(id_col).alias("page_id"), text_or_empty(url_col).alias("url"))
    return rows.join(known, "url").select("page_id", "host", "path", "rule", "verdict", "pattern")


def filter_by_list(pages: DataFrame, lines: DataFrame, id_col: str = "page_id", url_col: str = "url",
                   line_col: str = "value") -> DataFrame:
    """One row per row of ``pages``, judged by the rules of ``lines``."""
    rules = stage(rule_table(lines, line_col), "rules")
    size = rules.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("regex")).alias("bytes"),
                     F.sum(F.size("tokens")).alias("tokens")).first()
    if not size["tokens"] or size["n"] > INDEXED_RULES or size["bytes"] > INDEXED_BYTES:
        return filter_by_join(pages, rules, id_col, url_col)
    held = [Rule(r["name"], r["verdict"], r["regex"], tuple(r["tokens"]), r["kind"],
                 (r["length"], r["host_length"], r["verdict"] == "block") if r["kind"] == "host" else ())
            for r in rules.collect()]
    return filter_urls(pages, held, id_col, url_col)

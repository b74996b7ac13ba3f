"""Rule lists of any length against every rule tried on every url."""

import re

import pytest

from tests.llm.helpers import SF
from tillroll.llm import rulelists as L
from tillroll.llm import urlrules as U

LINES = ["! a comment", "", "  ", None, "allow org/", "block example.org/es/", "block example.org/en/1",
         "allow Example.org/en/1", "block com", "||ads-track.", "/popunder.", "a*b", "*", "@@/robots.txt|",
         "@@^id=7^", "@@||spam-farm.*/appeal^", "||spam-farm.", "/popunder.", ".exe|", "|ftp:"]
URLS = [None, "", "no mark", "http://", "https://EXAMPLE.org/en/12?x", "http://sub.example.org/es/1",
        "http://example.org/es", "http://notexample.org/es/1", "http://x.com/robots.txt", "HTTP://X.COM/a.exe",
        "ftp://q.net/a", "http://ads-track.net/?id=7&b", "http://spam-farm.io/x/appeal", "http://spam-farm.io/x",
        "http://q.net/popunder.js", "http://q.net/popunder.js", "http://q.net/" + "ab/" * 40_000,
        "http://İK.net/İ", "x\nhttp://a.com/\n.exe"]


def brute(urls, lines):
    rules = {(r.name, r.verdict, r.kind): r for r in map(L.parse_rule, lines) if r}.values()
    out = []
    for page, url in urls:
        url = url or ""
        host, path = U.split_url(url)
        hosts = [r for r in rules if r.kind == "host" and "://" in url
                 and re.match(r.regex, f"{host}{U.MARK}{path}")]
        hit = [r for r in rules if r.kind == "pattern" and re.search(r.regex, url.lower())]
        block = min((r.name for r in hit if r.verdict == "block"), default=None)
        free = min((r.name for r in hit if r.verdict == "allow"), default=None)
        best = max(hosts, key=lambda r: r.rank, default=None)
        verdict = best.verdict if best else "block" if block and not free else "allow"
        out.append((page, host, path, best and best.name, verdict, free or block))
    return sorted(out, key=repr)


def rows(df):
    assert df.columns == ["page_id", "host", "path", "rule", "verdict", "pattern"]
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("indexed, block", [(2_000, 1_000), (0, 1_000), (0, 1)])
@pytest.mark.parametrize("dropped", [(), ("*", "a*b", "|ftp:")])
def test_both_ways_equal_all_rules_on_all_urls(spark, monkeypatch, indexed, block, dropped):
    monkeypatch.setattr(L, "INDEXED_RULES", indexed)
    monkeypatch.setattr(L, "LOOSE_BLOCK", block)
    lines = [x for x in LINES if x not in dropped]
    urls = [*enumerate(URLS), (3, URLS[4]), (None, URLS[5]), (3, URLS[4])]
    pages = spark.createDataFrame([(p, u, "t", "h") for p, u in urls], "page_id long, url string, token string, host string")
    got = L.filter_by_list(pages, spark.createDataFrame([(x,) for x in lines], "value string"))
    assert rows(got) == brute(urls, lines)


def test_long_list_over_all_pages(spark, tmp_path):
    """More rules than an index takes: hosts, paths and words of the urls themselves."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    urls = [tuple(r) for r in pages.select("page_id", "url").collect()]
    parts = sorted({w for _, u in urls for w in re.findall("[a-z0-9]+", (u or "").lower())})
    lines = [f"||{w}." for w in parts[::3]] + [f"/{w}^" for w in parts[1::3]] + [f"@@{w}|" for w in parts[2::3]]
    lines += [f"{'block' if i % 2 else 'allow'} {h}{p[:k]}" for i, (h, p) in enumerate(
        sorted({U.split_url(u or "") for _, u in urls})) for k in (1, 4) if h]
    lines += [f"||never-{i}.example^" for i in range(L.INDEXED_RULES)]
    path = tmp_path / "rules.txt"
    path.write_text("\n".join(lines))
    got = L.filter_by_list(pages, L.read_list(spark, str(path)))
    assert rows(got) == brute(urls, lines)


@pytest.mark.parametrize("indexed", [0, 2_000])
def test_empty_tables_and_lists(spark, monkeypatch, indexed):
    monkeypatch.setattr(L, "INDEXED_RULES", indexed)
    schema = "page_id long, url string"
    none, some = spark.createDataFrame([], schema), spark.createDataFrame([(1, "http://a.com/x"), (2, None)], schema)
    lines = spark.createDataFrame([(x,) for x in LINES], "value string")
    assert rows(L.filter_by_list(none, lines)) == []
    assert rows(L.filter_by_list(some, lines.limit(0))) == [
        (1, "a.com", "/x", None, "allow", None), (2, "", "", None, "allow", None)]


def test_rules_join_under_their_rarest_token(spark, monkeypatch):
    """A url meets only the rules its tokens fetch: those of other tokens run nowhere."""
    urls = spark.createDataFrame([(f"http://a.com/{i}",) for i in range(20)] + [("http://rare.com/ads",)], "url string")
    rules = L.rule_table(spark.createDataFrame([("block rare.com/",), ("/ads^",)], "value string"))
    got = {(r["name"], r["token"]) for r in L.filed(rules, L.url_table(urls, "url")).collect()}
    assert got in ({("rare.com/", "rare"), ("/ads^", "ads")},)

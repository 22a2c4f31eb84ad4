"""Verdicts on addresses beside plain rules, and both ways of meeting the rules."""

import pytest

from seasonwise.llm import url_filters
from seasonwise.llm.queries import QUERIES, URL_RULES

SF_DIR = "/root/testdata/sf0.01"
URLS = [None, "", "no address", "ads.example.com", "http://", "http://example.org",
        "http://example.org/", "HTTP://WWW.EXAMPLE.ORG/es/1", "http://example.org/ES/1",
        "http://notexample.org/es/1", "http://example.org.net/es/1", "https://a.b.example.org/en/1",
        "https://example.org/en/128?x=://y", "https://example.org/en/2#/en/1",
        "https://example.org?/es/", "https://user@example.org:80/es/", "ftp://x.com/fr/a",
        "ftp://x.com/de/a/fr/", "x://com/de/", "http://casino.example.net/", "http://ex.net/ads",
        "http://ex.net/adsl", "http://ex.net/a?q=cheap-PILLS", "http://ex.net/loads/ads.js",
        "http://ünet.net/bet", "http://ex.net/\nads\n", "http://ex.net/a*b(c)[d]{e}$f|g^h\\i"]
RULES = [("prefix", "net/a*b(c)[d]{e}$f|g^h\\i", "block"), ("prefix", "net/", "allow"),
         ("prefix", "net/", "allow"), ("prefix", "example.org/", "block"),
         ("prefix", "example.org/", "allow"), ("prefix", "example.org/es/", "allow"),
         ("pattern", "||x.com^", "block"), ("pattern", "|ftp*fr", "allow"),
         ("pattern", "ads", "block"), ("pattern", "*", "allow"), ("pattern", "address|", "block"),
         ("pattern", "(c", "block"), ("prefix", None, "block"), ("odd", "net/", "block"),
         ("pattern", "zzz", None), ("pattern", "q", "perhaps")]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:].split("?", 1)[0].split("#", 1)[0]
    return host, path


def longest(url, rules):
    host, path = split(url)
    fitting = [(r, v) for r, v in rules
               if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0]))
               and path.startswith(r[r.index("/"):])]
    return min(fitting, key=lambda f: (-len(f[0]), f[0], f[1] != "block"), default=(None, None))


def frame(spark, urls):
    return spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)],
                                 "page_id long, url string, host string, _hits string")


def test_contract_rules_on_odd_addresses(spark):
    table = url_filters.rules(spark, URL_RULES, [])
    rows = url_filters.judge(frame(spark, URLS), table).collect()
    assert len(rows) == len(URLS)
    for row in rows:
        rule, verdict = longest(URLS[row.page_id], URL_RULES)
        assert (row.host, row.path) == split(URLS[row.page_id])
        assert (row.rule, row.verdict) == (rule, verdict or "allow"), URLS[row.page_id]


def test_patterns(spark):
    table = url_filters.rules(spark, [], [(p, "block") for p in url_filters.PATTERNS])
    blocked = {URLS[r.page_id] for r in url_filters.judge(frame(spark, URLS), table).collect()
               if r.verdict == "block"}
    assert blocked == {"ads.example.com", "http://casino.example.net/", "http://ex.net/ads",
                       "http://ex.net/a?q=cheap-PILLS", "http://ex.net/loads/ads.js",
                       "http://ünet.net/bet", "http://ex.net/\nads\n"}


def test_wildcards_anchors_and_exceptions(spark):
    table = url_filters.rules(spark, [], [("||x.com^", "block"), ("|ftp*fr", "allow"),
                                          ("address|", "block"), ("(c", "block")])
    verdicts = {URLS[r.page_id]: r.verdict
                for r in url_filters.judge(frame(spark, URLS), table).collect()}
    assert verdicts["ftp://x.com/fr/a"] == "allow" and verdicts["no address"] == "block"
    assert verdicts["http://ex.net/a*b(c)[d]{e}$f|g^h\\i"] == "block"
    assert sum(v == "block" for v in verdicts.values()) == 2


def test_rules_as_literal_text(spark):
    table = spark.createDataFrame(RULES, "kind string, rule string, verdict string")
    prefixes = [(r, v) for k, r, v in RULES if k == "prefix" and r]
    for row in url_filters.judge(frame(spark, URLS), table).collect():
        rule, verdict = longest(URLS[row.page_id], prefixes)
        assert row.rule == rule and (verdict is None or row.verdict == verdict)


def test_joined_rules_give_the_same(spark):
    table = spark.createDataFrame(RULES, "kind string, rule string, verdict string")
    pages = frame(spark, URLS + URLS[:9] + ["http://example.org/es/"] * 50)
    rows = [sorted(map(repr, url_filters.judge(pages, table, most_held=n).collect()))
            for n in (0, 100)]
    assert rows[0] == rows[1] and len(rows[0]) == len(URLS) + 59


def test_rules_are_filed_under_their_rarest_whole_token(spark):
    table = url_filters.rules(spark, [("example.org/en/1", "block"), ("org/", "allow")],
                              [("ads", "block"), ("^rare^example^", "block")])
    urls = spark.createDataFrame([("http://example.org/en/1",), ("http://example.org/",),
                                  ("http://b.org/",), (None,)], "url string")
    tokens = {r["rule"]: r["token"] for r in url_filters.filed(table, urls).collect()}
    assert tokens == {"example.org/en/1": "en", "org/": "org", "ads": None,
                      "^rare^example^": "rare"}


@pytest.mark.parametrize("most_held", [0, 100])
def test_empty_tables(spark, most_held):
    rules = url_filters.rules(spark, URL_RULES, [])
    assert url_filters.judge(frame(spark, []), rules, most_held=most_held).count() == 0
    none = rules.filter("rule = 'none'")
    rows = url_filters.judge(frame(spark, URLS), none, most_held=most_held).collect()
    assert len(rows) == len(URLS) and {r.verdict for r in rows} == {"allow"}


def test_no_python_runs(spark):
    plan = QUERIES["op12_url_filters"](spark, SF_DIR)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_whole_table(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    rows = QUERIES["op12_url_filters"](spark, SF_DIR).collect()
    assert sorted(r.page_id for r in rows) == sorted(urls)
    for row in rows:
        rule, verdict = longest(urls[row.page_id], URL_RULES)
        assert (row.host, row.path, row.rule) == (*split(urls[row.page_id]), rule)
        assert verdict is None or row.verdict == verdict
    assert {r.verdict for r in rows if r.rule is None} == {"allow", "block"}

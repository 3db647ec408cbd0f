import pytest

from wirepulse.llm import url_filter
from wirepulse.llm.queries import URL_RULES
from wirepulse.llm.url_filter import UrlTrie, filter_urls

CASES = {
    "https://a.com/x": ("a.com", "/x", "com/", "allow"),
    "http://Example.COM/en/1": ("example.com", "/en/1", "example.com/en/", "block"),
    "http://www.example.com/en/1?q=/fr/": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
    "http://blog.example.com/en": ("blog.example.com", "/en", "com/", "allow"),
    "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
    "http://x.net/fr/#a": ("x.net", "/fr/", "net/fr/", "block"),
    "http://x.net/de/fr/": ("x.net", "/de/fr/", None, "allow"),
    "http://net": ("net", "", None, "allow"),
    "http://com": ("com", "", None, "allow"),
    "http://com?a": ("com", "", None, "allow"),
    "no scheme com/": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
}


def results(df):
    return {r.url: (r.host, r.path, r.rule, r.verdict) for r in df.collect()}


def test_cases_and_repeated_rows(spark):
    df = spark.createDataFrame([(u, "old") for u in [*CASES, "http://com"]], "url string, host string")
    out = filter_urls(df, URL_RULES)
    assert results(out) == CASES and out.count() == len(CASES) + 1
    assert filter_urls(df.filter("false"), URL_RULES).count() == 0


def test_rule_tables_beyond_the_trie_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(u,) for u in CASES], "url string")
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    assert results(filter_urls(df, rules)) == CASES
    monkeypatch.setattr(url_filter, "MAX_TRIE_RULES", 2)
    assert results(filter_urls(df, rules)) == CASES


@pytest.mark.parametrize(("path", "want"), [("/ab", "h/a"), ("/b", None), ("/ab/c", "h/ab/"), ("/a", "h/a")])
def test_rules_may_end_inside_a_segment(path, want):
    trie = UrlTrie([("block", "h", "/a"), ("allow", "h", "/ab/")])
    assert (trie.find("h", path) or (None,))[0] == want


def test_block_wins_a_tie():
    assert UrlTrie([("allow", "h", "/"), ("block", "h", "/"), ("allow", "h", "/")]).find("h", "/x") == ("h/", "block")

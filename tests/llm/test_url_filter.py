import pytest

from fleetgauge.llm.queries import URL_RULES
from fleetgauge.llm.url_filter import Trie, judge_urls, rule, split_url


@pytest.mark.parametrize(
    ("url", "parts"),
    [
        (None, ("", "")),
        ("no scheme", ("", "")),
        ("HTTP://WWW.Example.COM/Aé?x#y", ("www.example.com", "/Aé")),
        ("x://h#f/p", ("h", "")),
        ("a://b://c/d", ("b:", "//c/d")),
        ("://", ("", "")),
    ],
)
def test_parts(url, parts):
    assert split_url(url) == parts


@pytest.mark.parametrize(
    ("url", "found"),
    [
        ("http://a.com/", ("com/", "allow")),
        ("http://a.com", None),
        ("http://example.com/en/x", ("example.com/en/", "block")),
        ("http://a.example.com/en/", ("example.com/en/", "block")),
        ("http://a.example.com/en", ("com/", "allow")),
        ("http://b.www.example.com/en/x", ("www.example.com/en/", "allow")),
        ("http://notexample.com/en/", ("com/", "allow")),
        ("http://x.net/es/1", ("net/es/", "block")),
        ("http://x.net/es", None),
        ("http://com/", ("com/", "allow")),
        ("http:///en/", None),
    ],
)
def test_longest_rule(url, found):
    assert Trie(URL_RULES).longest(*split_url(url)) == found


def test_a_last_part_without_slash_is_a_prefix():
    trie = Trie([rule("block", "a.b/x/pre"), rule("allow", "a.b/x/prefix"), rule("block", "b")])
    assert trie.longest("a.b", "/x/prefixed") == ("a.b/x/prefix", "allow")
    assert trie.longest("a.b", "/x/prey") == ("a.b/x/pre", "block")
    assert trie.longest("a.b", "/y") == ("b", "block")


def test_odd_rows(spark):
    rows = [(1, None, 1), (1, None, 1), (None, "http://x.net/fr/", 2), (3, "", 3), (4, "http://h.com/" + "a/" * 50_000, 4)]
    found = judge_urls(spark.createDataFrame(rows, "page_id long, url string, host int"), URL_RULES)
    got = {(r.page_id, r.host, r.rule, r.verdict) for r in found.collect()}
    assert got == {(1, "", None, "allow"), (None, "x.net", "net/fr/", "block"), (3, "", None, "allow"), (4, "h.com", "com/", "allow")}
    assert found.count() == 5
    assert judge_urls(spark.createDataFrame([], "page_id long, url string"), URL_RULES).count() == 0

import pytest

from gridloom.llm.url_filter import RULES, SOFT, STRICT, VOCABULARY, RuleSet, Vocabulary, filter_urls, host_and_path, term_table


def test_split(spark):
    want = {"HTTP://A.Example.COM/En/x?y#z": ("a.example.com", "/En/x"), "x://h?q://r/": ("h", ""), "no-scheme/path": ("", ""), "a://ÀB#f": ("Àb", ""), "x://": ("", ""), "x://a\nb/c\nd?": ("a\nb", "/c\nd"), None: ("", "")}
    urls = spark.createDataFrame([(u,) for u in want], "url string")
    assert {r[0]: (r[1], r[2]) for r in urls.select("url", *host_and_path(urls["url"])).collect()} == want


def test_rules_against_a_plain_search():
    hosts = ["com", "example.com", "www.example.com", "m.www.example.com", "xample.com", "net", "a.net", "example.com:80", ""]
    paths = ["", "/", "/en/", "/en", "/en/1", "/es/1", "/fr/"]
    for h in hosts:
        for p in paths:
            fit = [(len(a + b), a + b, v) for a, b, v in RULES if (h == a or h.endswith("." + a)) and p.startswith(b)]
            want = max(fit)[1:] if fit else (None, None)
            assert RuleSet(RULES).longest(h, p) == want


def test_vocabulary():
    v = Vocabulary(term_table(VOCABULARY, 1000))
    assert v.hits("http://casino.x/") == (1, 0, 0) and v.hits("http://casinova.x/") == (0, 0, 0)
    assert v.hits("http://a.x/FREE-bet/free") == (0, 2, 2) and v.hits("x://middlesex.uk/sextant") == (0, 0, 0) and v.hits(None) == (0, 0, 0)
    assert v.hits("http://www.spam-farm.x/") == (1, 2, 2)
    assert len(STRICT) == len(set(STRICT)) and len(SOFT) == len(set(SOFT)) and not set(STRICT) & set(SOFT)


def test_weights_from_a_table(spark):
    table = spark.createDataFrame([("One", "soft", 1), ("two", "soft", 2), ("big", "soft", 9), ("bad", "strict", 1), (None, "soft", 1), ("two", "soft", 1)], "term string, kind string, weight int")
    pages = spark.createDataFrame([(u,) for u in ("x://one/two", "x://big", "x://one/one", "x://big/one", "x://bad")], "url string")
    got = [(r["n_strict"], r["n_soft"], r["verdict"]) for r in filter_urls(pages, vocabulary=table, soft_limit=4).collect()]
    assert got == [(0, 2, "allow"), (0, 1, "allow"), (0, 1, "allow"), (0, 2, "block"), (1, 0, "block")]
    with pytest.raises(ValueError):
        filter_urls(pages, vocabulary=table, most_terms=3)
    assert {r["verdict"] for r in filter_urls(pages, vocabulary=()).collect()} == {"allow"}


def test_edge_cases(spark):
    rows = [(1, None, "h"), (1, None, "h"), (2, "", None), (3, "x://casino.org/" + "a" * 100000, "h"), (None, "x://q.net/fr/?", "h"), (5, "x://cheap.org/loan", "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = sorted(((r["page_id"], r["host"], r["rule"], r["verdict"]) for r in filter_urls(pages).collect()), key=str)
    assert got == sorted([(1, "", None, "allow"), (1, "", None, "allow"), (2, "", None, "allow"), (3, "casino.org", None, "block"), (None, "q.net", "net/fr/", "block"), (5, "cheap.org", None, "block")], key=str)
    assert filter_urls(pages.limit(0)).count() == 0

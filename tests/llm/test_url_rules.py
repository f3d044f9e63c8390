import re

from threadwise.llm import queries
from threadwise.llm import url_rules as u

URLS = [
    None, "", "nothing", "http://", "http://org/", "http://ORG/", "http://a.org", "http://a.org/x", "https://A.Example.ORG/es/1?q=/en/1", "http://example.org/en/12",
    "http://example.org/en/2", "http://notexample.org/es/", "http://x.com/fr/9", "http://x.com/FR/9", "http://x.com/de/casino/", "http://y.net/my-Casino-site", "http://y.net/casinos",
    "http://x.com?/de/", "http://x.com#/de/", "ftp://u:p@sub.com:80/de/", "http://example.org/es", "http://É.org/é", "://com/de/", "http://a\nb.org/x", "http://com/de/" + "a/" * 5000,
]
RULES = (*queries.HOST_RULES, *(("block", w, None) for w in queries.BLOCKED_WORDS))


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in queries.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        _, rule, verdict = max(fits)
        return host, path, rule, verdict
    bad = any(re.search(rf"(?i)(^|[^0-9A-Za-z]){w}([^0-9A-Za-z]|$)", host + path) for w in queries.BLOCKED_WORDS)
    return host, path, None, "block" if bad else "allow"


def test_equal_to_brute_force(spark):
    rows = [(i, x) for i, x in enumerate(URLS + URLS[5:12])]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in u.judge(pages, u.rule_table(spark, queries.url_rule_list())).collect()}
    assert got == {i: plain(x) for i, x in rows}


def test_keys_are_the_rarest_literals():
    assert u.host_rule("block", "example.org", "/en/1").literals == ("example", "org", "en")
    assert u.host_rule("allow", "org", "/").literals == ("org",)
    assert u.host_rule("allow", "org", "").literals == ()


def test_rule_without_literal_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://b.net/")], "page_id long, url string")
    catch = u.rule_table(spark, [u.UrlRule("all", "block", "x$", (), True)])
    assert {r.page_id: (r.rule, r.verdict) for r in u.judge(pages, catch).collect()} == {1: ("all", "block"), 2: (None, "allow")}
    rules = u.rule_table(spark, queries.url_rule_list())
    assert u.judge(pages.limit(0), rules).collect() == []
    assert {r.verdict for r in u.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_clashing_names_and_no_python(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", "old", 3, "t")], "page_id long, url string, host string, verdict int, _token string")
    judged = u.judge(pages, u.rule_table(spark, queries.url_rule_list()))
    (r,) = judged.collect()
    assert (r.host, r.rule, r._token) == ("a.org", "org/", "t")
    assert "Python" not in judged._jdf.queryExecution().executedPlan().toString()

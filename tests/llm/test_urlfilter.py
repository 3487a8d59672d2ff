"""URL filter: rules by hand, and the models against a plain recursive form."""

import math
from collections import Counter, defaultdict

from calibra.llm import urlfilter as U
from calibra.llm.queries import QUERIES, URL_RULES

from tests.conftest import SF001


def brute_prob(texts, order):
    """p(c | context) by Witten-Bell, asked recursively."""
    count, after = Counter(), defaultdict(set)
    for s in texts:
        for i in range(1, len(s)):
            for n in range(0, min(order, i) + 1):
                count[s[i - n:i + 1]] += 1
                after[s[i - n:i]].add(s[i])

    def p(context, c):
        below = p(context[1:], c) if context else 1 / U.ALPHABET
        total = sum(count[context + x] for x in after[context])
        d = len(after[context])
        return (count[context + c] + d * below) / (total + d) if total else below

    return p


def brute_score(s, accept, reject, order=4):
    return sum(math.log(accept(s[max(0, i - order):i], s[i])) - math.log(reject(s[max(0, i - order):i], s[i])) for i in range(1, len(s))) / (len(s) - 1)


def test_scores_equal_plain_form(spark):
    rows = QUERIES["op6_url_filter"](spark, SF001).collect()
    text = {(r.host, r.path): U.START + r.host + r.path + U.END for r in rows}
    accept = brute_prob([text[r.host, r.path] for r in rows if r.rule and URL_RULES[r.rule] == "allow"], 4)
    reject = brute_prob([text[r.host, r.path] for r in rows if r.rule and URL_RULES[r.rule] == "block"], 4)
    assert len(rows) == spark.read.parquet(f"{SF001}/pages.parquet").count()
    for r in rows:
        assert math.isclose(r.score, brute_score(text[r.host, r.path], accept, reject), rel_tol=1e-9, abs_tol=2e-9)
        assert r.verdict == URL_RULES[r.rule] if r.rule else r.verdict in ("allow", "block")
    free = [r for r in rows if not r.rule]
    assert max((r.score for r in free if r.verdict == "block"), default=-9) < min((r.score for r in free if r.verdict == "allow"), default=9)


def test_parts_and_rules(spark):
    cases = [
        ("http://Example.COM/en/1?x#y", "example.com", "/en/1", "example.com/en/"),
        ("http://www.example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/"),
        ("x://a.www.example.com/en/", "a.www.example.com", "/en/", "www.example.com/en/"),
        ("https://notexample.com/en/", "notexample.com", "/en/", "com/"),
        ("https://m.site.net/es/9#t", "m.site.net", "/es/9", "net/es/"),
        ("https://net/fr/", "net", "/fr/", "net/fr/"),
        ("https://site.net/de/", "site.net", "/de/", None),
        ("https://example.com", "example.com", "", None),
        ("https://example.com?q=/en/", "example.com", "", None),
        ("https://É.com/EN/", "É.com", "/EN/", "com/"),
        ("a://b://c/d", "b:", "//c/d", None),
        ("no scheme.com/", "", "", None), ("", "", "", None), (None, "", "", None),
    ]
    df = spark.createDataFrame([(k, u) for k, (u, *_) in enumerate(cases)], "k int, url string")
    host, path = U.host_of(df.url), U.path_of(df.url)
    got = df.select("k", host.alias("h"), path.alias("p"), U.rule_of(host, path, URL_RULES).alias("r")).orderBy("k").collect()
    assert [(r.h, r.p, r.r) for r in got] == [tuple(c[1:]) for c in cases]


def test_odd_rows(spark):
    urls = ["http://good.com/a", "http://good.com/b", "http://bad.net/es/x", "http://bad.net/fr/x", "http://good.org/a", "http://bad.org/es/x",
            None, "", "http://good.org/" + "a/" * 5000]
    pages = spark.createDataFrame([(k, u, "z") for k, u in enumerate(urls * 2)], "page_id long, url string, host string")
    got = sorted((r.page_id, r.rule, r.verdict) for r in U.judge(pages.where("page_id < 9"), URL_RULES).collect())
    assert len(got) == 9 and [v for _, _, v in got[:4]] == ["allow", "allow", "block", "block"]
    assert U.judge(pages, URL_RULES).count() == 18
    one_sided = U.judge(pages.where("page_id < 2 or page_id = 5"), URL_RULES).collect()
    assert {r.verdict for r in one_sided} == {"allow"}
    assert U.judge(pages.where("false"), URL_RULES).count() == 0


def test_a_hot_url_is_one_row_before_it_is_dealt(spark):
    pages = spark.createDataFrame([(k, "http://same.org/x" if k % 3 else f"http://h{k}.{'com' if k % 2 else 'net'}/{'es' if k % 2 == 0 else 'a'}/{k}")
                                   for k in range(90)] + [(None, None)], "page_id long, url string")
    got = U.judge(pages, {"com/": "allow", "net/es/": "block"}).collect()
    same = {(r.score, r.verdict) for r in got if r.host == "same.org"}
    assert len(got) == 91 and len(same) == 1

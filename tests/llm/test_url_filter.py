import pytest
from pyspark.sql import functions as F

from tamhis.llm import url_filter as U
from tamhis.llm.queries import URL_RULES, op6_url_filter

URLS = [None, "", "no scheme", "http://", "http://A.com", "HTTP://Example.COM/EN/", "http://example.com/en/x?q#f", "https://www.example.com/en/1",
        "http://m.www.example.com/en/", "http://notexample.com/en/", "x://y.net/es/?a=://b", "http://a.net/fr", "http://u@h.net:80/fr/#x",
        "ftp://b.org?x/y", "http://c.org#/z", "http://é.org/ü/\nq", "http://a.com/" + "9" * 3000, "http://é.ÀB.net/fr/", "://net/fr/x"]


def plain(url):
    head, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:end], rest[end:]
    stop = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:stop]


def plain_rule(host, path):
    fits = [(v, r) for v, r in URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and
            path.startswith(r[r.index("/"):])]
    return max(fits, key=lambda x: len(x[1]), default=(None, None))


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS + URLS[:3])), "page_id long, url string").selectExpr("*", "1 AS host", "2 AS score")
    got = {r.page_id: r for r in U.judge(pages, URL_RULES).collect()}
    assert len(got) == len(URLS) + 3
    for i, url in enumerate(URLS):
        host, path = plain(url)
        verdict, rule = plain_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), url
        assert got[i].verdict == (verdict or ("block" if got[i].score >= 0.5 else "allow"))
    assert got[len(URLS)].verdict == got[0].verdict and U.judge(pages.limit(0), URL_RULES).count() == 0


def test_rules(spark):
    rules = [("block", "b.a/"), ("allow", "a/x"), ("block", "a/"), ("allow", "a/")]
    df = spark.createDataFrame([("b.a", "/"), ("c.b.a", "/x"), ("a", "/xy"), ("ba", "/"), ("a", "")], "h string, p string")
    rule = U.matching_rule(F.col("h"), F.col("p"), rules)
    assert [r[0] for r in df.select(rule).collect()] == ["b.a/", "b.a/", "a/x", None, None]
    with pytest.raises(ValueError):
        U.matching_rule(F.col("h"), F.col("p"), [("allow", f"{i}/") for i in range(U.MAX_RULES + 1)])


def test_features(spark):
    url = "http://a-b.c12.org/x/yy/?p=1&q=2#f"
    df = spark.createDataFrame([(url,), (None,)], "url string")
    first, none = df.select(*[c.alias(n) for n, c in U.lexical(F.col("url"), U.host(F.col("url")), U.path(F.col("url"))).items()]).collect()
    import math
    from collections import Counter
    share = [n / len(url) for n in Counter(url).values()]
    assert first.entropy == pytest.approx(-sum(p * math.log2(p) for p in share))
    assert (first.depth, first.labels, first.parameters, first.fragment, first.hyphens, first.longest_label) == (2, 3, 2, 1, 1, 3)
    assert first.digit_ratio == pytest.approx(4 / len(url)) and (none.length, none.entropy, none.labels) == (0, 0, 0)


def test_trees_learn_from_labelled_urls(spark):
    rows = [(f"http://{'casino-win-' if i % 2 else 'news'}{i}.org/p/{i}", i % 2) for i in range(400)]
    model = U.UrlModel(spark.createDataFrame(rows[:300] + rows[:5] + [(None, 1), ("http://x.org", None)], "url string, label int"))
    test = spark.createDataFrame(rows[300:], "url string, label int").withColumns({"host": U.host(F.col("url")), "path": U.path(F.col("url"))})
    scored = model.scores(test.withColumnRenamed("label", "truth")).collect()
    assert sum((r.score >= 0.5) == bool(r.truth) for r in scored) > 95
    one = U.UrlModel(spark.createDataFrame(rows[1:2], "url string, label int")).scores(test)
    assert {r.score for r in one.collect()} == {1.0}


def test_trees_and_suffix_rates_cover_all_labelled_urls(spark):
    # only the suffix tells the class; 1,500 suffixes and 6,000 urls a class
    rows = [(f"http://s{i:04d}.org/{j}", i % 2) for i in range(1500) for j in range(8)]
    urls = spark.createDataFrame(rows, "url string, truth int")
    model = U.UrlModel(urls.withColumnRenamed("truth", "label"))
    assert model.suffixes.filter("n = 2").count() == 1500
    assert model.trees.trees[0]._call_java("rootNode").impurityStats().count() == len(rows)
    got = model.scores(urls.withColumns({"host": U.host(F.col("url")), "path": U.path(F.col("url"))})).collect()
    assert len(got) == len(rows) and all((r.score >= 0.5) == bool(r.truth) for r in got)


def test_no_python_in_the_plan(spark):
    plan = op6_url_filter(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan

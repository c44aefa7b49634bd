import numpy as np
import pytest
from pyspark.sql import functions as F

from bomspark.llm.registry import URL_RULES
from bomspark.llm.url_filter import filter_urls, host_edges, propagate


def judged(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int, m string")
    return {r.page_id: r for r in filter_urls(pages, URL_RULES).collect()}


def test_rules_longest_wins(spark):
    got = judged(spark, [(1, "http://A.B.Example.COM/en/x?q#f", "", 1, ""), (2, "https://www.example.com/en/1", "", 1, ""), (3, "http://x.com/fr", None, 1, ""), (4, "http://y.net/es/?a", "", 1, ""), (5, "http://y.net/de/", "", 1, ""), (6, "http://notcom/en/", "", 1, ""), (7, "http://x.com", "", 1, ""), (8, None, "", 1, ""), (9, "no-scheme.com/en/", "", 1, ""), (10, "http://x.com?u=/en/", "", 1, ""), (10, "http://x.com?u=/en/", "", 1, "")])
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.b.example.com", "/en/x", "example.com/en/", "block")
    assert (got[2].rule, got[2].verdict) == ("www.example.com/en/", "allow")
    assert (got[3].rule, got[3].verdict) == ("com/", "allow")
    assert (got[4].rule, got[4].verdict, got[4].path) == ("net/es/", "block", "/es/")
    assert got[5].rule is None and got[6].rule is None and got[7].rule is None and got[10].path == ""
    assert got[8].host == got[9].host == got[8].path == "" and got[8].verdict == "allow"


def test_distrust_spreads_to_hosts_that_link_to_blocked_ones(spark):
    link = '<a href="http://bad.net/es/1">x</a>'
    rows = [(i, "http://bad.net/es/%d" % i, "", 0, "") for i in range(3)] + [(10, "http://farm.org/a", link, 0, ""), (11, "http://clean.org/a", '<a href="/bad.net">', 0, ""), (12, "http://ok.com/a", '<A HREF=//liked.org/z>', 0, ""), (13, "http://liked.org/z", link, 0, "")]
    got = judged(spark, rows)
    assert got[10].verdict == "allow" and got[11].verdict == "allow"  # 0.425 each: below the threshold
    got = judged(spark, [r for r in rows if r[0] != 13])
    assert got[10].verdict == "block" and got[11].verdict == "allow"


def test_propagation_equals_dense_iteration(spark):
    names = list("abcdef")
    links = [(0, 1), (1, 2), (2, 0), (3, 1), (4, 5), (1, 5), (0, 2)]
    pages = spark.createDataFrame([(f"http://{names[a]}/", f'<a href="http://{names[b]}/p">') for a, b in links], "url string, html string")
    seeds = spark.createDataFrame([("a", 1.0, 0.0), ("f", 0.0, 1.0), ("d", 0.5, 0.25)], "host string, good double, bad double")
    got = {r.host: (r.trust, r.distrust) for r in propagate(seeds, host_edges(pages)).collect()}
    m = np.zeros((6, 6))
    for a, b in links:
        m[a, b] = 1
    good, bad = np.array([1, 0, 0, 0.5, 0, 0]), np.array([0, 0, 0, 0.25, 0, 1])
    t, d = good.copy(), bad.copy()
    out, into = np.maximum(m.sum(1), 1), np.maximum(m.sum(0), 1)
    for _ in range(400):
        t, d = good + 0.85 * (t / out) @ m, bad + 0.85 * m @ (d / into)
    for i, name in enumerate(names):
        assert got.get(name, (0, 0)) == (pytest.approx(t[i], abs=1e-5), pytest.approx(d[i], abs=1e-5))


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert filter_urls(pages, URL_RULES).count() == 0
    assert host_edges(pages).agg(F.count("*")).first()[0] == 0


def test_a_cycle_is_carried_on_to_its_fixed_point(spark):
    pages = spark.createDataFrame([("http://a/", '<a href="http://b/">'), ("http://b/", '<a href="http://a/">')], "url string, html string")
    seeds = spark.createDataFrame([("a", 0.0, 0.14)], "host string, good double, bad double")
    got = {r.host: r.distrust for r in propagate(seeds, host_edges(pages)).collect()}
    assert got == {"a": pytest.approx(0.14 / (1 - 0.85**2), abs=1e-5), "b": pytest.approx(0.14 * 0.85 / (1 - 0.85**2), abs=1e-5)}
    with pytest.raises(RuntimeError):
        propagate(seeds, host_edges(pages), iterations=8)


def test_a_long_chain_is_followed_to_its_end(spark):
    pages = spark.createDataFrame([(f"http://h{i}/", f'<a href="http://h{i + 1}/">') for i in range(25)], "url string, html string")
    seeds = spark.createDataFrame([("h25", 0.0, 1.0)], "host string, good double, bad double")
    got = {r.host: r.distrust for r in propagate(seeds, host_edges(pages)).collect()}
    assert got == {f"h{i}": pytest.approx(0.85 ** (25 - i), abs=1e-5) for i in range(26)}

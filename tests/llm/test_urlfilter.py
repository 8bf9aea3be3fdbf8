import duckdb
import pytest
from pyspark.sql import Row

from flowlens.llm import urlfilter as U
from flowlens.llm.components import connected_components

PAGES = "page_id long, url string, html string, host string"


def _judge(spark, rows, rules=U.RULES, edges=None):
    pages = spark.createDataFrame(rows, PAGES)
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    out = U.judge_urls(pages, table, edges).collect()
    return sorted(out, key=lambda r: (r.id is None, r.id or 0, r.url or ""))


def test_rules_and_parts(spark):
    rows = [(1, "HTTP://WWW.Example.NET/en/1?x#y", None, "clash"), (2, "http://a.example.net/fr/1", "", None),
            (3, "http://example.com/de/x", "", None), (4, "http://x.org/fr/", "", None),
            (5, None, "<p>", None), (6, "no scheme", "", None), (7, "https://net", "", None),
            (8, "http://anet/", "", None), (8, "http://anet/", "", None), (None, "http://b.net/", "", None)]
    got = [(r.id, r.host, r.path, r.rule, r.verdict) for r in _judge(spark, rows)]
    assert got == [(1, "www.example.net", "/en/1", "example.net/en/", "allow"),
                   (2, "a.example.net", "/fr/1", "net/", "block"),
                   (3, "example.com", "/de/x", "example.com/de/", "block"),
                   (4, "x.org", "/fr/", "org/fr/", "allow"), (5, "", "", None, "allow"),
                   (6, "", "", None, "allow"), (7, "net", "", None, "allow"),
                   (8, "anet", "/", None, "allow"), (8, "anet", "/", None, "allow"),
                   (None, "b.net", "/", "net/", "block")]


ALIASES = [
    (1, "http://a.example.com/x/1", '<link rel="canonical" href="http://b.net/1">', None),
    (2, "http://a.example.com/x/2", "<META content=\"0; URL='/x/1#top'\" http-equiv=refresh>", None),
    (3, "http://a.example.com/x/3", '<!-- <link rel=canonical href="http://b.net/1"> -->', None),
    (4, "http://a.example.com/x/4?q=1", '<link href="//k.org/fr/" rel="canonical"/>', None),
    (5, "http://a.example.com/x/5", '<link rel=canonical href="4?q=1"><link rel=canonical href=http://b.net/>', None),
    (6, "http://a.example.com/x/6", '<script>"<link rel=canonical href=http://b.net/>"</script>', None),
    (7, "http://A.example.com/x/2#part", "", None)]


def test_aliases_take_blocks_unless_allowed(spark):
    got = {r.id: r.verdict for r in _judge(spark, ALIASES)}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "block"}


def test_sql_agrees(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", [r[:3] for r in ALIASES])
    exp = {r[0]: (r[1], r[2], r[3], r[4]) for r in con.execute(U.ORACLE_SQL).fetchall()}
    got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in _judge(spark, ALIASES)}
    assert got == exp


DOTS = [
    (1, "http://f.com/x/q", '<link rel=canonical href="http://b.net/1">', None),
    (2, "http://f.com/a/p", '<link rel=canonical href="./../x/q">', None),
    (3, "http://f.com/x/p", '<link rel=canonical href="./q">', None),
    (4, "http://f.com/x/r", '<link rel=canonical href="../../../x/./y/../q">', None),
    (5, "http://f.com/", '<link rel=canonical href="http://c.net">', None),
    (6, "http://g.com/u", '<link rel=canonical href="http://F.com">', None),
    (7, "http://g.com/v", '<link rel=canonical href="http://f.com?z=1">', None),
    (8, "http://g.com/w", '<link rel=canonical href="http://f.com/x//q">', None),
    (9, "http://g.com/k/", '<link rel=canonical href="http://b.net/1">', None),
    (10, "http://g.com/k/m", '<link rel=canonical href=".">', None),
    (11, "http://g.com/k/m/n", '<link rel=canonical href="..">', None),
    (12, "http://g.com/k/.hidden", '<link rel=canonical href="...">', None)]


def test_dot_segments_and_empty_paths_name_the_same_page(spark):
    got = {r.id: r.verdict for r in _judge(spark, DOTS)}
    assert {i for i, v in got.items() if v == "block"} == {1, 2, 3, 4, 5, 6, 9, 10, 11}
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", [r[:3] for r in DOTS])
    assert {r[0]: r[4] for r in con.execute(U.ORACLE_SQL).fetchall()} == got


def test_long_rule_list_joins_to_the_same(spark):
    rows = [(i % 7, f"http://s{i % 5}.h{i % 11}.net/p{i % 3}/q", "", None) for i in range(60)]
    rules = [(f"h{i}.net", f"/p{j}", "block" if (i + j) % 2 else "allow") for i in range(11) for j in range(2)]
    rules += [("net", "/", "block"), ("s1.h3.net", "/p", "allow"), ("s1.h3.net", "/p", "block")]
    short = _judge(spark, rows, rules)
    long = _judge(spark, rows, rules + [(f"zz{i}.com", "/", "block") for i in range(80)])
    assert sorted(map(repr, short)) == sorted(map(repr, long))


def test_extra_edges_and_empty(spark):
    edges = spark.createDataFrame([Row(u="http://p.com/1", v="http://b.net/")])
    assert _judge(spark, [(1, "http://p.com/1", None, None)], edges=edges)[0].verdict == "block"
    assert _judge(spark, []) == []


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(1, 2), (2, 1), (None, 3)], [(i, i + 1) for i in range(40)],
    [(7, i) for i in range(30)] + [(100 + i, 100 + i * 7 % 13) for i in range(13)]])
def test_components(spark, edges):
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}
    for u, v in edges:
        if u is not None and v is not None and u != v:
            root.setdefault(u, u), root.setdefault(v, v)
    for _ in root:
        for u, v in edges:
            if u in root and v in root:
                root[u] = root[v] = min(root[u], root[v])
    assert got == root

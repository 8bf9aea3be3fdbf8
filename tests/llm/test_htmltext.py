import html
import random
import re
import time

import pytest

from flowlens.llm import htmltext as H
from flowlens.llm import common as C

CASES = [
    ("", ""), ("plain  text &amp; more", "plain text & more"), ("<p>a<p>b", "a\nb"),
    ("<body><nav>menu</nav><article><h1>T</h1><p>one <b>two</b>\n three<br>four</p><script>var x='</p>';</script></article><footer>f</footer>",
     "T\none two three four"),
    ("<main><p>x</p><aside>no</aside><form><p>no</p></form><div class='ad-slot ads'>no</div><ul><li>i<li>j</ul></main><p>out</p>", "x\ni\nj"),
    ("<article><p>body</p><section id=comments><p>me too</p></section><div class='cookieNotice notice'>no</div></article>", "body"),
    ("<article><p>caf&eacute;&nbsp;&#x41;&#66;<!-- c --> d</p></article>", "café AB d"),
    ("<div class=header>h</div><div><p>text of the page</p><p>goes on</p></div><div role=navigation>n</div>", "text of the page\ngoes on"),
    ("<article><p title='a>b'>q</p><p>un<b>closed <p>next</article>", "q\nunclosed\nnext"),
    ("<p>a < b and c</p><style>p{}</style><title>t</title>", "a < b and c"),
    ("<article><header><h1>Head</h1></header><p>t</p></article><article class='comment'>no, much longer text here</article>", "Head\nt"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"), ("<article><p hidden>no</p>yes</article>", "yes"),
]


@pytest.mark.parametrize("page,want", CASES)
def test_main_text(page, want):
    assert H.main_text(page) == want


def test_match_equals_brute_force():
    rng = random.Random(2)

    def tree(depth):
        return [rng.choice("abc"), 1, {}, [tree(depth - 1) for _ in range(rng.randrange(4) if depth else 0)]]

    def best(a, b):
        if a[0] != b[0]:
            return 0

        def forest(x, y):
            if not x or not y:
                return 0
            return max(forest(x[1:], y), forest(x, y[1:]), best(x[0], y[0]) + forest(x[1:], y[1:]))

        return 1 + forest(a[3], b[3])

    for _ in range(200):
        a, b = tree(3), tree(3)
        assert H.match(a, b)[0] == best(a, b)


def _page(i, extra=""):
    return (f"<body><div><p>Welcome to our site</p></div><div><p>story {i} begins here</p><p>and goes on {i * 7}{' at length' * 20}</p>{extra}"
            "<p>Read more every day</p></div><div><p>All about us</p></div></body>")


def test_wrapper_drops_constant_blocks(spark):
    rows = [(i, f"http://h.org/{i}", _page(i), "clash", None) for i in range(12)]
    rows += [(20, None, _page(20), None, None), (21, "http://one.org/", _page(21), None, None), (22, "http://h.org/x", None, None, None),
             (23, "http://h.org/y", "", None, None), (None, "http://h.org/1", _page(1), None, None), (1, "http://h.org/1", _page(1), None, None)]
    rows += [(30 + i, f"http://copies.org/{i}", _page(5), None, None) for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, wrapper int").repartition(4)
    got = {r.id: r for r in H.extract(df).collect()}
    assert got[3].text == "story 3 begins here\nand goes on 21" + " at length" * 20 and got[3].n_chars == len(got[3].text)
    whole = "story {0} begins here\nand goes on {1}" + " at length" * 20 + "\nRead more every day"
    for i, k in ((20, 20), (21, 21), (33, 5)):
        assert got[i].text == whole.format(k, k * 7)
    assert got[22].text == got[23].text == "" and got[22].n_chars == 0
    assert got[None].text == got[1].text and H.extract(df).count() == len(rows)
    assert H.extract(df.limit(0)).count() == 0


def test_join_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = [(i, f"http://h{i % 2}.org/{i}", _page(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(repr, H.extract(df).collect()))
    monkeypatch.setattr(H, "BROADCAST_BYTES", 0)
    assert sorted(map(repr, H.extract(df).collect())) == want


def test_deep_and_long_pages():
    assert H.main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert H.main_text("<article>" + "<p>word</p>" * 20000 + "</article>").count("\n") == 19999
    assert H.main_text("<" * 5000 + "a" + "\"'" * 2000) != ""


MALFORMED = {"quotes": "<a " + "\"'" * 50, "one tag": " b='c' d=\"e\"", "quote marks": "'\"", "values": "<a a=\"v\" b='w' ", "scripts": "<script ", "divs": "<div>", "ends": "</p ",
             "open": "<", "comments": "<!-", "values without end": "<a x=\"", "paragraphs": "<p>a", "items": "<ul><li>",
             "cells": "<table><tr><td>", "texts": "a <b>b</b> &amp; ", "inline ends": "<b><i></b>", "classes": "<p class='a b'>x</p>",
             "links": "<div><a href=x>y</a>z</div>", "kinds": "<p>x</p><ul><li>y</ul>"}


@pytest.mark.parametrize("kind", MALFORMED)
def test_time_is_linear(kind):
    """Four times the page takes about four times as long: the limit of 8 leaves room for noise."""
    def took(size):
        page = MALFORMED[kind] * (size // len(MALFORMED[kind]))
        page = "<a " + page.replace("<", "") if kind in ("one tag", "quote marks") else page
        start = time.process_time()
        H.page_slots(page, None)
        return time.process_time() - start

    small = min(took(100_000) for _ in range(3))
    assert took(400_000) < 8 * small + 0.2


def test_ten_megabytes():
    page = "<article><p>word</p>" + "<a x=\"" * 700_000 + "<p>tail" + "<div><b>t</b>" * 400_000
    start = time.process_time()
    assert H.main_text(page).startswith("word") and time.process_time() - start < 60


def test_repeated_notice_goes_and_near_copies_stay(spark):
    """A longer unmarked notice on all pages of a host is template; what near copies share is not."""
    notice = "please read this long notice of ours " * 30
    rows = [(i, f"http://notice.org/{i}", f"<article><h1>title {i}</h1><p>short story {i}</p><p>{notice}</p></article>") for i in range(20)]
    copy = "<article><p>first part</p><p>second part</p><p>third part</p><p>{}</p></article>"
    rows += [(100 + i, f"http://copies.org/{i}", copy.format(f"changed {i} " * 60)) for i in range(20)]
    rows += [(200 + i, f"http://mixed.org/{i}", copy.format(f"changed {i} " * 60)) for i in range(20)]
    rows += [(300 + i, f"http://mixed.org/x{i}", f"<article><p>other {i}</p><p>story {i * 3}</p></article>") for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.id: r.text for r in H.extract(df).collect()}
    plain = {i: H.main_text(h) for i, _, h in rows}
    for i in range(20):
        assert got[i] == f"title {i}\nshort story {i}" != plain[i]
        assert got[100 + i] == plain[100 + i] and got[200 + i] == plain[200 + i]
    assert got[302] == "other 2\nstory 6"


def test_constants_are_counted_beyond_the_wrapper_nodes(spark, monkeypatch):
    """A host with more nodes than its wrapper keeps: slots by path find the repeated notice too."""
    monkeypatch.setattr(H, "NODES", 3)
    rows = [(i, f"http://h.org/{i}", f"<article><div class='s{i % 3}x'><p>story {i}</p><p>and {i * 3}</p></div>"
             f"<div class='end'><p>the same words</p></div></article>") for i in range(24)]
    got = {r.id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"story {i}\nand {i * 3}" for i in range(24)}


def test_fixed_texts_equal_brute_force(spark):
    rng = random.Random(8)
    pages = []
    for _ in range(150):
        host = rng.choice("abc")
        blocks = [{"slot": s, "key": rng.choice([7, 7, 7, 7, 7, 7, 7, rng.randrange(9)]) if s < 3 else rng.randrange(10 ** 6), "text": "t"}
                  for s in range(rng.randrange(1, 8))]
        pages += [(host, blocks)] * rng.choice([1, 1, 3])

    def counted(weighted):
        n, of = {}, {}
        for host, pairs, near in weighted:
            for table, keys in ((n, pairs), (of, {s for s, _ in pairs})):
                for k in keys:
                    table.setdefault((host, k), []).append(near)
        weigh = lambda v: v.count(False) + any(v)
        return {(h, p) for (h, p), v in n.items() if weigh(v) >= H.LEAST_PAGES and weigh(v) >= H.CONSTANT * weigh(of[h, p[0]])}

    once = {(h, tuple((b["slot"], b["key"]) for b in x)) for h, x in pages}
    first = counted([(h, set(x), False) for h, x in once])
    second = counted([(h, set(x), 2 * sum((h, p) in first for p in set(x)) > len(set(x))) for h, x in once])
    df = spark.createDataFrame(pages, "host string, blocks array<struct<slot: long, key: long, text: string>>")
    got = {(r.host, (f.slot, f.key)) for r in H.fixed_texts(df).collect() for f in r.fixed}
    assert first and got == {x for x in second if x[0] in {h for h, _ in first}}


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in C.table(spark, sf, "pages").collect()}
    out = H.query(spark, sf).collect()
    assert len(out) == len(pages)
    for r in out:
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?p>|</?h1>", inner)]
        assert r.text == "\n".join(x for x in parts if x) and r.n_chars == len(r.text)


@pytest.mark.parametrize("page,want", [
    ("<body><div class='content has-sidebar'><p>whole story</p></div></body>", "whole story"),
    ("<article class='post comments-open'><p>a story</p><div class='share-buttons'>no</div></article>", "a story"),
    ("<div id='content' class='no-sidebar'><h1>T</h1><p>text</p></div><div class=sidebar>no</div>", "T\ntext"),
    ("<div class='sidebar-layout'><article><p>story</p></article></div><p>out</p>", "story"),
    ("<div class='widget'><article class='sponsored'><p>story</p></article></div><p>out</p>", "story"),
    ("<div class='header-grid'><p>the long story of the day</p></div><p>end</p>", "the long story of the day"),
    ("<div class='widget'><p>only text</p><div class='comments'>no</div></div>", "only text"),
    ("<main><article><p>part one</p></article><p>x</p><article><p>and two, longer</p></article></main>", "part one\nand two, longer"),
    ("<article><p>one</p></article><article><p>two</p></article><section id=comments><article><p>a longer reply</p></article>"
     "<article><p>b</p></article></section><div class='related-posts'><article><p>teaser of another story</p></article></div>", "one\ntwo"),
    ("<div class='page'><p>text</p></div><ol class='comment-list'><li>longer than the whole text</li></ol>", "text"),
    ("<div class='page'><p>text</p></div><div class='cookie-banner'><p>we use cookies, as all the others do</p></div>", "text"),
])
def test_names_do_not_take_the_article(page, want):
    assert H.main_text(page) == want

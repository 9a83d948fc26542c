"""Wrapper induction: pages whose text is known, hosts in which the template shows, and
simple tree matching against a plain recursion."""

import html
import random
import re
import time


from alertweave.llm import common, html_extraction, page_tree, queries

from . import util

SCHEMA = "page_id bigint, url string, html string"


def run(spark, rows):
    return {r.page_id: r.text for r in html_extraction.extracted(spark.createDataFrame(rows, SCHEMA)).collect()}


def own(text):
    return html_extraction.main_text(text, None)


def article_of(page):
    """The blocks of a page of the given tables, by their known form."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(x for x in lines if x)


def test_the_given_pages(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op12_html_extraction(spark, sf)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    pages = {r.page_id: r for r in common.table(spark, sf, "pages").collect()}
    rows = got.collect()
    assert len(rows) == len(pages)
    assert all(r.text == article_of(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in rows)


def test_what_is_no_main_text():
    page = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header>Site</header>
    <div id="mainNav"><a href=/>Home</a></div><div class="cookie-notice">We use cookies</div>
    <main><article><header><h1>A &amp; B</h1><span>by someone</span></header><p>One<br>two &lt;b&gt; <b>three</b>
    <script>if (a < b) { "</p>" }</script><p>Four &#233;&nbsp;five<ul><li>six<li>seven</ul><span class="ad">buy</span>
    <table><tr><td>a<td>b</table><form><input><label>mail</label></form><div class="postComments"><p>nice</p></div></article></main>
    <aside>side</aside><div role="contentinfo">foot</div><div hidden>no</div><div style="display: none">no</div><!-- no --></body></html>"""
    assert own(page).split("\n") == ["A & B", "One two <b> three", "Four é five", "six", "seven", "a", "b"]


def test_odd_pages(spark):
    pages = [
        (1, None, None), (2, "https://a.example/", ""), (3, "no host", "plain text, 1 < 2 & 3"), (4, "https://a.example/x", "<p>unclosed <b>bold <p>next</i></div>"),
        (5, "https://A.example:80/", "<script>never closed <p>x"), (6, "x", "<!-- never closed <p>x"), (7, "x", "<a 'b <p>c</p>"), (8, None, "<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>after</p>"),
        (9, "x", "<p>" + "long " * 200_000 + "</p>"), (None, None, "<article><p>no id</p></article>"), (4, "https://a.example/x", "<p>unclosed <b>bold <p>next</i></div>"),
        (10, "x", "<h2>a</h2><p>b</p>" * 3000), (11, "x", "".join(f"<div class='{'x' * (i % 300)}'><p>t{i}</p></div>" for i in range(3000))), (12, "x", "<" * 50_000 + "</" * 50_000), (13, "x", "<p " + "a='" * 50_000),
        (14, "x", "<![CDATA[kept]]><p>a</p></p>b<br/>c<hr>d"),
    ]
    began = time.time()
    rows = html_extraction.extracted(util.clashing(spark.createDataFrame(pages, SCHEMA))).collect()
    assert time.time() - began < 90 and len(rows) == len(pages)
    got = {r.page_id: r.text for r in rows}
    assert got[1] == got[2] == got[5] == got[6] == "" and got[3] == "plain text, 1 < 2 & 3"
    assert got[4] == "unclosed bold\nnext" and got[8] == "deep\nafter" and got[None] == "no id"
    assert got[9] == " ".join(["long"] * 200_000) and got[10] == "\n".join(["a", "b"] * 3000)
    assert sorted(got[11].split("\n")) == sorted(f"t{i}" for i in range(3000)) and got[14] == "kept\na\nb c\nd"
    assert run(spark, []) == {}


def site(rng, n, host, copies=False):
    """Pages without telling elements: fixed lines around what differs."""
    for i in range(n):
        words = lambda k: " ".join(rng.choice("lorem ipsum dolor sit amet elit sed do".split()) for _ in range(k))
        title = "One title" if copies else f"Title {i} {words(3)}"
        body = ["the same body"] * 2 if copies else [words(rng.randint(5, 60)) for _ in range(rng.randint(1, 6))]
        page = f"<body><div class=top><div>{host} daily</div><ul><li><a href=1>Start</a></li><li><a href=2>World</a></li></ul></div><div class=box><h1>{title}</h1><div class=share>Tell others</div>{''.join(f'<p>{b}</p>' for b in body)}<div class=end>Thank you for reading</div></div><div class=base>All rights reserved</div></body>"
        yield f"https://{host}/{i}", page, "\n".join([title, *body])


def test_constant_nodes_are_template_and_varying_slots_content(spark):
    rng = random.Random(4)
    known = [*site(rng, 30, "one.example"), *site(rng, 20, "two.example")]
    got = run(spark, [(i, url, page) for i, (url, page, _) in enumerate(known)])
    assert [got[i] for i in range(len(known))] == [t for *_, t in known]


def test_copies_of_an_article_are_no_template(spark):
    known = [*site(random.Random(4), 12, "three.example", copies=True)]
    got = run(spark, [(i, url, page) for i, (url, page, _) in enumerate(known)])
    assert all("One title" in t and "the same body" in t for t in got.values())


def test_wrappers_are_the_same_however_pages_lie(spark):
    rng = random.Random(9)
    rows = [(i, url, page) for i, (url, page, _) in enumerate([*site(rng, 60, "one.example"), *site(rng, 3, "two.example")])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("host", html_extraction.host("url"))
    found = [sorted(map(tuple, html_extraction.induced(df.repartition(p).select("host", "html")).collect())) for p in (1, 7, 23)]
    assert found[0] == found[1] == found[2] and [h for h, _ in found[0]] == ["one.example", "two.example"]


def test_hosts_too_large_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(html_extraction, "BROADCAST_BYTES", 0)
    known = [*site(random.Random(4), 30, "one.example")]
    got = run(spark, [(i, url, page) for i, (url, page, _) in enumerate(known)])
    assert [got[i] for i in range(len(known))] == [t for *_, t in known]


def plain_matching(a, b):
    """Simple tree matching as it is defined."""
    if a.label != b.label:
        return 0
    m = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids, 1):
        for j, y in enumerate(b.kids, 1):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + plain_matching(x, y))
    return m[-1][-1] + 1


def random_tree(rng, depth):
    kids = [random_tree(rng, depth - 1) for _ in range(rng.randint(0, 4))] if depth else []
    return page_tree.Slot(rng.choice("abc"), 0, 1, [], 0, 0, False, False, kids)


def test_simple_tree_matching_against_its_definition():
    rng = random.Random(2)
    for _ in range(300):
        a, b = random_tree(rng, 3), random_tree(rng, 3)
        a.label = b.label = "r"
        pairs = page_tree.matched(a.kids, b.kids, {})
        assert pairs == sorted(pairs) and all(a.kids[i].label == b.kids[j].label for i, j in pairs)
        assert page_tree.size(a, b, {}) == plain_matching(a, b)


def test_host_of_a_url(spark):
    urls = ["https://User@WWW.Example.org:8080/a?b", "http://x.example", "mailto:me", None, "", " ftp://y.example#z"]
    got = spark.createDataFrame([(u,) for u in urls], "url string").select(html_extraction.host("url").alias("h")).collect()
    assert [r.h for r in got] == ["www.example.org:8080", "x.example", None, None, None, "y.example"]

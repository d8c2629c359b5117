from __future__ import annotations

import random
import time
import tracemalloc
from functools import lru_cache
from html.parser import HTMLParser

from pixelmill.llm.wrapper_induction import Page, Tree, constant_nodes, extract, parsed, simple_tree_matching


def page(*body: str, head: str = "") -> str:
    return f"<!DOCTYPE html><html><head><title>t</title>{head}</head><body>{''.join(body)}</body></html>"


def content(source: str) -> str:
    return " ".join(text for _, text in Page(source).content())


def test_markup_and_asides_go():
    source = page(
        '<nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy</div><header>Top</header>',
        '<div id="cookie-notice">We use cookies</div><script>var t="</p>";</script><style>p{}</style>',
        "<article><h1>Title &amp; more</h1><p>One <b>two</b>three.<br>four<p>five &lt;5&gt; &eacute; &#8212;\n  six</p>",
        '<form><input value="q"><button>Go</button></form><ul><li>first<li>second</ul><div class="comments"><p>Nice post</p></div></article>',
        '<aside>Side</aside><footer>&copy; me</footer>',
    )
    assert content(source) == "Title & more One twothree. four five <5> é — six first second"


def test_broken_and_empty_pages():
    assert content("") == "" and content("<") == "<" and content("plain  text") == "plain text"
    assert content("<article><p>open <b>bold<br><p>next") == "open bold next"
    assert content("<p>a</div></p></b>b") == "a b"
    assert content('<p title="a > b">x</p><script>never closed <p>y') == "x"
    assert content("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert content("<!-- no end <p>x") == "" and content("1 < 2 and 3 > 2") == "1 < 2 and 3 > 2"
    assert content("<main><p>in main</p></main><p>outside</p>") == "in main"
    assert content("<p>a<script>x</SCRIPT >b İ <style>y</STYLE>c") == "a b İ c"


def test_article_text_stays():
    """Names that only contain an aside's word, roles of own parts, and what main holds beside the article."""
    assert content('<article><p class="share-price">Shares rose 3%.</p><p>More.</p></article>') == "Shares rose 3%. More."
    assert content('<article><div class="promotion-history">How it grew</div><div id="social-history">Before 1900</div></article>') == "How it grew Before 1900"
    assert content('<article><section role="alert">Storm warning</section><p>Text</p></article>') == "Storm warning Text"
    assert content("<main><p>Intro in main.</p><article><p>Body.</p></article><p>After.</p></main><p>Off</p>") == "Intro in main. Body. After."
    assert content('<article><p>Text</p><div class="share-buttons">Share</div><ul class="comment-list"><li>Nice</ul><div class="cookie-notice">We</div></article>') == "Text"
    assert content('<div class="share-price">in no article</div><p>Text</p>') == "in no article Text"


def test_names_of_layouts_keep_the_article():
    """Names that blog software gives to what holds the article, or to the article itself."""
    for opened in ('<div class="layout has-sidebar"><main>', '<div class="with-sidebar"><article>', '<body class="single comments-open"><article>', '<article class="post comments-closed">', '<div class="layout sidebar"><article>', '<div class="right-sidebar"><main>', '<body class="page left-sidebar no-header"><p>'):
        assert content(f"{opened}<p>All of it.</p>") == "All of it."
    assert content('<div class="restaurant-menu-review"><p>Good food.</p></div><p class="share-price">Up 3%.</p>') == "Good food. Up 3%."
    assert content('<article><p>As <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> shows</p><object><p>Chart</p></object><noscript>Plain</noscript></article>') == "As x=1 shows Chart Plain"
    assert content('<article><p>Mine</p></article><div class="related"><article><p>Another</p></article></div><div id="comments"><article><p>Nice</p></article></div>') == "Mine"
    assert content('<article><p>Mine</p><article class="comment"><p>Nice</p></article></article><noscript>Turn it on</noscript>') == "Mine"
    assert content('<div class="site-header">Name</div><div id="main-nav">Go</div><div class="page-footer"><p>Us</p></div><div id="comments"><article>Hm</article></div><p>Text</p>') == "Text"


def test_open_elements_far_above_are_closed():
    deep = "<div>" * 400
    assert [t for _, t in Page(f"<ul><li>{deep}one<li>two</ul>").content()] == ["one", "two"]
    page = Page(f"<ul><li>{deep}one<li>two<ul><li>inner</ul>still two</ul><p>{'<b class=x>' * 50}p one<p>p two")
    parents = [page.parent[node] for node, _ in page.content()]
    texts = [t for _, t in page.content()]
    assert texts == ["one", "two", "inner", "still two", "p one", "p two"]
    assert page.label[parents[1]] == "ul" and parents[4] == parents[5] == 0


def random_page(rng: random.Random, depth: int = 3) -> str:
    if not depth:
        return rng.choice(["one", "two", "three"])
    tags = [rng.choice(["div", "section", "ul"]) for _ in range(rng.randint(0, 3))]
    return "".join(f"<{t}>{random_page(rng, depth - 1)}</{t}>" for t in tags) or "leaf"


def test_tree_matching_is_the_largest():
    rng = random.Random(5)
    for _ in range(200):
        a, b = parsed(random_page(rng))[2], parsed(random_page(rng))[2]
        below_a, below_b = a.children(), b.children()

        def worth(x, y, a=a, b=b):
            return 2 if a.marks[x] and a.marks[x] == b.marks[y] else 1

        @lru_cache(None)
        def best(xs, ys, a=a, b=b, below_a=below_a, below_b=below_b):
            if not xs or not ys:
                return 0
            found = max(best(xs[1:], ys), best(xs, ys[1:]))
            if a.paths[xs[0]] == b.paths[ys[0]]:
                found = max(found, worth(xs[0], ys[0]) + best(tuple(below_a[xs[0]]), tuple(below_b[ys[0]])) + best(xs[1:], ys[1:]))
            return found

        match = simple_tree_matching(a, b)
        assert sum(worth(x, y) for x, y in match.items()) == best((0,), (0,))
        assert len(set(match.values())) == len(match) and all(a.paths[x] == b.paths[y] for x, y in match.items())
        assert all(x == 0 or match[int(a.parents[x])] == b.parents[y] for x, y in match.items())
        constant = constant_nodes(a, b)
        assert len(set(constant)) == len(constant) and {int(b.marks[y]) for y in constant} <= set(a.marks.tolist()) - {0}


def test_alignment_keeps_the_order_of_constants():
    page_tree = parsed("<div><p>A</p><p>x1</p><p>B</p><p>C</p></div>")[2]
    ref_tree = parsed("<div><p>B</p><p>A</p><p>y</p><p>C</p></div>")[2]
    constant = constant_nodes(page_tree, ref_tree)
    assert len(constant) == 2 and [int(ref_tree.marks[y]) for y in sorted(constant)][1] == int(page_tree.marks[-1])


def test_pages_of_many_blocks():
    def long(own: str, n: int = 50_000) -> str:
        return page("<div><p>Box</p></div>" + "".join(f"<div><p>{own} {i % 40}</p></div>" if i % 3 else "<p>Same</p>" for i in range(n)))

    tracemalloc.start()
    began = time.perf_counter()
    a, b, small = parsed(long("a"))[2], parsed(long("b"))[2], parsed(page("<div><p>Box</p></div><p>Same</p><p>End</p>"))[2]
    assert len(constant_nodes(a, small)) == 2 and len(constant_nodes(a, b)) == 1 + 16_667
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 400 << 20 and time.perf_counter() - began < 120


def test_long_tables_and_lists_align_in_seconds():
    """Rows of their own beside cells that many rows share, shifted or in another order; 10,000 items."""

    def table(order) -> Tree:
        return parsed(page("<div><table>", *[f"<tr><td>name {i}</td><td>{'yes' if i % 3 else 'no'}</td></tr>" for i in order], "</table></div>"))[2]

    def items(order) -> Tree:
        return parsed(page("<ul>", *[f"<li><p>item {i}</p></li>" for i in order], "</ul>"))[2]

    began, n = time.perf_counter(), 5_000
    assert len(constant_nodes(table(range(n)), table(range(n + 1)))) == 2 * n
    assert len(constant_nodes(table(range(n)), table(range(1, n + 1)))) == 2 * n - 2
    assert len(constant_nodes(table(range(n)), table(range(n, -1, -1)))) >= n // 2
    assert len(constant_nodes(items(range(2 * n)), items(range(7, 2 * n + 7)))) == 2 * n - 7
    assert time.perf_counter() - began < 60


def test_only_alignment_finds_the_text(spark):
    """No article and no telling name: three layouts of a host, whose boxes stand before, between and after the text."""
    rows, number = [], 0
    for layout in range(3):
        for i in range(8):
            text = "".join(f"<p>Page {number} says {k}.</p>" for k in range(1 + i % 3))
            box, ends = f"<div><p>Box of layout {layout}</p></div>", "<div><p>All rights</p></div>"
            body = (f"{box}<section><div>{text}</div></section>{ends}", f"<div><div>{text}</div>{box}</div>{ends}", f"<section>{text}</section><section>{box}{ends}</section>")[layout]
            rows.append((number, f"https://plain.example.org/{layout}/{i}", page(body)))
            number += 1
    found = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {n: " ".join(f"Page {n} says {k}." for k in range(1 + n % 8 % 3)) for n in range(24)}


def test_constant_nodes_of_a_host_are_template(spark):
    def one(i: int, box: str = "Read all about it") -> str:
        return page(f"<div><p>{box}</p></div><div><h2>Head {i}</h2><p>Text of page {i}.</p><p>Shared by two.</p></div>" if i < 2 else f"<div><p>{box}</p></div><div><h2>Head {i}</h2><p>Text of page {i}.</p></div>")

    rows = [(i, f"https://a.example.com/{i}", one(i)) for i in range(8)]
    rows += [(20 + i, "http://b.example.com/x", one(0)) for i in range(9)]  # copies alone make no template
    rows += [(40, None, None), (41, "http://c.example.com", ""), (42, "nonsense", "<p>x</p>"), (None, None, "<p>y</p>"), (42, "nonsense", "<p>x</p>")]
    frame = spark.createDataFrame([(*r, 1, "h") for r in rows], "page_id long, url string, html string, n int, host string")
    for options in ({}, {"ref_bytes": -1}):
        got = extract(frame, **options).collect()
        assert len(got) == len(rows)
        found = {r.page_id: r.text for r in got}
        for i in range(8):
            assert found[i] == f"Head {i} Text of page {i}." + (" Shared by two." if i < 2 else "")
        assert found[20] == "Read all about it Head 0 Text of page 0. Shared by two."
        assert found[40] == "" and found[41] == "" and found[42] == "x" and found[None] == "y"
        assert all(r.n_chars == len(r.text) for r in got)
    assert extract(frame.limit(0)).count() == 0


def test_template_needs_no_good_page(spark):
    """Bad pages, a page without the box and two layouts: whichever page has the smallest hash, the boxes go."""
    box, other = "<div><p>Read all about it</p></div>", "<section><div><p>Old shop notice</p></div></section>"
    rows = []
    for k in range(12):  # each host has other addresses, so other pages come first by hash
        host = f"http://h{k}.example.com"
        rows += [(100 * k + i, f"{host}/{i}", page(box, f"<div><h2>Head {i}</h2><p>Text {i}.</p></div>")) for i in range(9)]
        rows += [(100 * k + 9, f"{host}/bare", page("<div><h2>Head 9</h2><p>Text 9.</p></div>"))]
        rows += [(100 * k + 10 + i, f"{host}/bad{i}", html) for i, html in enumerate((None, "", ""))]
        host = f"http://two{k}.example.com"
        rows += [(100 * k + 20 + i, f"{host}/{i}", page(box, f"<div><h2>Head {i}</h2><p>Text {i}.</p></div>")) for i in range(6)]
        quote = "<blockquote><p>Said.</p></blockquote>"
        rows += [(100 * k + 30 + i, f"{host}/old/{i}", page(other, f"<section><h2>Head {i}</h2><p>Text {i}.</p>{quote * (i % 2)}</section>")) for i in range(6)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    for options in ({}, {"ref_bytes": -1}):
        found = {r.page_id: r.text for r in extract(frame, **options).collect()}
        assert len(found) == len(rows)
        for k in range(12):
            assert all(found[100 * k + i] == f"Head {i} Text {i}." for i in range(10))
            assert all(found[100 * k + 10 + i] == "" for i in range(3))
            assert all(found[100 * k + 20 + i] == f"Head {i} Text {i}." for i in range(6))
            assert all(found[100 * k + 30 + i] == f"Head {i} Text {i}." + " Said." * (i % 2) for i in range(6))


class Plain(HTMLParser):
    """What stands in an article, read by the library's parser; words of different blocks are kept apart."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.pieces = False, []

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.pieces.append("" if tag in ("b", "a", "i") else " ")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        self.pieces.append("" if tag in ("b", "a", "i") else " ")

    def handle_data(self, data):
        self.pieces.append(data if self.inside else "")


def test_sf_pages_give_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    texts = {r.page_id: r for r in extract(pages).collect()}
    for r in pages.collect():
        plain = Plain()
        plain.feed(r.html or "")
        plain.close()
        expected = " ".join("".join(plain.pieces).split())
        assert texts[r.page_id].text == expected and texts[r.page_id].n_chars == len(expected)

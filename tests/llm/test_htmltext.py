"""HTML extraction: against a plain reading of the given pages, and hand-made hosts."""

import html
import json
import re


from calibra.llm import htmltext as H
from calibra.llm.queries import QUERIES

from tests.conftest import SF01


def brute(page):
    """The given pages have one article; its blocks begin at h1 and p."""
    m = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)
    body = re.sub(r"<[^>]*\Z", "", m[1]) if m else ""
    parts = [re.sub(r"<[^>]*>", " ", x) for x in re.split(r"<h1>|</h1>|<p>|</p>", body)]
    return "\n\n".join(t for t in (" ".join(html.unescape(x).split()) for x in parts) if t)


def test_query_equals_plain_reading(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF01}/pages.parquet").collect()}
    got = QUERIES["op10_html_text"](spark, SF01).collect()
    assert {r.page_id for r in got} == set(pages) and len(got) == len(pages)
    for r in got:
        assert r.text == brute(pages[r.page_id].html), r.page_id
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_wrapper_is_union_free():
    streams = [H.blocks(p) for p in (
        "<body><ul><li>a<li>b</ul><p>x</p></body>", "<body><p>x<p>y</body>", "<body><ul><li>a</ul><h1>t</h1><p>x</body>")]
    got = json.loads(H.align_all([json.dumps(H.wrapper_of(s)) for s in streams]))
    assert H.show(got) == "<body>(<ul>(<li>(#)+)? <h1>(#)? <p>(#)+)"


def test_one_page():
    page = """<html><head><title>no</title><style>p{}</style><script>if (a</script/b) "</p>";</script></head>
    <body><header><h1>Site</h1></header><nav><ul><li>Menu</ul></nav><div id="cookie-notice">We use cookies</div>
    <main><h1>A&nbsp;title &amp; more</h1><p>One <b>bold</b><br>line<span class="ad">buy</span>.<p>Two &lt;3
    <div class="share-buttons">Share</div><ul><li>x<li>y</ul><form>Name <input></form><aside>side</aside>
    <table><tr><td>1<td>2</table><!-- <p>no</p> --><section class="comments"><p>first!</p></section></main>
    <footer>&copy; us</footer></body></html>"""
    paths = H.text_slots(H.wrapper_of(H.blocks(page)), {p: (1, bad, 9) for p, t, bad in H.blocks(page) if t})
    assert H.main_text(page, paths) == "A title & more\n\nOne bold line.\n\nTwo <3\n\nx\n\ny\n\n1\n\n2"


def test_host_without_a_main_element(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><ul><li>Site name</ul><div><h1>Title {i}</h1><p>Some text {i}, long enough.</p>"
             f"{'<p>And more of it.</p>' * (i % 3)}</div><address>Write to us</address></body>") for i in range(6)]
    rows += [(90, None, None), (91, "http://h.example/x", ""), (92, "x", "<p>lone"), (92, "x", "<p>lone"), (None, "http://h.example/9", rows[1][2]),
             (93, "http://long.example/", "<article>" + "<p>word</p>" * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "url as host", "html as text")
    got = {r.page_id: r.text for r in H.extract(pages).collect()}
    for i in range(6):
        assert got[i] == "\n\n".join([f"Title {i}", f"Some text {i}, long enough."] + ["And more of it."] * (i % 3))
    assert got[90] == got[91] == "" and got[92] == "lone" and got[None] == got[1]
    assert got[93] == "\n\n".join(["word"] * 50_000)
    assert H.extract(pages.where("false")).count() == 0


def test_class_tokens_count_whole():
    for attributes in ('class="overflow-hidden"', 'class="no-sidebar"', 'class="has-menu with-ads"', 'id="related-work"', 'class="not-hidden"'):
        for tag in ("div", "section", "body", "article", "p"):
            assert not H._mark(tag, attributes)[1], (tag, attributes)
    for attributes in ('class="box sidebar"', 'id="cookie-notice"', 'class="share-buttons"', 'class="hidden"', "hidden", 'class="nav_menu"'):
        assert H._mark("div", attributes)[1], attributes
    assert H._mark("div", 'class="content no-sidebar"') == ("div.content", False)
    assert not H._mark("body", 'class="hidden"')[1]


def _page(body):
    return f"<html><body>{body}</body></html>"


def _texts(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in H.extract(pages).collect()}


def test_place_in_the_wrapper_decides():
    """Two blocks of one path, told apart only by where the expression has them."""
    pages = [_page(f"<div>Menu of the site</div><h1>Title {i}</h1>{'<ul><li>a</ul>' * (i % 2)}<div>Story {i} of the day.</div>") for i in range(4)]
    wrapper = json.loads(H.align_all([json.dumps(H.wrapper_of(H.blocks(p))) for p in pages]))
    for p in pages:
        where = dict(zip([t for _, t, _ in H.blocks(p) if t], H.matched(H.blocks(p), wrapper)))
        assert where["Menu of the site"] == "/html/body/div" and where[next(t for t in where if t[:5] == "Story")] == "/html/body/div[2]"
    kids = [["p", True, False, []], ["div", False, False, []], ["p", False, True, []]]
    assert H._places(["div", "p"], kids) == [1, 2] and H._places(["p", "div", "p"], kids) == [0, 1, 2] and H._places(["ul"], kids) is None


def test_constant_and_varying_blocks_of_one_path(spark):
    rows = [(i, f"http://two.example/{i}", _page(f"<div><p>Opening hours and directions to our house</p></div><h1>Title {i}</h1>"
             f"<div><p>Story {i} of the day.</p></div>")) for i in range(5)]
    got = _texts(spark, rows)
    assert all(got[i] == f"Title {i}\n\nStory {i} of the day." or got[i] == f"Story {i} of the day." for i in range(5)), got


def test_templates_of_a_host(spark):
    for n, url in ((0, "http://mixed.example/{}"), (100, None), (200, "no scheme {}")):
        a = [(n + i, url and url.format(i), _page(f"<nav>Menu</nav><article><h1>A{i}</h1><p>Article text {i}.</p></article>")) for i in range(4)]
        b = [(n + 50 + i, url and url.format(i), _page(f"<nav>Menu</nav><div><h1>B{i}</h1><p>Plain text {i}.</p></div>")) for i in range(4)]
        got = _texts(spark, a + b)
        for i in range(4):
            assert got[n + i] == f"A{i}\n\nArticle text {i}." and got[n + 50 + i] == f"B{i}\n\nPlain text {i}."


def test_host_of_copies(spark):
    rows = [(i, f"http://copies.example/{i}", _page("<div><h1>Title</h1><p>One text.</p></div>")) for i in range(5)]
    assert set(_texts(spark, rows).values()) == {"Title\n\nOne text."}


def test_marked_block_that_holds_the_text(spark):
    rows = [(i, f"http://marked.example/{i}", _page(f"<div>Name of the site</div><div class='notice'><p>Text number {i}, of some length.</p></div>")) for i in range(5)]
    got = _texts(spark, rows)
    assert all(f"Text number {i}, of some length." in got[i] for i in range(5)), got


def test_deep_and_wide_pages():
    deep = "<html><body>" + "<div>" * 10_000 + "<p>one</p><p>two</p>" + "</div>" * 10_000 + "<article><p>three</p></article></body></html>"
    stream = H.blocks(deep)
    assert [t for _, t, _ in stream if t] == ["one", "two", "three"] and max(p.count("/") for p, _, _ in stream) <= H.DEPTH
    other = H.wrapper_of(H.blocks("<html><body><div><p>x</p></div></body></html>"))
    both = H.json.loads(H.align_all([H.json.dumps(w) for w in (H.wrapper_of(stream), other)]))
    assert len(H.matched(stream, both)) == 3
    wide = ["<html><body>" + "".join(f"<h2>a</h2><p>b{k}</p>" + "<ul><li>c</li></ul>" * (k % step == 0) for k in range(n)) + "</body></html>"
            for n, step in ((2000, 7), (3000, 5))]
    a, b = (H.wrapper_of(H.blocks(x)) for x in wide)
    assert H._align(a, b)


def test_alignment_lengths_equal_the_plain_table():
    import random
    r = random.Random(1)
    for _ in range(200):
        a, b = (["abc"[r.randrange(3)] for _ in range(r.randrange(40))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        common = H._Common(a, b)
        assert [[common(i, j) for j in range(len(b) + 1)] for i in range(len(a) + 1)] == best


def test_query_survives_a_deep_page(spark, tmp_path):
    pages = [(k, "http://h.org/x", "<html><body>" + "<div>" * d + f"<p>text {k} here</p>" + "</div>" * d + "</body></html>") for k, d in enumerate((1, 3, 1200, 5000))]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r.text for r in H.extract(spark.read.parquet(str(tmp_path / "pages.parquet"))).collect()}
    assert got == {k: f"text {k} here" for k in range(4)}

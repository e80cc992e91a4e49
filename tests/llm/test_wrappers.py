"""HTML extraction against a plain parser, wrappers of hosts without marked regions, and odd pages."""

import json
import re
from html.parser import HTMLParser

from skyfold.llm import wrappers as w

SCHEMA = "page_id long, url string, html string, host string, wrapper string, text string"


def frame(spark, pages):
    return spark.createDataFrame([(i, u, h, "h", "w", "t") for i, u, h in pages], SCHEMA).repartition(3)


def extracted(spark, pages):
    return {r.page_id: r.text for r in w.extract(frame(spark, pages)).collect()}


class Article(HTMLParser):
    """The blocks of a page's article, by the parser of the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.on, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.on = self.on or tag == "article"
        if tag in ("p", "h1", "br", "article"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.on = self.on and tag != "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.on:
            self.blocks[-1] += data

    @staticmethod
    def text(html):
        p = Article()
        p.feed(html or "")
        p.close()
        return "\n".join(x for x in (re.sub(r"[\x20\x09-\x0D]+", " ", b).strip(" ") for b in p.blocks) if x)


def test_equals_a_plain_parser(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in w.extract(pages).collect()}
    want = {r.page_id: (r.url, t := Article.text(r.html), len(t)) for r in pages.collect()}
    assert got == want and all(t for _, t, _ in got.values())


def test_clutter_inside_and_around_an_article(spark):
    page = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
    <div class="cookie-notice"><p>We use cookies</p></div><nav><ul><li><a href=/>Home</a><li><a href=/x>X</a></ul></nav>
    <main><article class="post"><header class="post-header"><h1>Big &amp; <i>bold</i></h1></header><p>One&nbsp;two
      three &lt;b&gt; 3 < 4.<p>Four<br>five<!-- no --><script>if (a<b) "</p>"</script>
    <ul><li>first<li>second <a href=y>link</a></ul><div class="advert">Buy</div><form><p>Mail <input></form>
    <table><tr><td>a<td>b<tr><td>c</table><aside>Aside</aside><blockquote>Said</blockquote><div class="share">Share</div>
    <section id="comments"><article class="comment"><p>First!</p></article></section></article></main>
    <div class="sidebar"><p>Related</p></div><footer>&copy; me</footer></body></html>"""
    want = "Big & bold\nOne two three <b> 3 < 4.\nFour\nfive\nfirst\nsecond link\na\nb\nc\nSaid"
    assert extracted(spark, [(1, "http://a.org/1", page), (2, "http://a.org/2", page[: page.index("<aside>")])]) == {1: want, 2: want[: want.index("\nSaid")]}


def plain_page(title, *paragraphs, note=True):
    menu = "".join(f"<div class=x1><a href=/{i}>Menu {i}</a></div>" for i in range(4))
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return f"<html><body><div>{menu}</div><div><h2>{title}</h2>{body}</div>{'<div><p>Call us on Monday</p></div>' if note else ''}<table><tr><td>All our offices</td></tr></table></body></html>"


def test_a_host_without_marked_regions(spark):
    """Texts that stand on every page, and lists of links, are template; what varies is text, with one page or with many."""
    pages = [(i, "http://Plain.example.org/p", plain_page(f"Title {i}", *[f"Text {i} {j}." for j in range(i % 4 + 1)], note=i % 2 == 0)) for i in range(9)]
    got = extracted(spark, pages)
    assert got == {i: "\n".join([f"Title {i}", *[f"Text {i} {j}." for j in range(i % 4 + 1)]]) for i in range(9)}
    copies = [(i, "http://copies.example.org/p", plain_page("Same", "Same text.")) for i in range(5)]
    assert set(extracted(spark, copies).values()) == {"Same\nSame text.\nCall us on Monday\nAll our offices"}
    wrapper = w.infer(w.with_host(frame(spark, pages))).df.collect()
    assert [r.host for r in wrapper] == ["plain.example.org"]
    assert str(w.Item.unpacked(json.loads(wrapper[0].wrapper))) == "(div(div(#)+)div(h2(#)p(#)+)div(p(#))?table(tr(td(#))))"


def test_forms_align_to_one_expression():
    def fold(*forms):
        out = w.general(w.parsed(forms[0]))
        for f in forms[1:]:
            out = w.merged(out, w.general(w.parsed(f)))
        return str(out)

    assert fold("p(#)+", "p(#)") == "(p(#)+)" and fold("h1(#)p(#)", "p(#)") == "(h1(#)?p(#))"
    assert fold("ul(li(#))", "ul(li(#)+li(#ul(li(#)+)))") == "(ul(li(#ul(li(#)+)?)+))"
    assert fold("h2(#)p(#)h2(#)p(#)+", "p(#)") == "(h2(#)*p(#)*)+"
    many = [f"{a}(#){b}(#)" for a in ("p", "ul", "pre", "h2", "h3") for b in ("dl", "ol", "table", "h4")]
    assert fold(*many) == fold(*many) and w.assigned("ol(#)p(#)", w.numbered(w.merged(w.general(w.parsed(many[0])), w.general(w.parsed("ol(#)"))))) == [2, -1]


def test_a_mixed_host_does_not_depend_on_how_rows_are_dealt(spark):
    bodies = ["<p>a{0}</p>", "<h2>b{0}</h2><p>c{0}</p>", "<ul><li>d{0}<li>e{0}</ul>", "<div><div><p>f{0}</div></div>", "<pre>g{0}</pre><dl><dt>h<dd>i{0}</dl>"]
    pages = [(i, "//m.org", "<div>Top</div>" + "".join(bodies[(i * j) % 5].format(i) for j in range(1, i % 7 + 2))) for i in range(80)]
    first = w.infer(w.with_host(frame(spark, pages))).df.collect()
    assert first == w.infer(w.with_host(frame(spark, pages[::-1]).repartition(1))).df.collect() and len(first) == 1
    got = extracted(spark, pages)
    assert all("Top" not in t and t for t in got.values()) and got[0] == "a0"


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "<section>" * 50 + "<p>deep <b>text" + "</div>" * 10
    pages = [(1, None, None), (2, None, ""), (3, "no url", "only text &amp; < more"), (4, "http://x", "<p>cut <a hre"), (5, "http://x", deep), (None, "http://x", "<p>x"), (7, "http://x", "<script>var a"), (8, "http://x", '<p title="a > b">quoted</p><p title="open>rest</p>'), (9, "http://x", "<article><p>" + "long words " * 200000 + "</article>"), (9, "http://x", "<article>again</article>"), (10, "http://x", "</div></p></li><p>a</b></div>b</td>")]
    rows = {}
    for r in w.extract(frame(spark, pages)).collect():
        rows.setdefault(r.page_id, []).append(r.text)
    assert rows[1] == rows[2] == rows[7] == [""] and rows[3] == ["only text & < more"] and rows[4] == ["cut"] and rows[5] == ["deep text"]
    assert rows[None] == ["x"] and rows[8] == ["quoted\nrest"] and sorted(map(len, rows[9])) == [5, 2199999] and rows[10] == ["a\nb"]
    assert w.extract(frame(spark, [])).count() == 0

from html.parser import HTMLParser

import pytest

from shotspark.llm import html_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="<p>no</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li>Menu</li></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div>
<article><h1>Head &amp; line</h1><p><b>First&nbsp;one.<br>still <i>first</i><p>Second  <a href="x>y">link</a>
 ends<div class="share">Share</div><aside>Aside</aside><ul><li>a<li>b</ul><table><tr><td>c<td>d</table>
<form><input>Form<button>Go</button></form><section id="comments"><p>Nice!</p></section>tail &lt;p&gt; &eacute;&#233;</article>
<div class="cookie-notice">Cookies</div><footer>&copy; foot</footer></body></html>"""
TEXT = "Head & line\nFirst one. still first\nSecond link ends\na\nb\nc\nd\ntail <p> éé"


def text(page, template=()):
    return html_text.main_text(html_text.tokens(page), set(template))


def test_article():
    assert text(PAGE) == TEXT


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""), ("", ""), ("   ", ""), ("plain text", "plain text"), ("<p>a<p>b", "a\nb"),
        ("<body><nav>x</nav>y<div>z</div></body>", "y\nz"), ("<main>m<article>a</article></main>", "a"),
        ("<main>m</main><div>o</div>", "m"), ("a < b &amp; c > d", "a < b & c > d"), ("<p>open <b", "open <b"),
        ("<article><p>x</article><p>y</p>", "x"), ("<div hidden>h</div><p>s", "s"), ("<script>never closed", ""),
        ("<p title='a>b'>q</p>", "q"), ("<p title='open>q</p>", "q"), ("<article>" + "<div>" * 3000 + "deep", "deep"),
        ("<ul><li class=nav>x<li>y</ul>", "y"), ("<div class='header-image-credit'>k</div>", "k"),
    ],
)
def test_odd_pages(page, want):
    assert text(page) == want


def test_long_markup_is_linear():
    assert text("<p a='" * 20_000).count("<") >= 0
    assert text("<" * 200_000) == "<" * 200_000


@pytest.fixture(scope="module")
def host_pages(spark):
    rows = []
    for i in range(8):  # no article: the template tells the frame from the text
        body = f"<div><div>Frame line</div><div>Own {i} text</div><div>Last frame</div></div>"
        rows.append((i, f"http://www.Same.org/{i}", body))
    rows += [(20, "http://other.org/", "<div>Frame line</div>"), (21, None, None), (21, None, None), (None, "nonsense", "<p>x</p>")]
    rows += [(30 + i, "http://copies.org/", "<article><p>copied</p></article>") for i in range(5)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as template", "'c' as host")


def test_templates(spark, host_pages):
    found = {r["host"]: set(r["template"]) for r in html_text.deduce_templates(host_pages).collect()}
    shared = {html_text.role(t) for t in html_text.tokens(host_pages.first()["html"]) if "Own" not in str(t)}
    assert found["same.org"] == shared
    assert "other.org" not in found
    got = sorted((str(r["page_id"]), r["text"]) for r in html_text.extract_text(host_pages, html_text.deduce_templates(host_pages)).collect())
    want = [(str(i), f"Own {i} text") for i in range(8)] + [("20", "Frame line"), ("21", ""), ("21", ""), ("None", "x")]
    want += [(str(30 + i), "copied") for i in range(5)]  # copies of an article keep it
    assert got == sorted(want)


def test_template_is_exact_classes(spark, host_pages):
    """Against brute force: tokens of half of the host's pages, with equal vectors in equal order."""
    pages = [r for r in host_pages.collect() if r["url"] and "ame.org" in r["url"]]
    vectors: dict = {}
    for k, r in enumerate(pages):
        for t in html_text.tokens(r["html"]):
            vectors.setdefault(html_text.role(t), [0] * len(pages))[k] += 1
    want = {r for r, v in vectors.items() if sum(x > 0 for x in v) >= max(3, len(pages) / 2)}
    found = {r["host"]: set(r["template"]) for r in html_text.deduce_templates(host_pages).collect()}
    assert found["same.org"] == want


def test_empty(spark, host_pages):
    none = host_pages.limit(0)
    assert html_text.extract_text(none, html_text.deduce_templates(none)).count() == 0


def test_query(spark, sf):
    got = {r["page_id"]: r for r in html_text.op10_html(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        r = got[p["page_id"]]
        start, end = p["html"].index("<article>"), p["html"].find("</article>")
        inside = p["html"][start : end if end >= 0 else None]
        assert r["n_chars"] == len(r["text"]) and r["url"] == p["url"]
        assert r["text"] == text("<body>" + inside) and "track(" not in r["text"]


def extracted(spark, pages):
    rows = [(i, url, body) for i, (url, body) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_text.extract_text(df, html_text.deduce_templates(df)).collect()
    return [r["text"] for r in sorted(got, key=lambda r: r["page_id"])]


def test_copies_without_article_keep_their_text(spark):
    """Copies of one page on half of a host, some with another script or menu."""
    frame = "<script>t({})</script><nav>Menu {}</nav>{}<div>Shared line</div>"
    for copied in ("<div>copied text</div><p>more</p>", "<main><p>copied text</p><p>more</p></main>"):
        own = copied.replace("copied text", "own {}").replace("more", "else {}")
        pages = [("http://a.org/", frame.format(i, i, copied)) for i in range(6)]
        pages += [("http://a.org/", frame.format(i, i, own.format(i, i))) for i in range(4)]
        got = extracted(spark, pages)
        assert got[:6] == ["copied text\nmore"] * 6
        assert got[6:] == [f"own {i}\nelse {i}" for i in range(4)]


def test_shared_main_is_not_left_for_blocks_outside(spark):
    pages = [("http://b.org/", f"<main><p>same</p>{f'<p>own {i}</p>' if i else ''}</main><div>outside {i}</div>") for i in range(5)]
    assert extracted(spark, pages) == ["same"] + [f"own {i}" for i in range(1, 5)]


def test_template_decides_inside_the_article(spark):
    """A shared line in a class without a telling name goes; copies of an article keep theirs."""
    page = '<article><h1>Head {0}</h1><p>own {0}</p><div class="xk7">Read our terms</div></article>'
    pages = [("http://c.org/", page.format(i)) for i in range(6)] + [("http://c.org/", page.format("copied"))] * 7
    assert extracted(spark, pages) == [f"Head {i}\nown {i}" for i in [*range(6), *["copied"] * 7]]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><h2 id=search>Search</h2><h3 id=comments>On comments</h3><p class=notice>n</p></article>", "Search\nOn comments\nn"),
        ("<article class='ad related'><p>whole</p></article>", "whole"),
        ("<article class=promo><p>a <span class=share>b</span> c</p></article>", "a b c"),
        ("<article><blockquote class=related>q</blockquote><table class=widget><tr><td id=menu>d</table></article>", "q\nd"),
    ],
)
def test_text_blocks_are_never_left_out_by_name(page, want):
    assert text(page) == want


def test_names_need_the_template(spark):
    """A named element goes if the host's pages share it, and stays if only one page has it."""
    page = '<article><p>own {0}</p><div class="widget">{1}</div><section id="comments"><p>said {0}</p></section></article>'
    pages = [("http://d.org/", page.format(i, "").replace('<div class="widget"></div>', "")) for i in range(6)]
    pages.append(("http://d.org/", page.format(9, "text of this page")))
    assert extracted(spark, pages) == [f"own {i}" for i in range(6)] + ["own 9\ntext of this page"]


def test_numbered_names_do_not_hide_a_template(spark):
    """Articles with an id of their own share the line below them."""
    page = '<article id="post-{0}" class="post post-{0} entry"><p>own {0}</p><div class="foot">Sold by the yard</div></article>'
    assert extracted(spark, [("http://e.org/", page.format(i)) for i in range(5)]) == [f"own {i}" for i in range(5)]


def test_reader_comments_of_a_single_page_go(spark):
    plain = "<article><p>own {0}</p></article>"
    said = '<article><p>own {0}</p><div class="comments"><div class="comment">Reader says hi</div></div></article>'
    more = '<main><p>own {0}</p></main><ol id="comment-list"><li>Reader says hi<p>and more</p></li></ol>'
    pages = [("http://f.org/", plain.format(i)) for i in range(5)] + [("http://f.org/", said.format(5)), ("http://f.org/", more.format(6))]
    assert extracted(spark, pages) == [f"own {i}" for i in range(7)]


class Plain(HTMLParser):
    """The article's blocks by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.blocks, self.text = [], [], []

    def flush(self):
        block = " ".join("".join(self.text).split())
        self.text = []
        names = [n for n, _ in self.stack]
        if block and "article" in names and not any(dead for _, dead in self.stack):
            self.blocks.append(block)

    def handle_starttag(self, tag, attrs):
        if tag in html_text.VOID:
            if tag == "br":
                self.text.append(" ")
            elif tag not in html_text.INLINE:
                self.flush()
            return
        if tag in html_text.INLINE:
            return
        self.flush()
        dead = tag in "nav footer header aside form button script style select textarea noscript template iframe".split()
        names = " ".join(v or "" for k, v in attrs if k in ("class", "id"))
        self.stack.append((tag, dead or "comment" in names and tag in ("div", "section", "ol", "ul")))

    def handle_endtag(self, tag):
        if tag in html_text.INLINE or tag in html_text.VOID:
            return
        self.flush()
        if tag in [n for n, _ in self.stack]:
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.text.append(data)


def test_query_is_an_independent_parser(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in html_text.op10_html(spark, sf).collect()}
    equal = 0
    for p in pages:
        plain = Plain()
        plain.feed(p["html"])
        plain.close()
        plain.flush()
        equal += got[p["page_id"]] == "\n".join(plain.blocks)
    assert equal == len(pages) == len(got)

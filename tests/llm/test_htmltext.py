import random
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from marrow.llm import htmltext
from marrow.llm.queries import QUERIES


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        ("<p>a <b>b</b>c<br>d\n e<p>f", ["a bc d e", "f"]),
        ("<nav>x</nav><article><h1>T</h1><p><b>a<br><p>b &amp;&nbsp;c &copy &#233; &am</article><footer>y</footer>", ["T", "a", "b & c © é &am"]),
        ("<article><header><h1>T</h1></header>x<div class='ad-box'>ad</div><section id=comments>c</section></article>", ["T", "x"]),
        ("<body><header>h</header><div>m</div><aside>s</aside><form>f</form><div role=navigation>n</div><div hidden>z</div></body>", ["m"]),
        ("<script>var t='</p><p>no';</script><style>p{}</style><p>x</p><!-- <p>c</p> -->", ["x"]),
        ("<ul><li>a<li>b</ul><table><tr><td>1<td>2</table>", ["a", "b", "1", "2"]),
        ("a < b <3 c", ["a < b <3 c"]),
        ("<p>cut <a href='x", ["cut"]),
        ("<SCRIPT>x</ScRiPt ><P CLASS=Notice>n</P><P TITLE='a>b'>t</P>", ["t"]),
        ("</div></p>x<p>y</section></p>z", ["x", "y", "z"]),
        ("<article></article><p>outside</p>", ["outside"]),
        ("<main><p>m</p></main><p>o</p><article>a</article>", ["m", "a"]),
        ("<div class='header-image'>h</div><div class='main shadow'>k</div>", ["k"]),
        ("<aside><article>TEASER</article></aside><section class='related'><article>TEASER 2</article></section><article>t<section id='comments'><article class='comment'>READER</article></section></article>", ["t"]),
        ("<article class='comment'>c</article><article class=post>p</article>", ["p"]),
        ("<div data-hidden='false'>a</div><div data-id='nav' title='what is hidden'>b</div><p title='class=ad' alt=hidden>c</p>", ["a", "b", "c"]),
        ("<article><header class='entry-header'><h1>T</h1></header><div class='entry-header'>s</div><p class='ad-hoc'>1<div class='social-history'>2</div><div id=related-work>3</div></article>", ["T", "s", "1", "2", "3"]),
        ("<div class='ad-slot'>a</div><div id='site-nav'>b</div><div class='x comment-list'>c</div><p class='share_buttons'>d</p><div class='page-footer'>e</div><div class='with-sidebar no-comments'>k</div>", ["k"]),
        ("<article>a<div class='ad'>x</div>b<span class=ad>y</span>c</article>", ["a", "b c"]),
        ("<article>a<div hidden=''>x</div><p hidden>y</p></article>", ["a"]),
        ("<script>never closed <p>x", []),
        ("", []),
    ],
)
def test_blocks(page, blocks):
    assert htmltext.blocks(page) == blocks


LONG = "<p>" + "Much of the story is told here. " * 8 + "</p>"
STORY = ("Much of the story is told here. " * 8).strip()


@pytest.mark.parametrize("name", ["sidebar-right", "layout sidebar-left", "nav-left content", "menu-content", "banner-content", "header-image", "social", "page-header", "widget"])
@pytest.mark.parametrize("page", ["<body><nav>n</nav><div id=main class='{}'>{}</div><footer>f</footer>", "<body><div class='{}'><article><h1>T</h1>{}</article></div><div class=sidebar>s <p>more</p></div>", "<body><article class='post {}'>{}</article>", "<body><div class='{0}'><div class='{0}'>{1}</div></div>"])
def test_names_of_the_layout_leave_the_main_text(page, name):
    assert htmltext.blocks(page.format(name, LONG))[-1] == STORY


@pytest.mark.parametrize("name", ["adsbygoogle", "google-ad", "dfp-ad", "adsense", "reader-comments", "post-comment", "commentlist", "gdpr-banner", "cookiebar", "newsletter-signup", "topnav", "xyz-ad-slot", "my-blog-comments", "ad-slot-17", "privacy-notice"])
def test_names_of_adverts_and_comments(name):
    soft = name in ("newsletter-signup", "topnav")
    junk = f"<div class='{name}'>Buy this. {'Or that. ' * (9 if soft else 60)}</div>"
    assert htmltext.blocks(f"<article><h1>T</h1>{LONG}{junk}<p>end</p></article>") == ["T", STORY, "end"]
    if not soft:  # even where it is most of the page
        assert htmltext.blocks(f"<body>{LONG}{junk}{junk}") == [STORY]


@pytest.mark.parametrize("name", ["no-comments", "with-ads", "ad-hoc", "commentary", "load", "without-sidebar", "read-advice", "social-history", "navigation-in-birds", "xq-content-area", "uncommented"])
def test_other_names_say_nothing(name):
    assert htmltext.blocks(f"<article>{LONG}<div class='{name}'>kept</div></article>") == [STORY, "kept"]


def test_further_reading():
    links = "<ul><li><a href=1>One story</a><li><a href=2>Another story</a></ul>"
    assert htmltext.blocks(f"<main><h1>T</h1>{LONG}<section><h2>Related stories</h2>{links}</section></main>") == ["T", STORY]
    assert htmltext.blocks(f"<main>{LONG}<h3>You may also like</h3>{links}<p>end</p></main>") == [STORY, "end"]
    assert htmltext.blocks(f"<main>{LONG}<h2>Sources</h2>{links}</main>") == [STORY, "Sources", "One story", "Another story"]
    assert htmltext.blocks(f"<main>{LONG}<h2>Related work</h2><p>Told in <a href=x>one</a> and by many others.</p></main>")[1:] == ["Related work", "Told in one and by many others."]


def test_a_teaser_is_not_the_article():
    assert htmltext.blocks(f"<body><div class=post>{LONG}</div><article class=teaser>short</article>") == [STORY, "short"]
    assert htmltext.blocks(f"<body><div class=post>{LONG}</div><section class=related><article>short</article></section>") == [STORY]
    assert htmltext.blocks(f"<body><div class='layout sidebar-left'>{LONG}</div><section class=related><article>short</article></section>") == [STORY]
    assert htmltext.blocks(f"<body><div>{LONG}</div><section id=comments><article>reader {'says ' * 99}</article></section>") == [STORY]


def test_built_pages_give_what_went_in():
    """Pages built of parts whose text is known, nested at random: the blocks that belong to the article come out, all and in order."""
    rng = random.Random(8)
    keep = [
        lambda w: (f"<p>{w} one &amp; <b>two</b></p>", [f"{w} one & two"]),
        lambda w: (f"<h2 class='ad-hoc title'>{w}</h2>", [w]),
        lambda w: (f"<ul data-menu='x'><li>{w}<li id=li-{w}>b</ul>", [w, "b"]),
        lambda w: (f"<blockquote title='hidden'><p>{w}\n  x</p></blockquote>", [f"{w} x"]),
        lambda w: (f"<table><tr><td>{w}<td data-hidden=true>2</table>", [w, "2"]),
        lambda w: (f"<div class='social-history related-work'>{w}</div>", [w]),
    ]
    drop = ["<nav><ul><li>n</ul></nav>", "<aside><article>teaser</article></aside>", "<div class='x ad-box'>ad</div>", "<form><p>f</p></form>", "<section id=comments><article class=comment><p>r</p></article></section>", "<script>if (a < b) '</p>'</script>", "<style>p{}</style>", "<div role=navigation>m</div>", "<p class=notice>c</p>", "<footer><p>f</footer>", "<!-- <p>x</p> -->", "<div style='display: none'>h</div>"]

    def part(depth: int) -> tuple[str, list[str]]:
        if rng.random() < 0.4:
            return rng.choice(drop), []
        if depth and rng.random() < 0.4:
            inner = [part(depth - 1) for _ in range(rng.randint(1, 4))]
            tag = rng.choice(["div", "section", "div class='content with-sidebar'", "div hidden-x"])
            return f"<{tag}>{''.join(x for x, _ in inner)}</{tag.split()[0]}>", [b for _, bs in inner for b in bs]
        return rng.choice(keep)(f"w{rng.randint(0, 99)}")

    for _ in range(300):
        parts = [part(3) for _ in range(rng.randint(1, 8))]
        body, want = "".join(x for x, _ in parts), [b for _, bs in parts for b in bs]
        page = f"<html><head><title>t</title></head><body><header><h1>Site</h1></header>{rng.choice(drop)}<article><h1>A</h1>{body}</article>{rng.choice(drop)}<footer>f</footer></body></html>"
        assert htmltext.blocks(page) == ["A", *want], page


class Plain(HTMLParser):
    """Another reading of the given pages: text of the article, blocks ended by every tag but b."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.inside, self.found = False, [""]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        self.found[-1] += " " if tag == "br" else ""
        self.found += [""] if tag not in ("b", "br") else []

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "article"
        self.found += [""] if tag not in ("b", "br") else []

    def handle_data(self, data):
        self.found[-1] += data if self.inside else ""


def test_all_given_pages_against_another_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    want = {r["page_id"]: "\n\n".join(b for x in Plain(r["html"] or "").found if (b := " ".join(x.split()))) for r in pages}
    got = {r["page_id"]: r["text"] for r in QUERIES["op3_html"](spark, "/root/testdata/sf0.01").collect()}
    assert got == want


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 200_000 + "x",
        "<div class=sidebar>" * 60_000 + "x" + "</div>" * 60_000,
        "<i>" * 100_000 + "</b>" * 100_000 + "x",
        "<article>" * 100_000 + "x",
        "<article><header><h2>" * 40_000 + "x",
        "<p><i>" * 100_000 + "<div>x",
        "<td><div>" * 100_000 + "x",
        "a < b " * 200_000,
        "<!-- c -->a" * 100_000,
        "<section><h2>more</h2><ul><li><a>" * 30_000 + "x",
    ],
)
def test_time_goes_with_the_length(page):
    began = time.process_time()
    htmltext.blocks(page)
    htmltext.hashed(htmltext.parse(page))
    assert time.process_time() - began < 10  # some seconds at most on a slow machine; in the square of the depth it would be hours


def test_deep_and_long_pages():
    assert htmltext.blocks("<div>" * 5000 + "x" + "</div>" * 5000) == ["x"]
    assert htmltext.blocks("<p>a</p>" * 20000) == ["a"] * 20000
    assert htmltext.blocks("<a title='" * 2000 + "x")[:1] in ([], ["x"])


def test_equal_subtrees_have_equal_hashes():
    one, two, three = (htmltext.hashed(htmltext.parse(x))[0].hash for x in ("<div><p>a  b</p></div>", "<div>\n<p>a b</p></div>", "<div><h2>a b</h2></div>"))
    assert one == two != three


def test_site_template_goes_where_it_recurs(spark):
    boiler = "<div><p>Sold by our shop</p><ul><li>terms</li></ul></div>"
    rows = [(i, f"http://Shop.example/{i}", f"<body>{boiler}<p>page {i}</p></body>") for i in range(12)]
    rows += [(100, "http://other.example/", f"<body>{boiler}<p>single</p></body>"), (101, None, None), (102, "no url", "<p>x</p>")]
    got = {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(rows, "page_id int, url string, html string").withColumn("host", F.lit("h")).withColumn("hashes", F.lit(1))).collect()}
    assert all(got[i] == f"page {i}" for i in range(12))
    assert got[100] == "Sold by our shop\n\nterms\n\nsingle"
    assert (got[101], got[102]) == ("", "x")


def test_join_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(htmltext, "MAX_BROADCAST_HASHES", -1)
    rows = [(i, "http://a.b/x", f"<p>same</p><p>{i}</p>") for i in range(12)]
    got = htmltext.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()
    assert {r["text"] for r in got} == {str(i) for i in range(12)}
    assert htmltext.extract(spark.createDataFrame([], "page_id int, url string, html string")).count() == 0


def test_query(spark, tables):
    got = {r["page_id"]: r for r in QUERIES["op3_html"](spark, tables[0]).collect()}
    assert all((got[i]["text"], got[i]["n_chars"]) == (f"T{i}\n\nText & {i}", len(f"T{i}\n\nText & {i}")) for i in range(60))

"""Main text of web pages, with site template removal.

Every block element's subtree has a hash, built from its tag, its text and its children's hashes. A
first pass counts, per host, on how many pages each subtree occurs; those on at least `MIN_PAGES`
pages and on `MIN_SHARE` of the host's pages are the site's template. The second pass parses again
and drops them, and whatever tags, roles, classes or ids mark as menu, header, footer, sidebar, notice,
advert, form, script, style or reader comment. If a page has an article or main element, the text is
what is left inside those, unless they are a small part of all that is left (`TEASER`): then it is that.

A name may tell what an element is, or only what the layout is like around it. So names of adverts, comments and
consent always count, while other marks, on an element with over half of the page's text and most of it not in links,
say nothing if no article or main element stands outside it. A list of links under a heading that announces
further reading goes too.

Only hashes are shuffled, and they are counted before the exchange, so that a host with a third of
all pages is no burden. The templates come as one list a host; the lists are broadcast if there are
at most `MAX_BROADCAST_HASHES` hashes in all, else joined to the pages by host, where Spark may
split the pages of a large host.

Of a class or id only whole names count that are known marks, or a mark and a part of a page
(`FORMS`), or that end with an advert or comments (`HARD`); words of other names say nothing. What is in a dropped
element is dropped, articles too.

Nulls: null html gives the empty text; a null url has the empty host, which is a host like any
other. Repeated pages count as several pages of their host. Broken markup is read as browsers do in
the main: a block start closes an open paragraph, unclosed elements end with their parent. Empty
tables give empty tables. Pages of any length are parsed whole, one at a time, in time of their length however deep
they are nested, without recursion. Only
id, url and html are read, so further columns may have any names. Ties: a subtree on just `MIN_SHARE` of the pages is template.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marrow.llm.common import settled, slices
from marrow.llm.urlfilter import host_of

MIN_PAGES, MIN_SHARE = 10, 0.3
MAX_BROADCAST_HASHES = 1_000_000
SLICE_BYTES = 8_000_000

# Elements by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
DROPPED = frozenset("head script style noscript template svg canvas iframe object nav aside footer form menu button select textarea dialog search title xmp noembed noframes".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: Names of a class, or an id, that say as they stand that the element is no main text.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget footer masthead cookie cookies consent notice notices alert popup modal newsletter subscribe subscription signup login comment comments comentarios disqus respond replies share sharing social related recommended pagination pager skip toolbar copyright".split()
)
#: Names of two words and more: what it is, then what part of a page; or where it is, then what it is. Others, such as related-work, say nothing.
_WHAT = "ads?|advert(?:isement)?s?|banner|sponsored|promo|nav(?:bar|igation)?|menu|breadcrumbs?|sidebar|footer|header|masthead|cookies?|consent|notice|alert|popup|modal|newsletter|subscribe|signup|login|comments?|disqus|repl(?:y|ies)|shar(?:e|ing)|social|related|recommended|pagination"
_PART = "[0-9]+|area|articles|author|background|banner|bar|block|body|bottom|box|buttons?|col|column|consent|container|content|feed|footer|form|frame|group|header|icons?|image|inner|inline|item|items|label|left|links?|list|main|media|menu|meta|modal|nav|notice|outer|overlay|panel|popup|posts|primary|right|row|secondary|section|slot|stories|text|thread|title|toggle|top|unit|widgets?|wrap|wrapper|zone"
_WHERE = "bottom|footer|global|header|inline|in-?article|left|main|mobile|page|primary|right|secondary|side|site|sticky|sub|top|user"
_THERE = "ads?|advert(?:isement)?|banner|breadcrumbs?|comments|footer|menu|nav|navbar|navigation|sidebar"
#: Names of adverts, comments and consent, with whatever stands before, unless that says that there are none or only that there are some.
HARD = re.compile("(?!(?:no|not|non|with|without|has|have|is|hide|show|un)[-_])(?:[a-z0-9]+[-_]+)*(?:ads?|adsbygoogle|adsense|adslot|adunit|adbox|advert(?:isement)?s?|comments?|comment-?lists?|commentary-list|disqus(?:-thread)?|cookie-?bars?|cookie-?banners?|cookie-?notices?|consent-?banners?|(?:gdpr|ccpa|privacy)-?(?:banner|bar|notice|popup|consent))|(?:[a-z0-9]+[-_]+)*ads?[-_](?:slot|unit|box|banner|container|wrapper|label|block|zone|frame|placeholder)(?:[-_]+[0-9a-z]+)?")
#: Marks of one word made of two.
_JOINED = "(?:top|sub|side|main|foot|head|page|site|global|mobile)(?:nav|menu|bar|navbar|navigation)|nav(?:menu|list|links)|(?:newsletter|email|mail)[-_]*(?:signup|sign-up|subscribe|optin|opt-in|form|box)|(?:more|read|further)[-_](?:stories|articles|reading|next)|(?:also|related)[-_](?:like|stories|articles|posts|links|content|news|reading)"
FORMS = re.compile(f"{_JOINED}|(?:{_WHAT})(?:[-_]+(?:{_PART}))+|(?:{_WHERE})[-_]+(?:{_THERE})|(?:{_WHERE}|post|article|entry)[-_]+(?:share|sharing|social|related|comments)|(?:global|site|top)[-_]+header")
#: Of these names an element is no main text whatever it holds.
ALWAYS = frozenset("ad ads advert adverts advertisement advertisements advertising sponsor sponsored cookie cookies consent comment comments comentarios disqus respond replies adsbygoogle adsense commentlist".split())
#: Headings that announce further reading, in part of the languages that pages have; they count only over links.
FURTHER = re.compile(r"\W*(?:related|recommended|more|read|you (?:may|might)|see also|further reading|also on|popular|trending|à lire|lire aussi|sur le même|articles? (?:liés|similaires)|mehr|weitere|lesen sie|das könnte|artículos relacionados|más|también|te puede|leia|veja)\b", re.I)
LISTS = frozenset("ul ol div section menu table p".split())
#: Share of a subtree's text in links from which it is a list of links, and of all text below which an article is a teaser.
LINKS, TEASER = 0.6, 0.25
#: An element of the first kind ends an open one of these kinds, if no element of the last kinds is between.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table", "tbody", "thead", "tfoot")),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
    "body": (("head",), ()),
}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)(?:>|\Z)", re.S)
#: An attribute after another, so that a value is never taken for a name.
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
TELLING = re.compile("class|id|role|hidden|style", re.I)
RAW_END = {tag: re.compile(f"</{tag}", re.I) for tag in RAW}
SPACE = re.compile(r"\s+")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Node:
    """soft: marked by a name that may be of the layout. size, linked: letters and signs inside that are not dropped, and those of them in links.

    tops: how many articles or main elements it is or holds; under: whether it is inside one.
    """

    __slots__ = ("children", "dropped", "hash", "header", "heading", "linked", "size", "soft", "tag", "tops", "under")

    def __init__(self, tag: str, dropped: bool = False, header: bool = False, soft: bool = False):
        self.tag, self.dropped, self.header, self.soft, self.children, self.hash = tag, dropped, header, soft, [], 0


def told(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether the element's tag and own attributes say that it is no main text, that it is a header, and, if nothing else, that a name of the layout says so."""
    dropped, header, soft = tag in DROPPED, tag == "header", False
    if tag in ("html", "body", "main") or not TELLING.search(attributes):
        return dropped, header, soft
    for m in ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        if name in ("class", "id"):
            for word in (m[2] or m[3] or m[4] or "").lower().split():
                header = header or word == "header"
                dropped = dropped or word in ALWAYS or HARD.fullmatch(word) is not None
                soft = soft or word in MARKS or FORMS.fullmatch(word) is not None
        elif name == "hidden":
            dropped = True
        elif name in ("role", "aria-hidden", "style"):
            value = (m[2] or m[3] or m[4] or "").lower().strip()
            dropped = dropped or (value in DROPPED_ROLES if name == "role" else value == "true" if name == "aria-hidden" else UNSEEN.search(value) is not None)
    return dropped, header, soft and not dropped


def parse(page: str) -> Node:
    root = Node("#root")
    stack = [root]
    at = 0
    match, search = TOKEN.match, page.find
    places: dict[str, list[int]] = {}  # where in the stack the open elements of a tag are

    def last(tags: tuple) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def pop(to: int) -> None:
        while len(stack) > to:
            places[stack.pop().tag].pop()

    def close(kinds: tuple, walls: tuple) -> None:
        if (i := last(kinds)) > last(walls):
            pop(i)

    while at < len(page):
        start = search("<", at)
        if start < 0:
            start = len(page)
        m = match(page, start) if start < len(page) else None
        if m is None and start < len(page):  # a sign, not a tag
            start += 1
        if start > at:
            stack[-1].children.append(page[at:start])
        at = start
        if m is None:
            continue
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if i := last((tag,)):
                pop(i)
            continue
        if not m[0].endswith(">"):  # cut off inside the tag
            continue
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            after = page.find(">", end.end()) if end else -1
            at = after + 1 if after >= 0 else len(page)
            continue
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in BLOCK:
            close(("p",), ("button", "table", "td", "th", "caption"))
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            pop(len(stack) - 1)
        node = Node(tag, *told(tag, m[3] or ""))
        stack[-1].children.append(node)
        if tag not in VOID and not (m[3] or "").endswith("/"):
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)
    return root


def order(root: Node) -> list[Node]:
    """All elements, parents before children."""
    out, i = [root], 0
    while i < len(out):
        out += [c for c in out[i].children if isinstance(c, Node)]
        i += 1
    return out


def hashed(root: Node) -> list[Node]:
    """The block elements that have text; every element gets the hash of its subtree, 0 if it has none."""
    nodes = order(root)
    for node in reversed(nodes):
        parts = []
        for c in node.children:
            if isinstance(c, str):
                if not c.isspace():
                    parts.append("#" + SPACE.sub(" ", c).strip())
            elif c.hash:
                parts.append(f"{c.tag}{c.hash:x}")
        node.hash = xxhash.xxh3_64_intdigest(f"<{node.tag}>" + "\x00".join(parts)) if parts else 0
    return [n for n in nodes if n.hash and n.tag in BLOCK and n.tag not in ("html", "body", "article", "main", "head")]


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def outermost(root: Node, tags: tuple[str, ...], but: Callable[[Node], bool] = lambda n: False) -> list[Node]:
    """The kept elements of these tags that have text and are in no other such, in page order; none in what `but` tells."""
    found, work = [], [root]
    while work:
        n = work.pop()
        if n.tag in tags and n.size:
            found.append(n)
        else:
            work += [c for c in reversed(n.children) if isinstance(c, Node) and not c.dropped and not but(c)]
    return found


def measure(whole: list[Node]) -> None:
    """size and linked of all elements, from the leaves up."""
    for n in reversed(whole):
        n.size = n.linked = 0
        for c in n.children:
            if isinstance(c, str):
                n.size += len(c) - c.count(" ") - c.count("\n") - c.count("\t") - c.count("\r")
            elif not c.dropped:
                n.size += c.size
                n.linked += c.linked
        if n.tag == "a":
            n.linked = n.size


def drop(n: Node) -> None:
    """Also what is in it, as soon as its turn comes."""
    n.dropped = True
    for c in n.children:
        if isinstance(c, Node):
            c.dropped = True


def announced(n: Node) -> list[Node]:
    """Headings of further reading right before links and little else, and these."""
    kin = [c for c in n.children if isinstance(c, Node) and not c.dropped and c.size]
    out = []
    for head, links in zip(kin, kin[1:]):
        if head.tag in HEADINGS and links.tag in LISTS and links.linked >= LINKS * links.size:
            words = "".join(entities.unescape(c) for x in order(head) for c in x.children if isinstance(c, str))
            if FURTHER.match(words.strip()):
                out += [head, links]
    return out


def judge(root: Node, whole: list[Node]) -> None:
    """Settle what is dropped, from the marks of the elements and what they hold. whole: as order() gives it."""
    for n in reversed(whole):
        n.heading = n.tag in HEADINGS or any(c.heading for c in n.children if isinstance(c, Node))
    for n in whole:  # a header that holds a heading of its article is kept, others go
        if n.header and not n.dropped:
            n.dropped = n in root.children or not n.heading
        if n.dropped:
            drop(n)
    measure(whole)
    large = lambda n: 2 * n.size > root.size and 2 * n.linked < n.size
    tops = {id(n) for n in outermost(root, ("article", "main"), lambda n: n.soft and not large(n))}
    for n in reversed(whole):
        n.tops = (id(n) in tops) + sum(c.tops for c in n.children if isinstance(c, Node))
    root.under = False
    for n in whole:
        for c in n.children:
            if isinstance(c, Node):
                c.under = n.under or id(n) in tops
        if n.dropped or n.soft and not (large(n) and len(tops) == (1 if n.under else n.tops)):
            drop(n)
        elif n.linked:
            for c in announced(n):
                c.dropped = True
    measure(whole)


def blocks(page: str, template: frozenset[int] | set[int] = frozenset()) -> list[str]:
    """The blocks of main text in page order."""
    root = parse(page)
    if template:
        for n in hashed(root):
            if signed(n.hash) in template:
                n.dropped = True
    whole = order(root)
    judge(root, whole)
    out: list[str] = []
    text: list[str] = []

    def flush() -> None:
        if block := SPACE.sub(" ", entities.unescape("".join(text))).strip():
            out.append(block)
        text.clear()

    tops = outermost(root, ("article", "main"))
    if not tops or sum(n.size - n.linked for n in tops) < TEASER * (root.size - root.linked):
        tops = [root]
    header_outside = tops == [root]
    # A walk without recursion: elements are entered and, if blocks, left.
    work: list = []
    for n in reversed(tops):
        work += [None, n]
    while work:
        n = work.pop()
        if n is None:
            flush()
        elif isinstance(n, str):
            text.append(n)
        elif n.dropped or n.header and header_outside or n.tag == "br":
            if n.tag in BLOCK:  # what it stood between are two blocks
                flush()
            else:
                text.append(" ")
        else:
            if n.tag in BLOCK:
                flush()
                work.append(None)
            work += reversed(n.children)
    flush()
    return out


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, hashes array<bigint>) of the subtrees that recur, from pages (host, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", SLICE_BYTES):
            hosts, found = [], []
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                here = {signed(n.hash) for n in hashed(parse(page or ""))}
                hosts += [host] * len(here)
                found += here
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(found, pa.int64())], names=["host", "hash"])

    size = pages.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    counts = pages.select("host", "html").mapInArrow(run, "host string, hash bigint").groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    often = counts.join(size, "host").where(F.col("n") >= min_share * F.col("pages"))
    # at most (subtrees of a page) / min_share hashes a host
    return often.groupBy("host").agg(F.array_sort(F.collect_list("hash")).alias("hashes"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """id_col, url_col and text of every row: blocks joined by an empty line."""
    df = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col).cast("string")).alias("host"), F.col(html_col).cast("string").alias("html"))
    known = settled(templates(df, min_pages, min_share), "html-templates")
    size = known.agg(F.sum(F.size("hashes"))).first()[0] or 0
    df = df.join(F.broadcast(known) if size <= MAX_BROADCAST_HASHES else known, "host", "left").select("id", "url", "html", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", SLICE_BYTES):
            rows = zip(batch.column("html").to_pylist(), batch.column("hashes").to_pylist(), strict=True)
            found = pa.array(["\n\n".join(blocks(page or "", set(hashes or ()))) for page, hashes in rows], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), found], names=[id_col, url_col, "text"])

    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), T.StructField(url_col, pages.schema[url_col].dataType), T.StructField("text", T.StringType())])
    return df.mapInArrow(run, schema)

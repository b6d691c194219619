"""Main text of web pages: site templates are found by counting element subtrees per host.

Every page is parsed into elements.  The subtrees outside its article and the blocks
inside are hashed and counted per host in Spark; those that recur on many pages of the
host, or in many different articles, are the site's template.  A second pass deletes
them together with elements that never hold main text, and writes what is left as blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import stored, values_of

#: A subtree is template if it stands on at least so many different pages of its host and on this share of them.
LEAST_PAGES = 3
LEAST_SHARE = 0.3
#: A block inside articles is template if it stands in at least so many different articles and in that share of them.
LEAST_ARTICLES = 5

#: Fixed values of HTML: elements without content, elements whose content is no markup.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
#: Fixed values of HTML: elements that stand as blocks, and those that end an open paragraph.
BLOCKS = set(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre section summary table tbody td tfoot th thead "
    "tr ul".split()
)
ENDS_PARAGRAPH = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "legend"}
#: Elements that can be template inside an article; a recurring word, cell, item or heading is part of its text.
SECTIONS = set("address blockquote center details div dl fieldset figure hgroup ol p pre section table ul".split())
#: Tells hashes of blocks inside articles from those of subtrees outside.
INSIDE = 0x5DEECE66D1CE4E5B
#: Start tags that end an open element of these names, up to the given enclosing ones.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Elements that never hold main text.
DROPPED = set(
    "script style noscript template head title nav footer aside form button select textarea input iframe object embed "
    "svg canvas audio video dialog menu menuitem map".split()
)
#: Whole names in class or id that mark such elements, and roles that do; vaguer names are left to the counts per host.
MARKS = set(
    "ad ads advert adverts advertisement advertisements advertising ad-banner ad-container ad-slot ad-unit adsbygoogle "
    "breadcrumb breadcrumbs comment comments comment-form comment-list comments-area comments-section cookie-banner "
    "cookie-bar cookie-consent cookie-notice disqus disqus_thread footer gdpr main-menu main-nav masthead nav navbar "
    "navigation newsletter newsletter-signup page-footer popup-overlay related-articles related-links related-posts "
    "share-bar share-buttons sharing-buttons sidebar site-footer site-header site-nav social-links social-share "
    "sponsored top-nav".split()
)
ROLES = set("banner complementary contentinfo dialog alertdialog menu menubar navigation search toolbar".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_MARKED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)


class Element:
    __slots__ = ("tag", "marks", "parts", "parent", "key", "has_text", "dropped")

    def __init__(self, tag: str, marks: str, parent: Element | None) -> None:
        self.tag, self.marks, self.parent = tag, marks, parent
        self.parts: list[Element | str] = []
        self.key, self.has_text, self.dropped = 0, False, False

    def close(self) -> None:
        """Hash the finished subtree: tag, marks, texts and the hashes of its elements."""
        digest = blake2b(f"{self.tag}\0{self.marks}".encode("utf-8", "replace"), digest_size=8)
        for part in self.parts:
            if isinstance(part, str):
                words = part.split()
                if words:
                    self.has_text = True
                    digest.update(b"\1" + " ".join(words).encode("utf-8", "replace"))
            else:
                self.has_text |= part.has_text
                digest.update(b"\2" + part.key.to_bytes(8, "little", signed=True))
        self.key = int.from_bytes(digest.digest(), "little", signed=True)

    def is_marked(self) -> bool:
        if not self.marks or self.tag in ("html", "body", "main"):
            return False
        return any(m[5:] in ROLES if m.startswith("role=") else m in MARKS for m in self.marks.split())

    def is_article(self) -> bool:
        return self.tag in ("article", "main") and not self.dropped


def find_dropped(root: Element) -> None:
    """Tell which elements of a finished tree never hold main text.

    An element that holds an article is only dropped for its class, id or role if another
    article stands outside all such elements, as the articles of a comment box do not.
    """
    order, stack = [], [(root, False, False)]
    marked, hidden, inside = set(), set(), set()  # by id: marked itself, in such an element, in an article
    while stack:
        element, in_dropped, in_article = stack.pop()
        order.append(element)
        if element.is_marked():
            marked.add(id(element))
        if in_article:
            inside.add(id(element))
        if in_dropped or id(element) in marked or element.tag in DROPPED or (element.tag == "header" and not in_article):
            in_dropped = True
            hidden.add(id(element))
        in_article |= element.tag in ("article", "main") and id(element) not in marked
        stack += [(p, in_dropped, in_article) for p in element.parts if not isinstance(p, str)]
    holders, free = set(), False
    for element in reversed(order):
        if element.tag in DROPPED:
            continue
        holds = id(element) in holders
        if element.tag in ("article", "main") and id(element) not in marked and element.has_text:
            free |= not holds and id(element) not in hidden
            holds = True
        if holds:
            holders.add(id(element))
            if element.parent is not None:
                holders.add(id(element.parent))
    for element in order:
        if element.tag in DROPPED:
            element.dropped = True
        elif element.tag == "header":
            element.dropped = id(element) not in inside
        if id(element) in marked and not element.dropped:
            element.dropped = free or id(element) not in holders


def parse(html: str) -> Element:
    """The tree of a page; unclosed and misplaced tags are mended as browsers do for common cases."""
    root = top = Element("html", "", None)
    open_tags: dict[str, int] = {}

    def end(upto: Element) -> None:
        """Close all elements up to and with this one."""
        nonlocal top
        while True:
            top.close()
            open_tags[top.tag] -= 1
            done, top = top is upto, top.parent
            if done:
                return

    def nearest(names: set[str], stops: set[str]) -> Element | None:
        if not any(open_tags.get(n) for n in names):
            return None
        element = top
        while element is not None and element.tag not in stops:
            if element.tag in names:
                return element
            element = element.parent
        return None

    at, length = 0, len(html)
    while at < length:
        found = _TAG.search(html, at)
        if found is None:
            top.parts.append(unescape(html[at:]))
            break
        if found.start() > at:
            top.parts.append(unescape(html[at : found.start()]))
        at = found.end()
        slash, name, rest = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
        if not name:
            if found.group().startswith("<![CDATA["):
                top.parts.append(found.group()[9:].removesuffix("]]>"))
            continue
        tag = name.lower()
        if slash:
            if open_tags.get(tag):
                element = nearest({tag}, set())
                if element is not None:
                    end(element)
            continue
        if tag in ("html", "body"):
            continue
        if tag in ENDS_PARAGRAPH:
            paragraph = nearest({"p"}, {"table", "td", "th", "button", "object"})
            if paragraph is not None:
                end(paragraph)
        if tag in ENDS:
            # The outermost of the open elements that this one ends.
            names, stops = ENDS[tag]
            while (element := nearest(names, stops)) is not None:
                end(element)
        marks = " ".join(names_of(*m) for m in _MARKED.findall(rest)) if rest else ""
        element = Element(tag, marks, top)
        top.parts.append(element)
        if tag in VOID:
            element.close()
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
            element.parts.append(html[at : stop.start() if stop else length])
            element.close()
            at = stop.end() if stop else length
            continue
        if not rest.endswith("/") or tag in BLOCKS:
            open_tags[tag] = open_tags.get(tag, 0) + 1
            top = element
        else:
            element.close()
    while top is not root:
        end(top)
    root.close()
    find_dropped(root)
    return root


def names_of(attribute: str, value: str) -> str:
    """The names in a class, id or role in lower case; roles are told apart."""
    names = value.strip("\"'").lower().split()
    return " ".join(f"role={n}" for n in names) if attribute.lower() == "role" else " ".join(names)


def template_candidates(root: Element) -> set[int]:
    """Hashes of the subtrees with text that lie outside articles and hold none."""
    found, stack = set(), [root]
    holds = articles(root)
    above = set()
    for element in holds:
        while element is not None and id(element) not in above:
            above.add(id(element))
            element = element.parent
    inside = {id(e) for e in holds}
    while stack:
        element = stack.pop()
        if id(element) in inside:
            continue
        if element.has_text and element is not root and id(element) not in above:
            found.add(element.key)
        stack += [p for p in element.parts if not isinstance(p, str)]
    return found


def article_holders(chosen: list[Element]) -> set[int]:
    """The elements (by ``id``) inside articles that are an article or hold one."""
    above, stack = set(), list(chosen)
    while stack:
        element = stack.pop()
        stack += [p for p in element.parts if not isinstance(p, str)]
        if element.is_article():
            while element is not None and id(element) not in above:
                above.add(id(element))
                element = element.parent
    return above


def article_candidates(root: Element, chosen: list[Element]) -> set[tuple[int, int]]:
    """Hashes, told apart by ``INSIDE``, of the blocks with text inside articles that hold no article.

    Each comes with the hash of the text of the innermost article around it.
    """
    found, holders = set(), article_holders(chosen)
    stack = [(element, 0) for element in chosen]
    while stack:
        element, own = stack.pop()
        if element.dropped:
            continue
        if element.is_article():
            own = digest(text_of(root, [element], set()))
        if element.tag in SECTIONS and element.has_text and id(element) not in holders:
            found.add((element.key ^ INSIDE, own))
        stack += [(p, own) for p in element.parts if not isinstance(p, str)]
    return found


def articles(root: Element) -> list[Element]:
    """The outermost articles with text that do not lie in a dropped element, in page order."""
    found, stack = [], [root]
    while stack:
        element = stack.pop()
        if element.dropped or not element.has_text:
            continue
        if element.is_article():
            found.append(element)
        else:
            stack += [p for p in reversed(element.parts) if not isinstance(p, str)]
    return found


def main_text(html: str, template: set[int]) -> str:
    """The blocks of the articles, or of the whole page if it has none, without template and dropped elements."""
    root = parse(html)
    return text_of(root, articles(root), template)


def text_of(root: Element, chosen: list[Element], template: set[int]) -> str:
    """The text of a parsed page, of which ``chosen`` are the articles."""
    protected = bool(chosen)
    holders = article_holders(chosen) if template else set()

    def recurs(element: Element) -> bool:
        if not protected:
            return element.key in template
        return element.tag in SECTIONS and element.key ^ INSIDE in template and id(element) not in holders

    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        words = "".join(line).split()
        if words:
            blocks.append(" ".join(words))
        line.clear()

    for start in chosen or [root]:
        stack: list[Element | str | None] = [start]
        while stack:
            part = stack.pop()
            if part is None:
                flush()
            elif isinstance(part, str):
                line.append(part)
            elif part.dropped or recurs(part):
                line.append(" ")
            else:
                if part.tag in BLOCKS:
                    flush()
                    stack.append(None)
                elif part.tag == "br":
                    line.append(" ")
                stack += reversed(part.parts)
        flush()
    return "\n".join(blocks)


def digest(text: str) -> int:
    """A 64-bit hash of a text."""
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def host_of(url: str):
    """Host of a URL column, lower-case; empty for null or anything that is no URL."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def site_templates(pages: DataFrame) -> DataFrame:
    """``host, template``: the subtree hashes that recur on a host; ``pages`` has ``host, html``.

    A page adds each of its subtrees once, and pages or articles of one text add theirs
    once however many copies there are, so that copies of a page do not make its content
    template.  Where all pages of a host are copies, only what is template of another
    host, shown there by different pages, is known to be template: it is taken for one
    if it stands on enough of the copies.  As each hash of the result stands on a share
    of the pages or articles of its host, a host has few of them whatever its size.
    """

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, keys, own, sides = [], [], [], []
            for host, html in zip(values_of(batch.column("host")), values_of(batch.column("html"))):
                root = parse(html or "")
                chosen = articles(root)
                page = digest(text_of(root, chosen, set()))
                found = [(None, page)]  # the page itself
                found += [(key, page) for key in template_candidates(root)]
                outside = len(found)
                if chosen:
                    found += [(None, page), *article_candidates(root, chosen)]
                hosts += [host] * len(found)
                keys += [key for key, _ in found]
                own += [text for _, text in found]
                sides += [i >= outside for i in range(len(found))]
            arrays = [pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(own, pa.int64()), pa.array(sides)]
            yield pa.RecordBatch.from_arrays(arrays, ["host", "key", "text", "inside"])

    found = pages.select("host", "html").mapInArrow(subtrees, "host string, key long, text long, inside boolean")
    each = found.groupBy("host", "inside", "key", "text").agg(F.count("*").alias("copies"))
    n = (F.count("*").alias("n"), F.sum("copies").alias("copies"))
    counts = stored(each.groupBy("host", "inside", "key").agg(*n), "subtrees")
    sizes = counts.where(F.col("key").isNull())
    sizes = sizes.select("host", "inside", F.col("n").alias("pages"), F.col("copies").alias("rows"))
    least = F.when(F.col("inside"), LEAST_ARTICLES).otherwise(LEAST_PAGES)
    often = counts.where(F.col("key").isNotNull() & (F.col("copies") >= least)).join(sizes, ["host", "inside"])
    shown = (F.col("n") >= least) & (F.col("n") >= LEAST_SHARE * F.col("pages"))
    copied = ~F.col("inside") & (F.col("pages") == 1) & (F.col("copies") >= LEAST_SHARE * F.col("rows"))
    often = stored(often.select("host", "key", shown.alias("shown"), copied.alias("copied")).where("shown or copied"), "often")
    known = often.where("shown").select("key").distinct()
    repeated = often.where("shown").select("host", "key")
    repeated = repeated.union(often.where("copied and not shown").join(known, "key", "left_semi").select("host", "key"))
    return repeated.groupBy("host").agg(F.collect_set("key").alias("template"))


def extract(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` in place of ``html``.

    Of articles (``article`` and ``main`` elements) only blocks that stand in many different
    articles of the host go; copies of one page stay, however many.  Blocks are
    joined by a line feed, white space inside a block becomes one space.  A null or
    empty page has an empty text, as has one that is all template.  Columns named
    ``text`` or ``n_chars`` are replaced, all others stay; equal rows give equal texts.
    """
    kept = [c for c in pages.columns if c.lower() not in (html.lower(), "text", "n_chars")]
    rows = pages.select(
        host_of(url).alias("host"),
        F.col(html).alias("html"),
        F.struct(F.lit(1).alias("__one"), *[F.col(f"`{c}`") for c in kept]).alias("row"),
    )
    templates = stored(site_templates(rows), "templates")
    joined = rows.join(templates, "host", "left").select("html", "template", "row")
    out = joined.select("row").schema.add("text", "string").add("n_chars", "long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, template in zip(values_of(batch.column("html")), values_of(batch.column("template"))):
                texts.append(main_text(page, set(template or ())) if page else "")
            arrays = [batch.column("row"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, out.names)

    return joined.mapInArrow(read, out).select(*[F.col(f"row.`{c}`") for c in kept], "text", "n_chars")

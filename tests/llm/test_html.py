"""Main text of pages: planted pages with known texts, and a plain parse of the given ones."""

import re
from html import unescape

import pytest

import __spark_entry__ as entry
from tablewright.llm import html
from tests.conftest import SF

CASES = [
    (None, ""),
    ("", ""),
    ("   \n ", ""),
    ("just text", "just text"),
    ("<p>a<p>b &amp; c&nbsp; d</p>", "a\nb & c d"),
    ("<article><h1> T </h1><p>one\n two</p><p>x<br>y</p></article><footer>f</footer>", "T\none two\nx y"),
    ("<nav>n</nav><main><header><h1>H</h1></header><ul><li>a<li>b</ul></main><aside>s</aside>", "H\na\nb"),
    ("<article><p>a</p><div class='ad x'>no</div><section id=comments><p>c</p></section>b</article>", "a\nb"),
    ("<header>top</header><div role=banner>b</div><p>t</p><form>f</form>", "t"),
    ("<article><script>var t='</p>';</script><style>p{}</style>x<!-- <p>no</p> -->y</article>", "xy"),
    ("<article><p><b>open<br><p>next</article>", "open\nnext"),
    ("<article>a<div>b<p>c", "a\nb\nc"),
    ("<p title='a>b' class=x>quote</p><p title=\"broken>z</p>", "quote\nz"),
    ("a < b and <3 c<", "a < b and <3 c<"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
    ("</p></div>stray</article>", "stray"),
    ("<article class=comment>c</article><article>main</article>", "main"),
    ("<body class='has-sidebar'><p>t</p></body>", "t"),
    ("<ARTICLE><P>Up</P></ARTICLE>", "Up"),
    ("<article><p>&lt;b&gt; &#233;&eacute; &bogus; &#x1F600;</p></article>", "<b> éé &bogus; 😀"),
    ("<div>" * 20000 + "deep", "deep"),
    ("<article>" + "<p>word </p>" * 5000 + "</article>", "\n".join(["word"] * 5000)),
]


@pytest.mark.parametrize("page,text", CASES)
def test_page(page, text):
    assert (html.main_text(page, set()) if page else "") == text


def plain(page):
    """The article of a page of the given tables by plain patterns."""
    article = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    blocks = re.split(r"</?(?:p|h1)>", article)
    return "\n".join(b for b in (" ".join(unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks) if b)


def test_given_pages(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = entry.queries()["op9_html_text"](spark, SF).collect()
    assert len(got) == len(pages)
    for row in got:
        assert row["text"] == plain(pages[row["page_id"]]["html"])
        assert row["n_chars"] == len(row["text"]) and row["url"] == pages[row["page_id"]]["url"]


def test_template_without_articles(spark):
    menu = "<div><p>Site of all things</p><p>Home</p></div>"
    rows = [(i, "http://a.b/x", f"{menu}<div><p>own text {i}</p><p>said twice {i // 2}</p></div>") for i in range(10)]
    rows += [(20, "http://c.d/y", f"{menu}<p>once here</p>"), (21, None, menu), (22, "no url", None)]
    rows += [(23, "http://e.f/", menu)] * 5
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, host int, Text string")
    found = html.extract(df)
    assert found.columns == ["page_id", "url", "host", "text", "n_chars"]
    got = {r["page_id"]: r["text"] for r in found.collect()}
    assert found.count() == len(rows)
    assert all(got[i] == f"own text {i}\nsaid twice {i // 2}" for i in range(10))
    assert got[20] == "Site of all things\nHome\nonce here"
    assert got[21] == "Site of all things\nHome" and got[22] == "" and got[23] == ""
    assert html.extract(df.limit(0)).count() == 0


def test_copies_of_an_article_stay(spark):
    page = "<nav><a>menu</a></nav><article><p>the same article</p></article>"
    df = spark.createDataFrame([(i, "http://a.b/", page) for i in range(9)], "page_id long, url string, html string")
    assert {r["text"] for r in html.extract(df).collect()} == {"the same article"}


def test_template_inside_articles(spark):
    notice = "<div><p>Our shop sells <b>nice</b> things.</p><ul><li>More</li></ul></div>"
    page = "<article><h2>Intro</h2><p>own text {0} <b>often</b></p>{1}<table><tr><td>yes</td></tr><tr><td>{0}</td></tr></table></article>"
    rows = [(i, "http://a.b/", page.format(i, notice)) for i in range(8)]
    rows += [(i, "http://few.b/", page.format(i, notice)) for i in range(20, 24)]  # too few different ones
    rows += [(30, "http://c.d/", page.format(30, notice))] * 9  # copies of one article
    rows += [(i, "http://e.f/", f"<main><div><article><p>same</p></article></div>{i}</main>") for i in range(40, 48)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    shop = "Our shop sells nice things.\nMore\n"
    for i in [*range(8), *range(20, 24), 30]:
        assert got[i] == f"Intro\nown text {i} often\n{'' if i < 8 else shop}yes\n{i}"
    assert all(got[i] == f"same\n{i}" for i in range(40, 48))


def test_copies_of_a_page_without_article_stay(spark):
    menu = "<div><p>Menu of all</p></div>"
    copy = f"{menu}<div><p>the content of a page</p></div>"
    rows = [(1, "http://a.b/", copy)] * 5 + [(i, "http://a.b/", f"{menu}<div><p>page {i}</p></div>") for i in range(10, 16)]
    rows += [(2, "http://small.b/", copy)] * 3 + [(3, None, "<div><p>only</p></div>")] * 4
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    assert got[1] == got[2] == "the content of a page" and got[3] == "only"
    assert all(got[i] == f"page {i}" for i in range(10, 16))


@pytest.mark.parametrize(
    "page,text",
    [
        ("<div class='layout no-sidebar'><p>t</p></div>", "t"),
        ("<div class=has-sidebar><article>t</article></div>", "t"),
        ("<div class='layout sidebar'><article>t</article></div>", "t"),
        ("<main><h1>H</h1><div class='layout sidebar'><article>t</article></div></main>", "H\nt"),
        ("<article>a<section class=ad-hoc>b</section><section id=search-methods>c</section><p class=notice>d</p></article>", "a\nb\nc\nd"),
        ("<article>a</article><div class=sidebar><article>b</article></div>", "a"),
        ("<main><article>a</article><div class=comments><article>b</article></div></main>", "a"),
        ("<article>a<div class='x Comments'>b</div><div role='Navigation'>c</div></article>", "a"),
    ],
)
def test_whole_names_and_wrappers(page, text):
    assert html.main_text(page, set()) == text

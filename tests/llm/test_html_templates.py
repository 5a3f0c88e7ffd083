import html
import re

from trialspark.llm import html_templates

PAGE = "page_id long, url string, html string, templates string"


def plain(page):
    """The text of the article of the given pages, which hold one each."""
    article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1|br)[^>]*>", article)
    texts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", b))).strip() for b in blocks)
    return " ".join(t for t in texts if t)


def test_given_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    given = {r.page_id: r for r in pages.collect()}
    got = html_templates.extract(pages).collect()
    assert len(got) == len(given)
    assert all(r.text == plain(given[r.page_id].html) and r.n_chars == len(r.text) for r in got)


def site(i, body):
    return (
        f"<html><head><title>{i}</title></head><body><div class=top><span>Site &amp; Co</span></div>"
        f"<div><p>{body}</p><div class='x'>Terms apply</div></div><div id='comments'>say {i}</div></body></html>"
    )


def test_recurring_subtrees_go(spark):
    rows = [(i, "http://Some.Host/" + str(i), site(i, f"Body {i} &lt;of&gt;\n text")) for i in range(12)]
    rows += [(20, "http://other.host/x", site(20, "alone")), (21, None, None), (22, "nonsense", ""), (1, "http://some.host/1", rows[1][2])]
    rows += [(23, "http://u/", "<p>a<b>b</b>c<br>d<ul><li>e<li>f</ul><script>var x='</p>'</script><!-- z --><p>g&nbsp;h &eacute;")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], PAGE)
    got = {}
    for r in html_templates.extract(pages).collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert got[5] == ["Body 5 <of> text"] and got[1] == ["Body 1 <of> text"] * 2
    assert got[20] == ["Site & Co alone Terms apply"]  # one page has no template
    assert got[21] == [""] and got[22] == [""]
    assert got[23] == ["abc d e f g h é"]
    assert html_templates.extract(pages.limit(0)).count() == 0


def test_layouts_of_a_third_each(spark):
    rows = []
    for i in range(36):
        side = f"<div class=box{'abc'[i % 3]}><p>Layout {i % 3} side text that recurs on a third of the pages</p></div>"
        copied = f"<article><h2>Copy {i}</h2><div><p>A long passage that a few pages share word by word</p></div></article>"
        body = copied if i < 7 else f"<article><p>Body {i}</p>{side}<p>of many words, more than the side text next to it has</p></article>"
        url = f"http://big.host/{i}" if i % 2 else None
        rows += [(i, "http://big.host/", f"<body>{side}{body}</body>", "x"), (100 + i, url, f"<body>{side}<p>Own {i}</p></body>", "x")]
    got = {r.page_id: r.text for r in html_templates.extract(spark.createDataFrame(rows, PAGE)).collect()}
    for i in range(36):
        copied = f"Copy {i} A long passage that a few pages share word by word"
        assert got[i] == (copied if i < 7 else f"Body {i} of many words, more than the side text next to it has")
        assert got[100 + i] == f"Own {i}"


def test_copies_of_a_page_keep_their_text(spark):
    page = "<body><nav>menu</nav><article><h1>T</h1><p>same words</p></article><footer>f</footer></body>"
    pages = spark.createDataFrame([(i, "http://h/", page, "x") for i in range(50)], PAGE)
    assert {r.text for r in html_templates.extract(pages).collect()} == {"T same words"}


def test_marks_and_deep_trees():
    text = lambda page: html_templates.main_text(html_templates.parse(page), frozenset())
    assert text("<main><div class='ad-box ad'>x</div><p hidden>y</p><header><h2>H</h2></header><p>z</p></main>") == "H z"
    assert text("<div role=navigation>x</div><article class=comment>c</article><p>z</p>") == "z"
    assert text("<article>a</article><aside>b</aside><article>c</article>") == "a c"
    assert text("<div>" * 300 + "deep" + "</div>" * 300) == "deep"
    assert text("<p>open <i>one<p>two</i> three</p></div> four") == "open one two three four"


def test_pages_of_any_depth(spark):
    deep = "<div>" * 5000 + "far down" + "</div>" * 5000
    pages = spark.createDataFrame([(1, "http://a.b/1", deep), (2, "http://a.b/2", "<p>near</p>")], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_templates.extract(pages).collect()} == {1: "far down", 2: "near"}
